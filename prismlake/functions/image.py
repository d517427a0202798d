"""Pixel kernels on numpy arrays of height, width and channels (RGB)."""

from __future__ import annotations

import struct

import numpy as np

# Sides of working images; integer luma weights (BT.709, per 10000); where the landmarks of a face belong in a crop.
BLUR_SIDE, HASH_SIDE, DETECT_SIDE, CROP_SIDE = 400, 8, 640, 112
LUMA = (2126, 7152, 722)
LANDMARKS = ((38.2946, 51.6963), (73.5318, 51.5014), (56.0252, 71.7366), (41.5493, 92.3655), (70.7299, 92.2041))
STRIDES = (8, 16, 32)


def read_bmp(data: bytes) -> np.ndarray:
    """Pixels of an uncompressed 24 or 32 bit BMP file."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP file")
    start, _, w, h, _, depth, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if depth not in (24, 32) or packed not in (0, 3) or w <= 0 or not h:
        raise ValueError("a BMP of a kind that isn't read here")
    row = (w * depth // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, "u1", row * abs(h), start).reshape(abs(h), row)[:, : w * depth // 8].reshape(abs(h), w, -1)
    return (rows[::-1] if h > 0 else rows)[:, :, 2::-1].copy()


def upright(x: np.ndarray, orientation: int) -> np.ndarray:
    """Pixels turned as an Exif orientation (1 to 8) says."""
    flip = lambda p: p[:, ::-1]
    turn = lambda p, k: np.rot90(p, -k)  # noqa: E731  quarters, clockwise
    return {2: lambda: flip(x), 3: lambda: turn(x, 2), 4: lambda: x[::-1], 5: lambda: flip(turn(x, 1)), 6: lambda: turn(x, 1), 7: lambda: flip(turn(x, 3)), 8: lambda: turn(x, 3)}.get(orientation, lambda: x)()


def _weights(old: int, new: int) -> np.ndarray:
    """Triangle filter, as wide as the step when shrinking: (new, old)."""
    step = old / new
    reach = max(1.0, step)
    centre = (np.arange(new) + 0.5) * step
    w = np.maximum(0, 1 - np.abs(np.arange(old)[None, :] + 0.5 - centre[:, None]) / reach)
    return w / w.sum(1, keepdims=True)


def resized(x: np.ndarray, w: int, h: int) -> np.ndarray:
    y = np.einsum("ij,jkc->ikc", _weights(x.shape[0], h), x.astype("f8"))
    return np.clip(np.rint(np.einsum("kj,ijc->ikc", _weights(x.shape[1], w), y)), 0, 255).astype("u1")


def fitted(x: np.ndarray, side: int) -> np.ndarray:
    scale = min(side / x.shape[1], side / x.shape[0])
    return resized(x, max(1, round(x.shape[1] * scale)), max(1, round(x.shape[0] * scale)))


def luma(x: np.ndarray) -> np.ndarray:
    return (x.astype("i8") @ np.array(LUMA) // 10000).astype("u1")


def blur(x: np.ndarray) -> float:
    """Population variance of the 4-neighbour Laplacian of the fitted grey image; 0 if a side is under 3."""
    g = luma(fitted(x, BLUR_SIDE)).astype("f8")
    if min(g.shape) < 3:
        return 0.0
    return float((g[1:-1, :-2] + g[1:-1, 2:] + g[:-2, 1:-1] + g[2:, 1:-1] - 4 * g[1:-1, 1:-1]).var())


def average_hash(x: np.ndarray) -> int:
    """64 bits, row by row from the lowest: the grey 8 by 8 image's pixels that reach its mean; as a signed number."""
    g = luma(resized(x, HASH_SIDE, HASH_SIDE)).ravel().astype("i8")
    return int(np.packbits(g * g.size >= g.sum(), bitorder="little").view("<i8")[0])


def letterboxed(x: np.ndarray) -> tuple[np.ndarray, float, int, int]:
    """The image in the middle of a black square, its scale, and its left and top edges."""
    scale = min(DETECT_SIDE / x.shape[1], DETECT_SIDE / x.shape[0])
    small = resized(x, max(1, round(x.shape[1] * scale)), max(1, round(x.shape[0] * scale)))
    left, top = (DETECT_SIDE - small.shape[1]) // 2, (DETECT_SIDE - small.shape[0]) // 2
    out = np.zeros((DETECT_SIDE, DETECT_SIDE, 3), "u1")
    out[top : top + small.shape[0], left : left + small.shape[1]] = small
    return out, scale, left, top


def tensor(x: np.ndarray) -> np.ndarray:
    """One image as a (1, 3, h, w) float tensor, blue first, 0 to 255."""
    return np.ascontiguousarray(x[None, :, :, ::-1].transpose(0, 3, 1, 2), "f4")


def detections(outputs: list[np.ndarray], scale: float, left: int, top: int, least: float = 0.9) -> np.ndarray:
    """Rows score, x, y, w, h and ten landmark coordinates of the cells that score enough, in the image's own pixels.

    outputs: for each stride class scores, then for each object scores, boxes, landmarks, cells row by row.
    """
    found = []
    for k, stride in enumerate(STRIDES):
        cls, obj, box, marks = (np.asarray(outputs[k + 3 * j], "f8").reshape(-1, n) for j, n in enumerate((1, 1, 4, 10)))
        side = DETECT_SIDE // stride
        cell = np.stack([np.arange(side * side) % side, np.arange(side * side) // side], 1)
        score = np.sqrt(np.clip(cls[:, 0], 0, 1) * np.clip(obj[:, 0], 0, 1))
        good = score >= least  # NaN is never good
        size = np.exp(box[good, 2:]) * stride
        corner = (cell[good] + box[good, :2]) * stride - size / 2
        points = (marks[good].reshape(-1, 5, 2) + cell[good][:, None]) * stride
        shift = np.array([left, top])
        found.append(np.concatenate([score[good, None], (corner - shift) / scale, size / scale, ((points - shift) / scale).reshape(-1, 10)], 1))
    return np.concatenate(found)


def kept(rows: np.ndarray, overlap: float = 0.3) -> np.ndarray:
    """Rows of ``detections``, best score first, without those that overlap a kept one by more."""
    rows, out = rows[np.argsort(-rows[:, 0], kind="stable")], []
    size = np.maximum(rows[:, 3:5], 0)
    left = np.arange(len(rows))
    while len(left):
        k, left = left[0], left[1:]
        out.append(k)
        low, high = np.maximum(rows[k, 1:3], rows[left, 1:3]), np.minimum(rows[k, 1:3] + size[k], rows[left, 1:3] + size[left])
        both = np.maximum(0, high - low).prod(1)
        union = size[k].prod() + size[left].prod(1) - both
        left = left[~(np.divide(both, union, out=np.zeros(len(left)), where=union > 0) > overlap)]
    return rows[out]


def similarity(source: np.ndarray, target: np.ndarray) -> tuple[float, float, float, float]:
    """a, b, tx, ty as vector.similarity_transform gives them, of points (n, 2)."""
    cs, ct = source.mean(0), target.mean(0)
    (x, y), (u, v) = (source - cs).T, (target - ct).T
    s = float((x * x + y * y).sum())
    a, b = (float((x * u + y * v).sum()) / s, float((x * v - y * u).sum()) / s) if s > 1e-12 else (0.0, 0.0)
    return a, b, float(ct[0] - a * cs[0] + b * cs[1]), float(ct[1] - b * cs[0] - a * cs[1])


def aligned(x: np.ndarray, a: float, b: float, tx: float, ty: float) -> np.ndarray:
    """The crop whose pixel (u, v) is the image's at the inverse of u = a x - b y + tx, v = b x + a y + ty; black outside."""
    v, u = np.mgrid[0:CROP_SIDE, 0:CROP_SIDE].astype("f8")
    s = a * a + b * b
    out = np.zeros((CROP_SIDE, CROP_SIDE, 3), "u1")
    if s < 1e-12:
        return out
    px, py = (a * (u - tx) + b * (v - ty)) / s, (a * (v - ty) - b * (u - tx)) / s
    inside = (px >= 0) & (py >= 0) & (px < x.shape[1] - 1) & (py < x.shape[0] - 1)
    px, py = px[inside], py[inside]
    i, j = np.floor(py).astype(int), np.floor(px).astype(int)
    fy, fx = (py - i)[:, None], (px - j)[:, None]
    img = x.astype("f8")
    out[inside] = np.rint((img[i, j] * (1 - fx) + img[i, j + 1] * fx) * (1 - fy) + (img[i + 1, j] * (1 - fx) + img[i + 1, j + 1] * fx) * fy).astype("u1")
    return out
