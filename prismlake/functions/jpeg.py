"""A plain JPEG writer for pictures that are sent to a service: no subsampling, codes of equal length."""

from __future__ import annotations

import numpy as np

#: Where each coefficient of a block goes: along the diagonals, turning at the edges.
_ORDER = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i % 8 if (i // 8 + i % 8) % 2 == 0 else i // 8))))
#: Steps grow with the frequency.
_STEPS = (3 + 2 * np.add.outer(np.arange(8), np.arange(8))).ravel()
_WAVES = np.array([[(0.5 if u else 0.125**0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
_SIZES = list(range(12))
_RUNS = [0x00, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 11))]
_CODE = np.zeros(256, "i8")
_CODE[_RUNS] = np.arange(len(_RUNS))


def _segment(mark: int, body: bytes) -> bytes:
    return bytes([0xFF, mark]) + (len(body) + 2).to_bytes(2, "big") + body


def _blocks(x: np.ndarray) -> np.ndarray:
    """Coefficients (blocks, 64), in file order, of an RGB image: three blocks for each 8 by 8 pixels."""
    h, w = x.shape[:2]
    x = np.pad(x, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge").astype("f8")
    y = x @ [0.299, 0.587, 0.114]
    planes = np.stack([y - 128, (x[:, :, 2] - y) * 0.5 / (1 - 0.114), (x[:, :, 0] - y) * 0.5 / (1 - 0.299)])
    tiles = planes.reshape(3, y.shape[0] // 8, 8, y.shape[1] // 8, 8).transpose(1, 3, 0, 2, 4).reshape(-1, 8, 8)
    return np.rint((_WAVES @ tiles @ _WAVES.T).reshape(-1, 64) / _STEPS).astype("i8")[:, _ORDER]


def _bits(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size of each number in bits, and the bits that tell it among those of its size."""
    size = np.ceil(np.log2(np.abs(value) + 1)).astype("i8")
    return size, np.where(value < 0, value + (1 << size) - 1, value)


def encode(x: np.ndarray) -> bytes:
    """The bytes of a JPEG file of RGB pixels (height, width, 3)."""
    h, w = x.shape[:2]
    coef = _blocks(x)
    first = coef[:, 0].copy()
    first[3:] -= coef[:-3, 0]
    size, extra = _bits(first)
    items = [(np.arange(len(coef)) * 1000, size << size | extra, 4 + size)]
    block, at = np.nonzero(coef[:, 1:])
    size, extra = _bits(coef[block, at + 1])
    before = np.where(np.diff(block, prepend=-1) != 0, -1, np.concatenate([[0], at[:-1]])) if len(at) else at
    run = at - before - 1
    items.append((block * 1000 + at * 10 + 9, _CODE[(run % 16) << 4 | size] << size | extra, 8 + size))
    far = np.repeat(np.arange(len(run)), run // 16)
    items.append((block[far] * 1000 + at[far] * 10 + 8, np.full(len(far), _CODE[0xF0]), np.full(len(far), 8)))
    open_ = np.flatnonzero(coef[:, 63] == 0)
    items.append((open_ * 1000 + 999, np.full(len(open_), _CODE[0]), np.full(len(open_), 8)))
    place, value, bits = (np.concatenate([i[k] for i in items]) for k in range(3))
    order = np.argsort(place, kind="stable")
    value, bits = value[order], bits[order]
    which = np.repeat(np.arange(len(bits)), bits)
    left = np.repeat(np.cumsum(bits), bits) - np.arange(len(which)) - 1
    stream = (value[which] >> left) & 1
    packed = np.packbits(np.concatenate([stream, np.ones(-len(stream) % 8, "i8")]).astype("u1")).tobytes().replace(b"\xff", b"\xff\0")
    counts = lambda n, size: bytes(n if k == size else 0 for k in range(1, 17))
    return b"".join([
        b"\xff\xd8", _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), _segment(0xDB, b"\0" + bytes(_STEPS[_ORDER].tolist())),
        _segment(0xC0, b"\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + b"\3" + b"".join(bytes([c, 0x11, 0]) for c in (1, 2, 3))),
        _segment(0xC4, b"\0" + counts(len(_SIZES), 4) + bytes(_SIZES)), _segment(0xC4, b"\x10" + counts(len(_RUNS), 8) + bytes(_RUNS)),
        _segment(0xDA, b"\3" + b"".join(bytes([c, 0]) for c in (1, 2, 3)) + b"\0\x3f\0"), packed, b"\xff\xd9",
    ])
