"""One pass over each file: metadata, pixels' quality, faces, a picture to send, error rows."""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlsplit

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from prismlake.functions import image, jpeg as jpeg_, media, parsers
from prismlake.operators.faces import Faces
from prismlake.sources.exif import read_exif
from prismlake.sources.tools import Tools

_FIELDS = {
    "abs_path": "string", "date_taken": "string", "gps_lat": "double", "gps_lon": "double", "camera_make": "string", "camera_model": "string", "flash_tag": "int", "width": "int", "height": "int", "blur": "double",
    "phash": "long", "faces": "array<struct<score: double, embedding: array<double>>>", "jpeg": "binary", "probe": "string", "error": "string",
}
_OUT, _NAMES = ", ".join(f"{k} {v}" for k, v in _FIELDS.items()), list(_FIELDS)
#: Pictures of one scan, the bytes that hold a JPEG file's metadata, and the side of a picture to send.
SCAN, HEAD, SIDE = 20_000, 1 << 20, 1024


def _open(path: str, most: int | None = None) -> bytes:
    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with store.open_input_file(at) as f:
        return f.read(most) if most else f.read()


def _raw(data: bytes) -> np.ndarray:
    """RGB of a RAW file, where the rawpy library is installed."""
    try:
        import rawpy
    except ImportError as e:
        raise ValueError("no decoder for raw files") from e
    with rawpy.imread(io.BytesIO(data)) as shot:
        return shot.postprocess()


def _pixels(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """RGB of Spark's image rows: grey, or blue, green, red and maybe alpha."""
    x = np.frombuffer(data, "u1").reshape(height, width, channels)
    return np.repeat(x, 3, 2) if channels == 1 else x[:, :, 2::-1]


def _looked(x: np.ndarray, meta: dict, turn: bool, faces: Faces | None, jpeg: bool) -> dict:
    x = np.ascontiguousarray(image.upright(x, meta["orientation"]) if turn else x)
    row = {"date_taken": meta["datetime"], "gps_lat": meta["gps_lat"], "gps_lon": meta["gps_lon"], "camera_make": meta["camera_make"], "camera_model": meta["camera_model"], "flash_tag": meta["flash"]}
    row |= {"width": x.shape[1], "height": x.shape[0], "blur": image.blur(x), "phash": image.average_hash(x)}
    if faces:
        row["faces"] = [{"score": s, "embedding": v} for s, v in faces.found(x)]
    if jpeg:
        row["jpeg"] = jpeg_.encode(image.fitted(x, SIDE))
    return row


def _framed(rows: list[dict]) -> pd.DataFrame:
    frame = pd.DataFrame([dict.fromkeys(_NAMES) | r for r in rows], columns=_NAMES)
    return frame.astype({c: "Int64" for c in ("flash_tag", "width", "height", "phash")} | {c: "float64" for c in ("gps_lat", "gps_lon", "blur")})


def decode(files: DataFrame, decoders: dict[str, Callable[[bytes], np.ndarray]] | None = None, tools: Tools | None = None, faces: Faces | None = None, jpeg: bool = False) -> DataFrame:
    """Typed rows of files (file, abs_path): capture metadata, size, blur, hash, labels; ``error`` where a file can't be read.

    Pictures go through Spark's image reader, which tells JPEG, PNG, TIFF and BMP files by their content, in scans of
    ``SCAN`` files; their paths come to the driver, which that reader needs. Videos and HEIC pictures give a frame by
    the ``tools``, RAW ones go through the rawpy library if that is installed. ``decoders``, by kind (image, raw, heic, video), turn a file's bytes into
    an RGB array instead. Only still pictures are turned by their Exif orientation. ``faces`` adds score and vector of
    each face, ``jpeg`` the picture within ``SIDE`` pixels to send to a service. A null or doubled path gives a row each.
    """
    spark, decoders, tools = files.sparkSession, decoders or {}, tools or Tools()

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for origin, h, w, n, data in zip(*(b[c] for c in ("origin", "height", "width", "channels", "data")), strict=True):
                path = unquote(urlsplit(origin).path) if origin.startswith("file:") else origin
                row = {"abs_path": path}
                try:
                    if h <= 0:
                        raise ValueError("no picture of a known kind")
                    head = _open(path, HEAD)
                    head = head if len(head) < HEAD or head[:2] == b"\xff\xd8" else _open(path)
                    row |= _looked(_pixels(h, w, n, data), read_exif(head), True, faces, jpeg)
                except Exception as e:
                    row["error"] = f"unreadable: {e}"
                out.append(row)
            yield _framed(out)

    def opened(path: str, kind: str) -> dict:
        if kind in decoders:
            data = _open(path)
            return _looked(decoders[kind](data), read_exif(data), kind == "image", faces, jpeg)
        if kind == "video" and not (tools.frames and tools.probe) or kind == "heic" and not tools.frames:
            raise ValueError(f"no tool for {kind} files")
        if kind == "video":
            text = tools.describe(path)
            try:
                seconds = float(json.loads(text or "{}")["format"]["duration"])
            except (ValueError, KeyError, TypeError):
                seconds = None
            return _looked(image.read_bmp(tools.frame(path, seconds)), read_exif(b""), False, faces, jpeg) | {"probe": text or "{}"}
        if kind == "heic":
            return _looked(image.read_bmp(tools.frame(path, None)), read_exif(_open(path)), False, faces, jpeg)
        data = _open(path)
        return _looked(_raw(data), read_exif(data), False, faces, jpeg)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, kind in zip(b["abs_path"], b["media_type"], strict=True):
                try:
                    row = {"abs_path": path} | opened(path, kind)
                except Exception as e:
                    row = {"abs_path": path, "error": f"unreadable: {e}"}
                yield _framed([row])

    own = files.select("file", "abs_path", media.media_kind(F.col("file")).alias("media_type"))
    there = F.col("mtime") > 0 if "mtime" in files.columns else F.lit(True)
    scan = (F.col("media_type") == "image") & F.lit("image" not in decoders)
    paths = sorted({r["abs_path"] for r in files.withColumn("media_type", media.media_kind(F.col("file"))).where(scan & there & F.col("abs_path").isNotNull()).select("abs_path").collect()})
    rows = own.where(~scan).select("abs_path", "media_type").distinct().mapInPandas(read, _OUT)
    for lo in range(0, len(paths), SCAN):
        pictures = spark.read.format("image").load(paths[lo : lo + SCAN]).select("image.origin", "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")
        rows = rows.unionByName(pictures.mapInPandas(scanned, _OUT))
    rows = own.join(rows, "abs_path", "left").drop("abs_path")
    rows = rows.withColumn("error", F.coalesce("error", F.when(F.col("width").isNull(), "unreadable: no such file")))
    held = F.when(F.col("probe").isNotNull(), parsers.container_metadata(F.col("probe")))
    place = parsers.iso6709(held["location"])
    rows = rows.withColumns({"duration": held["duration"], "date_taken": F.coalesce(held["creation_time"], "date_taken"), "gps_lat": F.coalesce(place["lat"], "gps_lat"), "gps_lon": F.coalesce(place["lon"], "gps_lon")}).drop("probe")
    ok = F.col("error").isNull()
    labels = {
        "camera": media.camera(F.col("camera_make"), F.col("camera_model")), "resolution": media.resolution(F.col("width"), F.col("height")), "orientation": media.orientation(F.col("width"), F.col("height")),
        "flash": media.flash(F.col("flash_tag")), "is_screenshot": media.screenshot(F.col("media_type"), F.col("camera_make"), F.col("camera_model")),
    }
    return rows.withColumns({k: F.when(ok, v) for k, v in labels.items()})
