"""Faces of a picture by two models, and the reference people they are compared with."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from prismlake.functions import image

# File names of the models.
DETECTOR, EMBEDDER = "yunet.onnx", "sface.onnx"
#: Kinds of files that reference photos are read from.
PHOTOS = ("jpg", "jpeg", "png", "bmp")
_log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Faces:
    """detect: a (1, 3, h, w) tensor to the twelve outputs of ``image.detections``; embed: such a tensor of a crop to a vector."""

    detect: Callable[[np.ndarray], list[np.ndarray]]
    embed: Callable[[np.ndarray], np.ndarray]

    def found(self, x: np.ndarray) -> list[tuple[float, list[float]]]:
        """Score and unit vector of each face of an RGB image, best score first."""
        square, scale, left, top = image.letterboxed(x)
        out = []
        for row in image.kept(image.detections(self.detect(image.tensor(square)), scale, left, top)):
            crop = image.aligned(x, *image.similarity(row[5:].reshape(5, 2), np.array(image.LANDMARKS)))
            v = np.asarray(self.embed(image.tensor(crop)), "f8").ravel()
            size = np.sqrt(v @ v)
            out.append((float(row[0]), (v / size if size > 0 else v).tolist()))
        return out


@lru_cache(maxsize=4)
def _session(path: str):
    """A worker's session of a model, which its later tasks use too."""
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = 1
    return onnxruntime.InferenceSession(path, options, providers=["CPUExecutionProvider"])


def _run(path: str) -> Callable[[np.ndarray], list[np.ndarray]]:
    def run(x: np.ndarray) -> list[np.ndarray]:
        session = _session(path)
        return session.run(None, {session.get_inputs()[0].name: x})

    return run


def load_faces(folder: str | None) -> Faces | None:
    """The two models of a folder that all executors see; None, and a warning, if one is absent or can't be loaded."""
    paths = [os.path.join(folder or "", name) for name in (DETECTOR, EMBEDDER)]
    try:
        if not folder or not all(map(os.path.isfile, paths)):
            raise ValueError(f"no {DETECTOR} and {EMBEDDER} in {folder}")
        for p in paths:
            _session(p)
    except Exception as e:  # whatever the runtime makes of a bad file
        _log.warning("faces are off: %s", e)
        return None
    embed = _run(paths[1])
    return Faces(_run(paths[0]), lambda x: embed(x)[0])


def reference_people(spark: SparkSession, folder: str, faces: Faces) -> DataFrame:
    """(person, photo, embedding): for each photo in a sub-folder, named as the person, its face with the best score.

    The last one wins among equal scores. People without any face are left out, with a warning; a sub-folder for
    each comes to the driver.
    """
    from prismlake.operators.decode import decode
    from prismlake.sources.walk import media_files

    files = media_files(spark, folder).where(F.size(F.split("file", "/")) == 2)
    files = files.where(F.lower(F.element_at(F.split("file", r"\."), -1)).isin(*PHOTOS))
    seen = decode(files, faces=faces).select(F.split("file", "/").alias("p"), F.col("faces").alias("f"))
    seen = seen.select(F.col("p")[0].alias("person"), F.col("p")[1].alias("photo"), F.array_max(F.transform("f", lambda x, i: F.struct(x["score"], i, x["embedding"]))).alias("best"))
    found = seen.where(F.col("best").isNotNull()).select("person", "photo", F.col("best.embedding").alias("embedding"))
    have = {r["person"] for r in found.select("person").distinct().collect()}
    for name in sorted({e.name for e in os.scandir(folder) if e.is_dir()} - have):
        _log.warning("no face in any photo of %s", name)
    return found
