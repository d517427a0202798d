"""Sends this package to the executors, for clusters where it is not installed."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import prismlake


def ship(spark: SparkSession) -> None:
    """Once for each application: the package's sources as a zip file that Spark hands to all Python workers."""
    context = spark.sparkContext
    if getattr(context, "_prismlake_sent", False):
        return
    top, data = Path(prismlake.__file__).parent, io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    path = Path(tempfile.mkdtemp()) / "prismlake.zip"
    path.write_bytes(data.getvalue())
    context.addPyFile(str(path))
    context._prismlake_sent = True
