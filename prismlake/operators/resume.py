"""Incremental runs: what is done already, and where the next rows go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from prismlake.plans.ordering import ranked
from prismlake.plans.scratch import Scratch

#: Rows of an index file.
ROWS = 20_000


def not_done(files: DataFrame, done: DataFrame, key: str = "file") -> DataFrame:
    """Rows of files whose key isn't in done."""
    return files.join(done.select(key).distinct(), key, "left_anti")


def chunk_name(stem: str, number: Column) -> Column:
    return F.format_string(f"{stem.replace('%', '%%')}_%03d.csv", number)


def with_chunks(rows: DataFrame, order: list[str], per_chunk: int = ROWS, start: int = 1, carry: int = 0, stem: str = "index") -> DataFrame:
    """rows with row_no (from 1, by order), chunk and chunk_file; the first chunk has ``carry`` rows already.

    Numbers come from a range partitioning and one count for each partition, not from a single-task sort.
    """
    out = ranked(rows, order, Scratch(rows.sparkSession, "chunks"), rank="row_no").withColumn("row_no", F.col("row_no") + 1)
    chunk = (F.floor((F.col("row_no") - 1 + carry) / per_chunk) + start).cast("int")
    return out.withColumn("chunk", chunk).withColumn("chunk_file", chunk_name(stem, F.col("chunk")))
