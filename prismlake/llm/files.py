"""Files that tasks write and read themselves, on any file system pyarrow knows; and ranges of rows for them."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyarrow import NativeFile, fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from prismlake.plans.ordering import ranked
from prismlake.plans.scratch import Scratch


def write_whole(folder: str, name: str, data: list[bytes]) -> None:
    """Write folder/name through a temporary name of this attempt only: readers see the whole file or none."""
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(f"{root}/_temporary", recursive=True)
    aside = f"{root}/_temporary/{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(aside, compression=None) as out:
        for part in data:
            out.write(part)
    store.move(aside, f"{root}/{name}")


def read_whole(folder: str, name: str) -> bytes:
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{root}/{name}", compression=None) as f:
        return f.read()


def open_whole(folder: str, name: str) -> NativeFile:
    """The file, to be read from any place."""
    store, root = fs.FileSystem.from_uri(folder)
    return store.open_input_file(f"{root}/{name}")


def range_starts(rows: DataFrame, keys: list[str], size: str, each: int, scratch: Scratch) -> list[int]:
    """First value of keys[0] of each run of the order by keys that holds about ``each`` of size; rows of a value stay together.

    Depends on the rows alone, so reruns cut alike. One number for each run comes to the driver: 8 bytes for each
    ``each`` of size, 64 MB for 100 TB in runs of 12 MB.
    """
    order = ranked(rows, keys, scratch, running={"before": size})
    found = order.groupBy(F.floor(F.col("before") / each).alias("run")).agg(F.min(keys[0]).alias("first")).where(F.col("first").isNotNull()).orderBy("run").collect()
    return sorted({r["first"] for r in found[1:]})


def in_range(spark: SparkSession, starts: list[int], value: Column) -> Column:
    """Number of the range of a value; null is in range 0. The starts are broadcast, once to each executor."""
    held = spark.sparkContext.broadcast(np.array(starts, "i8"))

    @F.pandas_udf("int")
    def find(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(held.value, x.to_numpy("i8"), side="right").astype("i4"))

    return F.when(value.isNull(), F.lit(0)).otherwise(find(F.coalesce(value, F.lit(0))))
