"""Tables written in the shared folder, to cut lineage so that a lost executor never costs a whole plan."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset a local master gets a folder under the system's temp folder, and any other master an
    error, since a machine-local folder would be lost with its machine.
    """
    base = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {_SETTING} to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), f"prismlake-{os.getuid()}")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/prismlake/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"


def delete(spark: SparkSession, *paths: str) -> None:
    """Remove paths of any file system that Spark knows; missing ones are fine."""
    for text in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(text)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Writes tables to the shared folder and forgets those that are done with.

    ``keep`` returns the table reread from Parquet; ``drop`` deletes what ``keep`` returned. Tables that a result
    still reads must stay until the caller has consumed the result, so they are left to the owner of the folder.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag, self.paths = spark, tag, {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = new_path(self.spark, self.tag)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            if id(df) in self.paths:
                delete(self.spark, self.paths.pop(id(df))[1])

    def only(self, *dfs: DataFrame) -> None:
        """Drop all tables but these: those that a result still reads."""
        held = {id(df) for df in dfs}
        self.drop(*(df for df, _ in list(self.paths.values()) if id(df) not in held))
