"""What keeps Python's share of an executor's memory small, whatever the texts and the number of tables made on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a batch that goes to a Python worker, but for its last row.
BATCH = 2 << 20


def small_batches(spark: SparkSession, most: int = BATCH) -> None:
    """From now on batches to Python workers have about ``most`` bytes at most; a smaller setting of the session stays.

    Without that a batch has up to 10,000 rows or 64 MB, which the executor holds outside its heap, in a buffer that
    doubles as it grows, and the worker once more as Arrow and as objects; neither gives all of it back afterwards.
    """
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_SETTING))
    if not 0 < now <= most:
        spark.conf.set(_SETTING, str(most))


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few rows that the plan holds.

    ``createDataFrame`` of a list is an RDD of pickled rows instead, for which every executor starts a Python daemon
    of another kind, with workers of its own, and keeps them beside those for Arrow.
    """
    fields = to_arrow_schema(StructType.fromDDL(schema))
    columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=fields), schema)
