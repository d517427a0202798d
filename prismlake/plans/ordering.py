"""A global, gapless row order without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from prismlake.plans.memory import local_table
from prismlake.plans.scratch import Scratch


def ranked(df: DataFrame, keys: list[str], scratch: Scratch, rank: str = "rank", running: dict[str, str] | None = None) -> DataFrame:
    """df with ``rank`` (from 0) by keys, nulls first, and for each ``running`` {out: column} the sum over all rows before.

    Rows are range-partitioned and sorted; only one (count, sums) row for each partition comes to the driver. Rows
    with equal keys are interchangeable, so give keys that tell apart all rows that differ.
    """
    running, spark = running or {}, df.sparkSession
    at = "__at"
    kept = scratch.keep(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(at), 33)
    sums = [F.sum(F.coalesce(F.col(c).cast("long"), F.lit(0))).alias(f"s{i}") for i, c in enumerate(running.values())]
    rows, starts, total = kept.groupBy(part.alias("p")).agg(F.count("*").alias("n"), *sums).orderBy("p").collect(), [], [0] * (1 + len(sums))
    for r in rows:
        starts.append((r["p"], *total))
        total = [t + x for t, x in zip(total, r[1:], strict=True)]
    names = ["__n", *(f"__{o}" for o in running)]
    first = local_table(spark, starts, "__p long, " + ", ".join(f"{n} long" for n in names))  # a row for each partition
    out = kept.withColumn("__p", part).join(F.broadcast(first), "__p")
    if running:
        from pyspark.sql import Window

        before = Window.partitionBy("__p").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        for o, c in running.items():
            out = out.withColumn(o, F.col(f"__{o}") + F.coalesce(F.sum(F.coalesce(F.col(c).cast("long"), F.lit(0))).over(before), F.lit(0)))
    return out.withColumn(rank, F.col("__n") + F.col(at).bitwiseAND((1 << 33) - 1)).drop("__p", at, *names)
