"""Connected components by alternating star contractions, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from prismlake.plans.scratch import Scratch


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", tag: str = "components", scratch: Scratch | None = None) -> DataFrame:
    """(node, root) for each node that has a link to another one; root is the smallest node it reaches.

    Links point from the larger to the smaller node. A round first points every link at the smallest neighbour of
    its target, then moves the other targets of a node onto its smallest one; both keep the components, and the
    rounds needed grow with the logarithm of the longest path. Nothing but a count and a checksum comes to the
    driver. ``scratch`` holds the table that the result reads. Rows with a null end and links of a node with itself are dropped; no links give an empty result.
    """
    scratch = scratch or Scratch(edges.sparkSession, tag)
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    now = scratch.keep(edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    seen = _digest(now)
    while seen[0]:
        low = now.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("w"))
        far = now.join(low, "v", "left").select("u", F.coalesce("w", "v").alias("v")).distinct()
        least = far.groupBy("u").agg(F.min("v").alias("m"))
        near = far.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        following = scratch.keep(near.distinct())
        scratch.drop(now)
        now, before = following, seen
        seen = _digest(now)
        if seen == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
