"""Facet counts: how often each value of each dimension occurs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from prismlake.functions.text import trim_unicode


def facets(df: DataFrame, dimensions: Mapping[str, str | Column]) -> DataFrame:
    """(dimension, value, count) by dimension, then count from the largest, then value.

    Values are trimmed; null and empty ones don't count. All dimensions are counted in one pass: each row is
    unpivoted, and partial counts are merged before the shuffle.
    """
    cells = F.array(*(F.struct(F.lit(d).alias("dimension"), trim_unicode((F.col(c) if isinstance(c, str) else c).cast("string")).alias("value")) for d, c in dimensions.items()))
    return df.select(F.explode(cells).alias("c")).select("c.*").where("value <> ''").groupBy("dimension", "value").agg(F.count("*").alias("count")).orderBy("dimension", F.desc("count"), "value")
