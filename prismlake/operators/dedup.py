"""Near-duplicate groups of 64-bit image hashes: an exact banded join, or all pairs in blocks, and connected components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from prismlake.functions.media import hamming
from prismlake.plans.components import connected_components
from prismlake.plans.ordering import ranked
from prismlake.plans.scratch import Scratch

#: Bits of two alike hashes that may differ, as a default; with more than BANDED bands are too short to pay for their shuffle.
THRESHOLD, BANDED = 6, 8
#: Hashes of a block, and those compared with all of another at a time.
BLOCK, TOGETHER = 8192, 256


def _bands(h: Column, threshold: int) -> Column:
    """threshold + 1 disjoint parts of the bits: two hashes within the threshold agree on one at least."""
    n = threshold + 1
    cuts = [64 * i // n for i in range(n + 1)]
    part = lambda lo, hi: F.shiftrightunsigned(h, lo).bitwiseAND((1 << (hi - lo)) - 1 if hi - lo < 64 else -1)
    return F.array(*(part(lo, hi) for lo, hi in zip(cuts, cuts[1:], strict=False)))


def _all_pairs(hashes: DataFrame, threshold: int, links: bool) -> DataFrame:
    """(a, b) of the different hashes of h within the threshold; ``links``: instead, within each block pair, (first of its group, each other one).

    Each two blocks of the order meet in one task, so work grows with the square of the hashes, but no task and no
    broadcast does.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = rows.i.iloc[0], rows.j.iloc[0]
        x, y = (np.sort(rows.h[rows.block == k].to_numpy()) for k in (i, j))
        found = []
        for s in range(0, len(x), TOGETHER):
            p, q = np.nonzero(np.bitwise_count((x[s : s + TOGETHER, None] ^ y[None, :]).view("u8")) <= threshold)
            p, q = x[p + s], y[q]
            found.append(np.stack([p, q], 1)[(p < q) if i == j else (p != q)])
        pairs = np.sort(np.concatenate(found), 1)
        if links and len(pairs):
            at, ends = np.unique(pairs, return_inverse=True)
            root = np.arange(len(at))
            a, b = ends.reshape(-1, 2).T
            while (apart := root[a] != root[b]).any():
                np.minimum.at(root, np.maximum(root[a], root[b])[apart], np.minimum(root[a], root[b])[apart])
                while (root != root[root]).any():
                    root = root[root]
            pairs = np.stack([at[root], at], 1)[root != np.arange(len(at))]
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    scratch = Scratch(hashes.sparkSession, "pairs")
    placed = scratch.keep(ranked(hashes, ["h"], scratch).select("h", F.floor(F.col("rank") / BLOCK).alias("block")))
    last = placed.agg(F.max("block")).first()[0] or 0
    grid = placed.select("h", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).alias("other"))
    return grid.select("h", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).groupBy("i", "j").applyInPandas(run, "a long, b long")


def hash_pairs(hashes: DataFrame, threshold: int = THRESHOLD, key: str = "h", links: bool = False) -> DataFrame:
    """(a, b) of different hashes within the threshold, a < b as signed numbers, each pair once.

    Equal hashes are one first. Up to a threshold of BANDED, hashes meet on an equal band; beyond that bands would
    let through most pairs, and all are compared in blocks. There ``links`` gives fewer pairs that
    make the same groups, not all of them within the threshold. Null hashes take no part.
    """
    one = hashes.where(F.col(key).isNotNull()).select(F.col(key).alias("h")).distinct()
    if threshold > BANDED:
        return _all_pairs(one, threshold, links)
    near = (F.col("a") < F.col("b")) & (hamming(F.col("a"), F.col("b")) <= threshold)
    banded = one.select("h", F.posexplode(_bands(F.col("h"), threshold)).alias("band", "bits"))
    left, right = banded.select(F.col("h").alias("a"), "band", "bits"), banded.select(F.col("h").alias("b"), "band", "bits")
    return left.join(right, ["band", "bits"]).where(near).select("a", "b").distinct()


def duplicate_groups(rows: DataFrame, threshold: int = THRESHOLD, key: str = "h", order: list[str] | None = None, error: str | None = None) -> DataFrame:
    """rows with duplicate_group (from 1, by the first member in ``order``, singletons counted) and group_size.

    Rows with a null hash, or with an ``error``, link with nothing; each is a group of its own.
    """
    scratch = Scratch(rows.sparkSession, "groups")
    placed = scratch.keep(ranked(rows, order or [key], scratch, rank="__rank"))
    usable = F.col(key).isNotNull() if error is None else F.col(key).isNotNull() & F.col(error).isNull()
    first = placed.where(usable).groupBy(F.col(key).alias("__h")).agg(F.min("__rank").alias("__first"))
    at = {c: first.select(F.col("__h").alias(c), F.col("__first").alias(f"f{c}")) for c in "ab"}
    links = hash_pairs(first.select(F.col("__h").alias("h")), threshold, links=True).join(at["a"], "a").join(at["b"], "b").select("fa", "fb")
    roots = connected_components(links, "fa", "fb", tag="groups")
    of = first.join(roots, F.col("__first") == F.col("node"), "left").select("__h", F.coalesce("root", "__first").alias("__root"))
    joined = placed.join(of, usable & (F.col(key) == F.col("__h")), "left").withColumn("__root", F.coalesce("__root", "__rank")).drop("__h")
    sizes = scratch.keep(joined.groupBy("__root").agg(F.count("*").alias("group_size")))
    numbered = ranked(sizes, ["__root"], scratch, rank="__number")
    out = joined.join(numbered, "__root").withColumn("duplicate_group", F.col("__number") + 1)
    return out.drop("__root", "__rank", "__number").select(*rows.columns, "duplicate_group", "group_size")


def shown_group(group: Column, size: Column) -> Column:
    """The group as a cell: empty for singletons."""
    return F.when(size > 1, group.cast("string")).otherwise("")


def group_sizes(rows: DataFrame, group: str) -> DataFrame:
    """rows with the number of rows of their group."""
    return rows.withColumn("group_size", F.count("*").over(Window.partitionBy(group)))
