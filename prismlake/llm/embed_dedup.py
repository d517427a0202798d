"""Embedding near-duplicates by sorted projection passes: random hashes order the vectors, windows of neighbours are compared."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from prismlake.plans.components import connected_components
from prismlake.plans.ordering import ranked
from prismlake.plans.scratch import Scratch

#: Passes of a round, neighbours of a window, hashes of a key and projections that each chooses from.
PASSES, WINDOW, HASHES, CHOICES = 4, 1024, 15, 16
#: Vectors that projections are drawn from; they set the order alone.
ANCHORS = 4096
#: For the count of links: rows of a block, of the chunks of one that are told apart by their balls, and those compared at a time.
BLOCK, CHUNK, TOGETHER = 4096, 1024, 64


def usable(vector: Column) -> Column:
    """True for vectors with a direction: not null, not empty, all components finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vectors: pd.Series) -> np.ndarray:
    """Vectors of one length as rows of length 1, in double precision; large ones don't overflow."""
    x = np.stack(vectors.to_numpy()).astype("f8")
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _hashes(x: np.ndarray, anchors: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Concatenated random hashes: for each of ``HASHES``, on which of ``CHOICES`` random vectors the row is projected furthest.

    The vectors are drawn from the data, so that dense regions, where random directions hardly tell rows apart, are
    cut as often as they have rows.
    """
    key, bits = np.zeros(len(x), "i8"), int(np.log2(CHOICES))
    for _ in range(HASHES):
        own = anchors[rng.choice(len(anchors), CHOICES)]
        key = (key << bits) | (x @ own.T).argmax(1)
    return key


def _keys(points: DataFrame, anchors: dict[int, np.ndarray], turn: int, passes: int, seed: int) -> DataFrame:
    """(pass, label, width, key, node) for each pass of round ``turn``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for width, own in rows.groupby(rows.vector.map(len)):
                x = unit(own.vector)
                for k in range(turn * passes, (turn + 1) * passes):
                    rng = np.random.default_rng([seed, k, width])
                    from_ = anchors[width] if width in anchors else rng.standard_normal((CHOICES, width))
                    yield own[["label", "node"]].assign(width=np.int32(width), key=_hashes(x, from_, rng), **{"pass": k})[["pass", "label", "width", "key", "node"]]

    kind = dict(points.dtypes)["label"]
    return points.select("label", "node", "vector").mapInPandas(run, f"pass int, label {kind}, width int, key long, node long")


def _window_links(least: float):
    """(a, b) for the rows of one window: a link of each row that has one to the first of its component."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"a": [], "b": []}, dtype="int64")]
        for _, own in rows.groupby(["pass", "label", "width"], sort=False):
            x, node = unit(own.vector), own.node.to_numpy()
            a, b = np.nonzero(x @ x.T >= least)
            fit = a < b
            root = _join(np.arange(len(own)), a[fit], b[fit])
            got = np.flatnonzero(root != np.arange(len(own)))
            out.append(pd.DataFrame({"a": node[got], "b": node[root[got]]}))
        return pd.concat(out).astype("int64")

    return run


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Root (smallest position) of each position after the links a, b."""
    while (apart := root[a] != root[b]).any():
        a, b = a[apart], b[apart]
        up = root.copy()
        np.minimum.at(up, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (up != up[up]).any():
            up = up[up]
        root = up[root]
    return root


def _counts(least: float, chunk: int, together: int):
    """For the rows of two blocks, or of one: with how many vectors (copies counted) of their component each links.

    Chunks whose balls are too far apart for a link are not compared, nor those all of whose pairs must link.
    """
    reach = np.sqrt(max(0.0, 2 - 2 * least))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        i, j, out = rows.i.iloc[0], rows.j.iloc[0], [pd.DataFrame({"node": [], "links": []}, dtype="int64")]
        for _, own in rows.groupby("root", sort=False):
            own = own.sort_values("rank")
            x, node, n = unit(own.vector), own.node.to_numpy(), own.n.to_numpy()
            middle = int((own.block == i).sum()) if i != j else 0
            spans = [(s, min(s + chunk, e)) for lo, e in ((0, middle), (middle, len(own))) for s in range(lo, e, chunk)]
            centres = np.stack([x[s:e].mean(0) for s, e in spans])
            radii = np.array([np.sqrt(((x[s:e] - c) ** 2).sum(1).max()) for (s, e), c in zip(spans, centres, strict=True)])
            links = np.zeros(len(own), "i8")
            for p, (s, e) in enumerate(spans):
                apart, wide = np.sqrt(((centres - centres[p]) ** 2).sum(1)), radii + radii[p]
                for q, (lo, hi) in enumerate(spans):
                    if q < p or apart[q] - wide[q] > reach + 1e-6 or (i != j and (s < middle) == (lo < middle)):
                        continue
                    if p != q and apart[q] + wide[q] < reach - 1e-6:
                        links[s:e] += n[lo:hi].sum()
                        links[lo:hi] += n[s:e].sum()
                        continue
                    for at in range(s, e, together):
                        a, b = np.nonzero(x[at : min(at + together, e)] @ x[lo:hi].T >= least)
                        a, b = a + at, b + lo
                        if p == q:
                            a, b = a[a < b], b[a < b]
                        links += np.bincount(a, n[b], len(own)).astype("i8") + np.bincount(b, n[a], len(own)).astype("i8")
            out.append(pd.DataFrame({"node": node, "links": links}))
        return pd.concat(out).astype("int64")

    return run


def near_vectors(table: DataFrame, least: float = 0.98, window: int = WINDOW, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", seed: int = 7, passes: int = PASSES, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of table.

    Vectors with equal, non-null labels link at a cosine of ``least`` or more, in double precision. Equal vectors
    are one point. A pass orders the points of each label by their concatenated hashes and cuts the order into
    windows at a random place; all pairs of a window are compared, and links join components. Rounds of ``passes``
    go on until one joins nothing more (two at least), so labels that are dense for their size get as many passes
    as they need, and the last round measures that they have. A label with no more points than a window has is
    compared whole.

    Links are then counted within the components, all pairs in blocks but those of ``chunk`` rows whose balls say
    that none or all of them link, so only a pair whose ends no chain of found links joins can be missed. That count
    grows with the square of a component's different vectors.

    Vectors that are null, empty, zero or hold null or non-finite components, null labels and null ids link with
    nothing (n_links 0, component_id the own id, kept true; null ids: component_id and kept null). Vectors of
    different lengths don't link. Rows that repeat an id and its vector are copies of one another; rows that give
    one id several vectors go by their own vector each. An empty table gives an empty result. At most ``ANCHORS``
    vectors, those with the smallest hashes, come to the driver.
    """
    scratch = Scratch(table.sparkSession, "vectors")
    v = F.col(vector)
    rows = table.select(F.col(vec_id).cast("long").alias("id"), v.alias("vector"), F.col(label).alias("label"), (usable(v) & F.col(label).isNotNull() & F.col(vec_id).isNotNull()).alias("ok"))
    rows = rows.withColumn("k1", F.xxhash64("vector")).withColumn("k2", F.xxhash64(F.lit(1), "vector", F.lit(2)))
    good, same = rows.where("ok"), ["label", "k1", "k2"]
    first = good.groupBy(*same).agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("vector").alias("vector"))
    points = scratch.keep(first.withColumn("node", F.monotonically_increasing_id()))
    drawn: dict[int, list] = {}
    for r in points.orderBy("k1", "k2", "label").select("vector").limit(ANCHORS).collect():
        drawn.setdefault(len(r["vector"]), []).append(r["vector"])
    anchors = {w: unit(pd.Series(x)) for w, x in drawn.items()}
    vectors = points.select("node", "vector", "n")

    roots, linked = None, -1
    for turn in count():
        order = ranked(_keys(points, anchors, turn, passes, seed), ["pass", "label", "width", "key", "node"], scratch)
        cut = int(np.random.default_rng([seed, turn]).integers(window))
        tiles = order.select("node", "pass", "label", "width", F.floor((F.col("rank") + cut) / window).alias("tile"))
        met = tiles.join(vectors, "node").select("tile", "pass", "label", "width", "node", "vector").groupBy("tile").applyInPandas(_window_links(least), "a long, b long")
        met = met.distinct() if roots is None else met.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        following = scratch.keep(connected_components(met, scratch=scratch))
        if roots is not None:
            scratch.drop(roots)
        roots, before, linked = following, linked, following.where("node != root").count()
        if turn and linked == before:
            break

    order = ranked(roots, ["root", "node"], scratch)
    placed = scratch.keep(order.withColumn("block", F.floor(F.col("rank") / block)))
    spans = placed.groupBy("root").agg(F.min("block").alias("from"), F.max("block").alias("to"))
    grid = placed.join(spans, "root").select("root", "rank", "block", "node", F.explode(F.sequence("from", "to")).alias("other"))
    grid = grid.select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    near = grid.join(vectors, "node").select("i", "j", "root", "rank", "block", "node", "n", "vector").groupBy("i", "j").applyInPandas(_counts(least, chunk, TOGETHER), "node long, links long")
    links = near.groupBy("node").agg(F.sum("links").alias("links"))
    known = points.select("node", "id", "n", *same).join(roots, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = scratch.keep(known)
    scratch.only(known)
    known = known.join(known.groupBy("root").agg(F.min("id").alias("component")), "root")
    of = known.select(F.col("label").alias("l"), F.col("k1").alias("x1"), F.col("k2").alias("x2"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component")
    out = rows.join(of, F.col("ok") & (F.col("label") == F.col("l")) & (F.col("k1") == F.col("x1")) & (F.col("k2") == F.col("x2")), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
