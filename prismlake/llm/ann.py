"""Approximate nearest neighbours: a robust-pruned directed graph for each shard, searched by beam."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from prismlake.llm.embed_dedup import usable
from prismlake.plans.scratch import Scratch

#: Edges of a node, beams of building and searching, and the relaxation of the second pruning pass.
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 32, 64, 160, 1.2
#: Shards at least, and rows of one at most.
SHARDS, SHARD_ROWS = 6, 200_000
#: Queries that are searched in lockstep, marks of what they have seen at most, and points that each opens at a time.
TOGETHER, MARKS, OPEN = 512, 1 << 26, 4


class Graph:
    """A directed graph over rows of x (float32); greedy searches propose neighbours, pruning keeps diverse ones."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 3):
        self.x, self.degree, self.sq = x, degree, np.einsum("ij,ij->i", x, x)
        n = len(x)
        self.out = np.full((n, degree), -1, "i4")
        centre = x.mean(0) if n else np.zeros(x.shape[1])
        self.entry = int(np.argmin(self.sq - 2 * (x @ centre))) if n else -1
        order = np.random.default_rng(seed).permutation(n)
        order = np.concatenate([[self.entry], order[order != self.entry]]).astype("i4") if n else order
        for a in (1.0, alpha):
            done = 1 if a == 1.0 else n
            at = 1 if a == 1.0 else 0
            while at < n:
                step = min(TOGETHER, max(1, done)) if a == 1.0 else TOGETHER
                self._insert(order[at : at + step], beam, a)
                at += step
                done += step

    def _near(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances, less the query's own square, of rows ids (b, k) to queries (b, d); -1 gives infinity."""
        d = self.sq[ids] - 2 * (self.x[ids] @ q[:, :, None])[:, :, 0]
        return np.where(ids < 0, np.inf, d)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam of each query: ids (b, beam), -1 where there are fewer, and their distances, nearest first."""
        step = max(1, MARKS // max(1, len(self.x)))
        if len(q) > step:
            parts = [self.search(q[lo : lo + step], beam) for lo in range(0, len(q), step)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        b = len(q)
        ids, far = np.full((b, beam), -1, "i4"), np.full((b, beam), np.inf, "f4")
        ids[:, 0] = self.entry
        far[:, 0] = self._near(q, ids[:, :1])[:, 0]
        seen = np.zeros((b, len(self.x) + 1), bool)  # the last column stands for none
        seen[:, [self.entry, -1]] = True
        shut = ids < 0
        rows = np.arange(b)
        while len(rows):
            pick = np.argsort(shut[rows], 1, kind="stable")[:, :OPEN]
            node = np.where(np.take_along_axis(shut[rows], pick, 1), -1, np.take_along_axis(ids[rows], pick, 1))
            shut[rows[:, None], pick] = True
            new = np.where(node[:, :, None] < 0, -1, self.out[node]).reshape(len(rows), -1)
            new = np.where(seen[rows[:, None], new], -1, new)
            at, place = np.nonzero(new >= 0)
            one = np.full((len(rows), new.shape[1]), np.inf, "f4")
            got = new[at, place]
            first = np.unique(at * np.int64(len(self.x)) + got, return_index=True)[1]  # points that two of them lead to
            at, place, got = at[first], place[first], got[first]
            seen[rows[at], got] = True
            one[at, place] = self.sq[got] - 2 * np.einsum("kd,kd->k", self.x[got], q[rows[at]])
            all_ids, all_far = np.concatenate([ids[rows], new], 1), np.concatenate([far[rows], one], 1)
            all_shut = np.concatenate([shut[rows], np.isinf(one)], 1)
            keep = np.argsort(all_far, 1, kind="stable")[:, :beam]
            far[rows] = np.take_along_axis(all_far, keep, 1)
            ids[rows] = np.where(np.isinf(far[rows]), -1, np.take_along_axis(all_ids, keep, 1))
            shut[rows] = np.take_along_axis(all_shut, keep, 1) | (ids[rows] < 0)
            rows = rows[~shut[rows].all(1)]
        return ids, far

    def _prune(self, nodes: np.ndarray, cand: np.ndarray, alpha: float) -> np.ndarray:
        """At most ``degree`` of each node's candidates: nearest first, without those nearer to a kept one (by alpha)."""
        cand = np.where(cand == nodes[:, None], -1, cand)
        order = np.argsort(cand, 1, kind="stable")
        cand = np.take_along_axis(cand, order, 1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        own = self._near(self.x[nodes], cand) + self.sq[nodes][:, None]
        vec, square = self.x[cand], self.sq[cand]
        out, left = np.full((len(nodes), self.degree), -1, "i4"), own.copy()
        row = np.arange(len(nodes))
        for k in range(self.degree):
            best = left.argmin(1)
            live = np.isfinite(left[row, best])
            if not live.any():
                break
            out[live, k] = cand[row, best][live]
            chosen = vec[row, best]
            between = square + np.einsum("bd,bd->b", chosen, chosen)[:, None] - 2 * (vec @ chosen[:, :, None])[:, :, 0]
            left[alpha * alpha * between <= own] = np.inf
            left[row, best] = np.inf
        return out

    def _insert(self, nodes: np.ndarray, beam: int, alpha: float) -> None:
        found, _ = self.search(self.x[nodes], beam)
        self.out[nodes] = self._prune(nodes, np.concatenate([found, self.out[nodes]], 1), alpha)
        src, dst = np.repeat(nodes, self.degree), self.out[nodes].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        heads, start, size = np.unique(dst, return_index=True, return_counts=True)
        held = (self.out[heads] >= 0).sum(1)
        room = held + size <= self.degree  # these take the new edges as they are, but those they have
        of = np.repeat(np.arange(len(heads)), size)
        new = room[of] & (self.out[dst] != src[:, None]).all(1)
        of, which = of[new], src[new]
        self.out[heads[of], held[of] + np.arange(len(of)) - np.searchsorted(of, of)] = which
        heads, start, size = heads[~room], start[~room], size[~room]
        order = np.argsort(size, kind="stable")
        heads, start, size = heads[order], start[order], size[order]
        for lo in range(0, len(heads), TOGETHER):
            h, s, c = heads[lo : lo + TOGETHER], start[lo : lo + TOGETHER], size[lo : lo + TOGETHER]
            most = int(c.max())
            extra = np.full((len(h), most), -1, "i4")
            at = np.arange(most)[None, :] < c[:, None]
            extra[at] = src[np.concatenate([np.arange(a, a + n) for a, n in zip(s, c, strict=True)])]
            self.out[h] = self._prune(h, np.concatenate([self.out[h], extra], 1), alpha)


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with one more component that makes all as long as the longest: nearest is then largest inner product."""
    rest = np.sqrt(np.maximum(0, longest * longest - np.einsum("ij,ij->i", x, x)))
    return np.concatenate([x, rest[:, None]], 1).astype("f4")


def _alike(x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """A row of each different row of x, and where the ids of each one's rows start (and end), with those ids, smallest first."""
    x = np.ascontiguousarray(x)
    _, first, which = np.unique(x.view(f"V{x.itemsize * x.shape[1]}").ravel(), return_index=True, return_inverse=True)
    order = np.lexsort([ids, which])
    return first, (np.searchsorted(which[order], np.arange(len(first) + 1)), ids[order])


def _spread(a: np.ndarray, b: np.ndarray, lists: tuple[np.ndarray, np.ndarray], most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a with each entry (the first ``most``) of b's list."""
    start, held = lists
    n = start[b + 1] - start[b]
    n = n if most is None else np.minimum(n, most)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(a, n), held[np.repeat(start[b], n) + at]


def _dealt(spark: SparkSession, count: int) -> DataFrame:
    """(shard, deal): numbers that Spark's hash deals to as many tasks as there are shards, one each."""
    n = F.pmod(F.hash("deal"), F.lit(count))
    return spark.range(24 * count + 100).select(F.col("id").alias("deal")).groupBy(n.alias("shard")).agg(F.min("deal").alias("deal"))


def nearest(table: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", shards: int | None = None, degree: int = DEGREE, beam: int = SEARCH_BEAM, build_beam: int = BUILD_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k rows of table with the largest inner products, those of its own id left out.

    Every usable row of table is in one of the shards (by hash of its id), which have a graph each. Each shard's
    graph is searched for every query, in blocks of queries. A graph has one point for each different vector, as
    pruning would cut all copies but one off; found points give the smallest ids of their rows until there are k. Scores are exact inner products of the original
    vectors in double precision, ties go to smaller ids. Vectors that are null, zero or hold null or non-finite
    components, and null ids, take no part; neither do vectors of other lengths than most have. Repeated rows are
    found as often as they occur; queries that repeat an id and its vector are asked once, those that give one id
    several vectors are asked and ranked each by itself. With k or fewer candidates all come back; empty tables give
    empty results.
    """
    spark, scratch = table.sparkSession, Scratch(table.sparkSession, "nearest")

    def ready(df: DataFrame) -> DataFrame:
        v = F.col(vector)
        return df.where(usable(v) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), v.cast("array<double>").alias("vector"))

    rows = scratch.keep(ready(table).withColumns({"w": F.size("vector"), "top": F.array_max(F.transform("vector", F.abs))}))
    top = F.col("top")
    length = F.least(top * F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + (x / top) * (x / top))), F.lit(sys.float_info.max))
    widths = rows.groupBy("w").agg(F.count("*").alias("n"), F.max(length).alias("longest")).orderBy(F.desc("n"), "w").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if widths is None:
        return spark.createDataFrame([], schema)
    width, longest = widths["w"], float(widths["longest"])
    count = shards or max(SHARDS, -(-widths["n"] // SHARD_ROWS))
    shard = F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
    asked = ready(queries).where(F.size("vector") == width).groupBy("id", F.xxhash64("vector").alias("which")).agg(F.first("vector").alias("vector"))
    every = asked.select(F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("shard"), F.lit(True).alias("asks"), "id", "which", "vector")
    both = rows.where(F.col("w") == width).select(shard.alias("shard"), F.lit(False).alias("asks"), "id", F.lit(0).cast("long").alias("which"), "vector").unionByName(every)
    deal = scratch.keep(_dealt(spark, count))
    both = both.join(F.broadcast(deal) if count <= 100_000 else deal, "shard", "left").withColumn("deal", F.coalesce("deal", "shard"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of whole shards, each shard's own rows before its queries."""
        own, at, graph = [], None, None

        def build():
            ids = np.concatenate([i for i, _ in own])
            x = np.concatenate([v for _, v in own]) + 0.0
            first, members = _alike(x, ids)
            lifted = _lifted(x[first] / longest, 1.0)
            node, vectors = _alike(lifted, np.arange(len(first)))
            spare = int(np.unique(ids, return_counts=True)[1].max())
            return members, x[first], vectors, spare, Graph(lifted[node], degree, build_beam)

        for batch in batches:
            for (s, asks), part in batch.groupby(["shard", "asks"], sort=True):
                if s != at:
                    own, at, graph = [], s, None
                ids, which, x = part["id"].to_numpy(), part["which"].to_numpy(), np.stack(part.vector.to_numpy()).astype("f8")
                if not asks:
                    own.append((ids, x))
                    continue
                if not own:
                    continue
                graph = graph or build()
                yield from answer(ids, which, x, *graph)

    def answer(ids, which, x, members, vectors, points, spare, graph):
        """A point of the graph stands for vectors, and a vector for the ids of its rows; ``spare`` rows of one may be the query's own."""
        for lo in range(0, len(ids), TOGETHER):
            q = x[lo : lo + TOGETHER]
            hit, _ = graph.search(np.concatenate([q / np.abs(q).max(1, keepdims=True), np.zeros((len(q), 1))], 1).astype("f4"), max(beam, 2 * k))
            a, b = np.nonzero(hit >= 0)
            a, b = _spread(a, hit[a, b], points)
            score = np.einsum("ij,ij->i", q[a], vectors[b])
            order = np.lexsort([-score, a])
            a, b, score = a[order], b[order], score[order]
            rows = np.cumsum(np.diff(members[0])[b])
            start = np.searchsorted(a, a)
            full = np.flatnonzero(rows - np.where(start > 0, rows[start - 1], 0) >= k + spare)
            least = np.full(len(q), -np.inf)
            least[a[full[::-1]]] = score[full[::-1]]
            fit = score >= least[a]
            score = score[fit]
            at, b = _spread(np.flatnonzero(fit), b[fit], members, k + spare)
            a, score = a[at], score[np.searchsorted(np.flatnonzero(fit), at)]
            fit = b != ids[lo + a]
            a, b, score = a[fit], b[fit], score[fit]
            order = np.lexsort([b, -score, a])
            a, b, score = a[order], b[order], score[order]
            place = np.arange(len(a)) - np.searchsorted(a, a)
            top = place < k
            yield pd.DataFrame({"query_id": ids[lo + a[top]], "which": which[lo + a[top]], "vec_id": b[top], "score": score[top]})

    found = both.repartition(count, "deal").sortWithinPartitions("shard", "asks").mapInPandas(run, "query_id long, which long, vec_id long, score double")
    order = Window.partitionBy("query_id", "which").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(vec_id), "score")


def op8_beam_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(table, table.where(F.col("vec_id") % 20 == 0))
