"""Best-fit packing into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from prismlake.llm.mixing import words
from prismlake.plans.ordering import ranked
from prismlake.plans.scratch import Scratch

#: Permitted lengths, and what a sequence costs besides its length.
LENGTHS, FIXED_COST = (512, 1024, 2048, 4096), 32
#: One task packs so many pieces at most.
PIECES = 20_000


def _least(used: int, lengths: tuple[int, ...], costs: list[float]) -> tuple[float, int]:
    """Cost and length of the cheapest permitted length that holds so much."""
    return min((c, n) for c, n in zip(costs, lengths, strict=True) if n >= used)


def _filled(pieces: list[int], lengths: tuple[int, ...], costs: list[float]) -> tuple[list[int], list[int], list[int]]:
    """Bin by bin: the longest piece left opens the length that costs least a token when it is filled and shrunk.

    Each permitted length is filled on trial, always with the longest pieces left that fit.
    """
    most = lengths[-1]
    left, shorter = [0] * (most + 1), list(range(most + 1))  # pieces left of a length; the longest one left up to a length, by way of steps
    for n in pieces:
        left[n] += 1

    def longest(n: int) -> int:
        to = n
        while to and not left[to]:
            to = shorter[to] if shorter[to] < to else to - 1
        while n > to:
            shorter[n], n = to, shorter[n] if shorter[n] < n else n - 1
        return to

    def fill(opener: int, length: int) -> list[tuple[int, int]]:
        took, room = [(opener, 1)], length - opener
        n = longest(room)
        while n:
            have = min(left[n] - (n == opener), room // n)
            if have:
                took.append((n, have))
                room -= n * have
            n = longest(min(room, n - 1))
        return took

    cheapest = [_least(u, lengths, costs)[0] for u in range(most + 1)]
    start = {n: k for k, n in reversed(list(enumerate(pieces)))}
    bins, offsets, used = [0] * len(pieces), [0] * len(pieces), []
    while n := longest(most):
        best = None
        for c in lengths:
            if c >= n:
                took = fill(n, c)
                total = sum(x * t for x, t in took)
                if best is None or cheapest[total] / total <= best[0]:
                    best = (cheapest[total] / total, total, took)
        at = 0
        for x, t in best[2]:
            left[x] -= t
            for _ in range(t):
                bins[start[x]], offsets[start[x]] = len(used), at
                start[x] += 1
                at += x
        used.append(best[1])
    return bins, offsets, used


def _packed(pieces: list[int], choose) -> tuple[list[int], list[int], list[int]]:
    """Best fit, longest first: the open bin with the least room that holds a piece, or else a new one of the length that ``choose`` gives."""
    bins, offsets, used, room = [], [], [], {}
    free: list[int] = []
    for k, n in enumerate(pieces):
        at = bisect_left(free, n)
        if at < len(free):
            left = free[at]
            b = room[left].pop()
            if not room[left]:
                del room[left], free[at]
        else:
            b, left = len(used), choose(k)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        left -= n
        if left:
            if left not in room:
                insort(free, left)
                room[left] = []
            room[left].append(b)
    return bins, offsets, used


def best_fit(pieces: list[int], lengths: tuple[int, ...], costs: list[float]) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece (sorted, longest first), and the length of each bin.

    Lengths are chosen jointly: each bin gets the one that costs least a token with the pieces still to pack. That is
    compared with best-fit packings that open one length alone (the least longer one for pieces over it); in all of
    them each bin is shrunk to the cheapest length that holds its contents. The packing that costs least is taken,
    so it never costs more than any of a single length.
    """
    best = None
    single = [lambda k, top=top: max(top, next(n for n in lengths if n >= pieces[k])) for top in reversed(lengths)]
    for bins, offsets, used in (_filled(pieces, lengths, costs), *(_packed(pieces, choose) for choose in single)):
        sized = [_least(u, lengths, costs) for u in used]
        total = sum(x for x, _ in sized)
        if best is None or total < best[0]:
            best = (total, bins, offsets, [c for _, c in sized])
    return best[1:]


def pack(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, fixed_cost: float = FIXED_COST, text: str = "text", doc_id: str = "doc_id", size: Column | None = None, pieces: int = PIECES) -> DataFrame:
    """Where each piece of each row of docs goes: doc_id, piece, start, tokens, bin, length, offset.

    Size: words of the text and one end mark, or ``size``; rows without a positive size have no piece. Sizes over the longest permitted
    length are cut into pieces of that length and a rest. A bin of ``length`` costs that plus ``fixed_cost``. Rows
    are dealt out by their place in the order of (doc_id, size) to as many packers as ``pieces`` needs, so that no
    task grows with the input and reruns agree; bins are numbered within packers as text "packer-number". A null text has the end mark alone; null ids are kept as they
    are; equal rows are packed one by one; an empty table gives an empty result.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "pack")
    lengths = tuple(sorted(set(lengths)))
    most, costs = lengths[-1], [c + fixed_cost for c in lengths]
    n = words(F.col(text)) + 1 if size is None else size.cast("long")
    rows = scratch.keep(docs.select(F.col(doc_id).alias("id"), n.alias("n")).where(F.col("n") > 0))
    parts = rows.agg(F.sum(F.ceil(F.col("n") / most))).first()[0] or 0
    packers = max(1, -(-parts // pieces))
    cut = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / most)))
    cuts = ranked(rows, ["id", "n"], scratch).select("id", "n", "rank", cut.alias("piece"))
    dealt = cuts.select((F.col("rank") % packers).alias("packer"), "rank", "id", F.col("piece").cast("int"), (F.col("piece") * most).alias("start"), F.least(F.lit(most), F.col("n") - F.col("piece") * most).cast("int").alias("tokens"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tokens", "rank", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets, sized = best_fit(rows.tokens.tolist(), lengths, costs)
        number = np.array(bins)
        name = f"{rows.packer.iloc[0]}-"
        return pd.DataFrame({"id": rows["id"], "piece": rows.piece, "start": rows.start, "tokens": rows.tokens, "bin": [f"{name}{b}" for b in bins], "length": np.array(sized, "i4")[number], "offset": np.array(offsets, "i4")})

    kind = dict(rows.dtypes)["id"]
    out = dealt.groupBy("packer").applyInPandas(run, f"id {kind}, piece int, start long, tokens int, bin string, length int, offset int")
    return out.withColumnRenamed("id", doc_id)


def op10_best_fit_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
