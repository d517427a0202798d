"""Hilbert-curve sharding: several metadata dimensions, one curve, runs of equal row counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from prismlake.plans.ordering import ranked
from prismlake.plans.scratch import Scratch

#: Steps for each doubling of a number, in the histogram that finds quantiles.
_STEPS = 1024


def hilbert_index(codes: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of codes (n, d), whole numbers below 2**bits; d * bits <= 62."""
    x = [c.astype(np.int64) for c in np.asarray(codes).T]
    d, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(d):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & low)
            x[i] = x[i] ^ swap
            x[0] = x[0] ^ np.where(hit, low, swap) if i else x[0] ^ np.where(hit, low, 0)
        q >>= 1
    for i in range(1, d):
        x[i] = x[i] ^ x[i - 1]
    turn, q = np.zeros_like(x[0]), top
    while q > 1:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            out = (out << 1) | (((c ^ turn) >> b) & 1)
    return out


def _step(value: Column, least: int) -> Column:
    """A whole number that grows with the value: equal for values closer than a part in _STEPS of their distance to the least."""
    return F.floor(F.log2(value.cast("double") - F.lit(float(least)) + 1) * _STEPS).cast("int")


def hilbert_order(df: DataFrame, numbers: list[str], words: list[str], bits: int, scratch: Scratch, order: str = "hilbert") -> DataFrame:
    """df with its place on the curve through the quantiles of ``numbers`` and the hashes of ``words``.

    Quantiles come from an exact histogram of at most 64 * _STEPS cells a dimension over all rows, so reruns agree.
    Null numbers share the lowest code; null words share one hash.
    """
    spark, edges, least = df.sparkSession, [], {}
    if numbers:
        least = dict(zip(numbers, df.agg(*(F.min(c) for c in numbers)).first(), strict=True))
    steps = [F.coalesce(_step(F.col(c), least[c] or 0), F.lit(-1)) for c in numbers]
    for step in steps:
        cells = df.groupBy(step.alias("s")).count().orderBy("s").collect()
        at, below = np.array([r["s"] for r in cells], "i8"), np.cumsum([0, *(r["count"] for r in cells)])[:-1]
        part = below * (1 << bits) // max(1, sum(r["count"] for r in cells))
        edges.append(np.array([at[np.searchsorted(part, k)] if (part >= k).any() else 1 << 31 for k in range(1, 1 << bits)], "i8"))
    codes = [*steps, *(F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("\0"))), F.lit(1 << bits)).cast("int") for c in words)]
    held = spark.sparkContext.broadcast(edges)

    @F.pandas_udf("long")
    def place(codes: pd.DataFrame) -> pd.Series:
        x = codes.to_numpy("i8", copy=True)
        for i, e in enumerate(held.value):
            x[:, i] = np.searchsorted(e, x[:, i], side="right")
        return pd.Series(hilbert_index(x, bits))

    return df.withColumn(order, place(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(codes)))))


def cut_runs(df: DataFrame, keys: list[str], shards: int, scratch: Scratch) -> DataFrame:
    """df with ``shard`` and ``slot``: runs of the order by keys, whose row counts differ by one at most."""
    rows = ranked(df, keys, scratch)
    n = df.count()
    q, r = divmod(n, shards)
    rank, head = F.col("rank"), (q + 1) * r
    shard = F.when(rank < head, F.floor(rank / (q + 1))).otherwise(F.floor((rank - head) / max(1, q)) + r)
    first = F.when(F.col("shard") <= r, F.col("shard") * (q + 1)).otherwise(F.col("shard") * q + r)
    return rows.withColumn("shard", shard.cast("int")).withColumn("slot", (rank - first).cast("long")).drop("rank")


def hilbert_shards(docs: DataFrame, shards: int = 24, bits: int = 5, text: str = "text", doc_id: str = "doc_id", words: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """Puts every row of docs into a shard by its place on a Hilbert curve through id, size, and ``words``.

    Returns doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, the words, hilbert, shard (0 to shards - 1;
    counts differ by one at most) and slot (0, 1, ... in each shard). A null text counts as no bytes with CRC 0; a
    null id sorts first; rows that are equal in all columns are interchangeable; an empty table gives an empty
    result. Texts are read once and never shuffled. Other columns of docs are left out.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    body = F.coalesce(F.col(text), F.lit(""))
    names = [f"w{i}" for i in range(len(words))]
    rows = scratch.keep(docs.select(F.col(doc_id).alias("id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), *(F.col(w).cast("string").alias(n) for w, n in zip(words, names, strict=True))))
    placed = hilbert_order(rows, ["id", "size"], names, bits, scratch)
    cut = cut_runs(placed, ["hilbert", "id", "text_crc32", "size", *names], shards, scratch)
    return cut.select(F.col("id").alias(doc_id), "size", "text_crc32", *(F.col(n).alias(w) for n, w in zip(names, words, strict=True)), "hilbert", "shard", "slot")


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hilbert_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
