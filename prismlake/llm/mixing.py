"""Mixing sources to target weights: hash-threshold histograms, refined in the boundary bucket only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from prismlake.plans.ordering import ranked
from prismlake.plans.scratch import Scratch

#: Hashes have 60 bits, refined by 12 bits a level.
_BITS, _LEVEL = 60, 12
#: So many sources at most go along with each task; more are joined by a shuffle.
_BROADCAST = 100_000


def words(text: Column) -> Column:
    """Words of the text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _small(df: DataFrame) -> DataFrame:
    """df, with a row a source, to go along with each task if it has few rows."""
    return F.broadcast(df) if df.limit(_BROADCAST + 1).count() <= _BROADCAST else df


def shares(sums: DataFrame, weights: tuple[float, ...], share: float, most: float, scratch: Scratch) -> DataFrame:
    """(source, size, target) of sums (source, size): ``share`` of all sizes by weight, none above ``most`` times its size.

    Sources by code point, null last, have the weights, repeated. What is cut off goes to the others by weight: a
    target is the least of its cap and its weight times a level, which rises with each round until no more sources
    reach their caps. Two sums a round come to the driver, whatever the number of sources.
    """
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    order = ranked(sums.withColumn("none", F.col("source").isNull()), ["none", "source"], scratch)
    table = scratch.keep(order.select("source", "size", weight.alias("w"), (F.col("size") * F.lit(float(most))).alias("cap")))
    total, caps, level = table.agg(F.sum("size"), F.sum("cap"), F.sum("w")).first()
    left = min(share * (total or 0), caps or 0.0)
    level, before = left / level if level else 0.0, None
    while before is None or level > before:  # rounding may lower it a little at the end
        full = F.col("w") * F.lit(level) > F.col("cap")
        held, free = table.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("w")))).first()
        level, before = ((left - (held or 0.0)) / free if free else float("inf")), level
    return table.select("source", "size", F.least("cap", F.col("w") * F.lit(level)).alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame, scratch: Scratch) -> DataFrame:
    """For each row (source, copy, budget) of budgets, ``below``: the hashes under it sum to the budget, as near as whole hashes allow.

    rows: source, size, h (0 <= h < 2**60). Level by level, sizes are summed by bucket of the next 12 bits within the
    one bucket where the budget is crossed; a window over at most 4096 buckets finds the next one.
    """
    open_, done = budgets.select("source", "copy", F.col("budget").cast("double").alias("need"), F.lit(0).cast("long").alias("prefix")), None
    sums = F.sum("size").alias("size"), F.min("h").alias("lo"), F.max("h").alias("hi")
    for level in range(1, _BITS // _LEVEL + 1):
        shift = _BITS - level * _LEVEL
        wanted, same = open_.withColumnRenamed("source", "src"), F.col("source").eqNullSafe(F.col("src"))
        cell = F.shiftright("h", shift).alias("cell")
        if level == 1:
            cells = rows.groupBy("source", cell).agg(*sums).join(_small(wanted), same)
        else:
            cells = rows.join(_small(wanted), same & (F.shiftright("h", shift + _LEVEL) == F.col("prefix"))).groupBy("source", "copy", "need", cell).agg(*sums)
        order = Window.partitionBy("source", "copy").orderBy("cell")
        found = cells.withColumn("before", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        found = found.where((F.col("before") < F.col("need")) & (F.col("need") <= F.col("before") + F.col("size")))
        found = scratch.keep(found.select("source", "copy", (F.col("need") - F.col("before")).alias("need"), "cell", "size", "lo", "hi"))
        ended = found.where("lo = hi").select("source", "copy", (F.col("lo") + (F.col("need") * 2 >= F.col("size")).cast("long")).alias("below"))
        done = ended if done is None else done.unionByName(ended)
        open_ = found.where("lo <> hi").select("source", "copy", "need", F.col("cell").alias("prefix"))
        if open_.isEmpty():
            break
    return done


def _plan(rows: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(src, source_size, target, below: a threshold for each copy) of each source of rows (source, size, h)."""
    scratch = Scratch(rows.sparkSession, "mix")
    targets = scratch.keep(shares(rows.groupBy("source").agg(F.sum("size").alias("size")), weights, share, most, scratch))
    copy = F.explode(F.sequence(F.lit(0), F.lit(max(1, int(-(-most // 1))) - 1))).alias("copy")
    budget = F.least(F.col("size").cast("double"), F.greatest(F.lit(0.0), F.col("target") - F.col("copy") * F.col("size")))
    plan = scratch.keep(targets.select("source", "size", "target", copy).withColumn("budget", budget))
    cut = thresholds(rows, plan.where((F.col("budget") > 0) & (F.col("budget") < F.col("size"))), scratch)
    cut = cut.select(F.col("source").alias("s"), F.col("copy").alias("c"), "below")
    below = F.when(F.col("budget") <= 0, F.lit(0).cast("long")).when(F.col("budget") >= F.col("size"), F.lit(1 << _BITS)).otherwise(F.coalesce("below", F.lit(0).cast("long")))
    every = plan.join(cut, F.col("source").eqNullSafe(F.col("s")) & (F.col("copy") == F.col("c")), "left").withColumn("below", below)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("copy", "below"))), lambda x: x["below"])
    table = every.groupBy(F.col("source").alias("src"), F.col("size").alias("source_size"), "target").agg(in_order.alias("below"))
    table = scratch.keep(table)
    scratch.only(table)
    return _small(table)


def _hash(doc_id: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.col(doc_id)), 64 - _BITS)


def _rows(docs: DataFrame, text: str, doc_id: str, source: str, size: Column | None) -> DataFrame:
    n = words(F.col(text)) if size is None else size.cast("long")
    rows = docs.select(F.col(doc_id).alias("id"), F.col(source).alias("source"), n.alias("size"), _hash(doc_id).alias("h"))
    return Scratch(docs.sparkSession, "mix").keep(rows)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, text: str = "text", doc_id: str = "doc_id", source: str = "source", size: Column | None = None) -> DataFrame:
    """How often the mix takes each row of docs: doc_id, source, size, source_size, target, copies and taken (words, repeats counted).

    Size: words of the text, or ``size``. Sources by code point, null last, have the weights, repeated, and share
    ``share`` times all sizes; none gets over ``most`` times its own size (a whole number or less than 1). Row k of
    a source is taken again while its hash is below the threshold of that copy; thresholds of later copies are
    never above those of earlier ones, so mixes are nested. A source comes as near its target as half a row, or
    half the rows that share an id. A null text has size 0; a null source is a source of its own; rows with equal
    ids are taken alike; empty tables give empty results.
    """
    rows = _rows(docs, text, doc_id, source, size)
    out = rows.join(_plan(rows, weights, share, most), F.col("source").eqNullSafe(F.col("src")), "left")
    taken = F.size(F.filter("below", lambda b: b > F.col("h")))
    return out.select(F.col("id").alias(doc_id), F.col("source").alias(source), "size", "source_size", "target", taken.alias("copies"), (taken * F.col("size")).cast("long").alias("taken"))


def copies(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, text: str = "text", doc_id: str = "doc_id", source: str = "source", size: Column | None = None) -> DataFrame:
    """The rows of docs, all their columns, each as often as ``mix`` takes it."""
    plan = _plan(_rows(docs, text, doc_id, source, size), weights, share, most).select(F.col("src").alias("__source"), F.col("below").alias("__below"))
    out = docs.join(plan, F.col(source).eqNullSafe(F.col("__source")))
    again = F.filter("__below", lambda b: b > _hash(doc_id))
    return out.withColumn("__copy", F.explode(again)).select(*(F.col(c) for c in docs.columns))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source")
