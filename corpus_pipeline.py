"""Documents to packed sequences: language, near copies, personal data, source mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from prismlake.llm import langid, mixing, near_texts, packing, pii, simhash
from prismlake.plans.memory import small_batches
from prismlake.plans.scratch import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those that are like no language; lang stays as it is."""
    small_batches(spark)
    model = langid.fit(docs, F.col("doc_id").isNotNull() & ~langid.held_out(F.col("doc_id")))
    out = langid.identify(docs.select(COLUMNS), model, prefix="__lang_")
    return out.where(~F.col("__lang_rejected")).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies.

    Groups are those of op3, by fingerprints that meet in the grid over segment counts; texts beyond its two bits, but
    at a Jaccard similarity of 0.8 or more, join them after that.

    Each row counts by itself, whatever its id: rows with a null id, or with one that others have too, go only if
    their text is a copy. Null ids come last; equal ids are told apart by the hash of their text and the other columns.
    """
    small_batches(spark)
    scratch = Scratch(spark, "stage")
    rows = scratch.keep(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("place")))
    alike = scratch.keep(simhash.simhash_groups(rows, doc_id="place").select(F.col("place").alias("id"), "component_id"))
    groups = near_texts.near_text_groups(rows, doc_id="place", groups=alike).withColumnRenamed("id", "place")
    scratch.drop(alike)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "hash", "place"))
    stay = rows.select("doc_id", F.xxhash64(*COLUMNS).alias("hash"), "place").join(groups, "place").groupBy("component_id").agg(first["place"].alias("place"))
    return rows.join(stay, "place", "left_semi").select(COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in brackets for each span of personal data; n_chars follows the text."""
    small_batches(spark)
    return pii.redact(docs.select(COLUMNS), pii.fit(docs)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: none, one or two times."""
    copies = mixing.copies(docs)
    return copies.select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return packing.pack(docs)


STAGES = [("language ID", identify_language), ("SimHash near-dedup", drop_near_copies), ("PII", redact_personal_data), ("mixing", mix_sources), ("best-fit packing", pack_sequences)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and reread."""
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
