"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from prismlake.plans.memory import local_table

#: Hashed n-gram features (a power of two), bytes of an n-gram, centroids of a language, rows of a language to fit them to.
FEATURES, GRAM, CENTROIDS, SAMPLE = 1 << 13, 3, 4, 1500
#: A text is rejected below this part of the similarity that all but FEWEST of the fitted rows of its language reach,
#: times sqrt(n / (n + SHORT)) for n different n-grams: short texts are less like any centroid.
PART, FEWEST, SHORT = 0.5, 0.01, 80
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_CLEAN = np.full(256, 32, "u4")
_CLEAN[97:123] = np.arange(97, 123)
_CLEAN[128:] = np.arange(128, 256)


def grams(text: str) -> np.ndarray:
    """Counts of hashed byte 3-grams of the lowered text's letters, with one space between and around words."""
    b = _CLEAN[np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b" ", "u1")]
    blank = b == 32
    b = b[~(blank & np.concatenate([[False], blank[:-1]]))]
    if len(b) < GRAM:
        return np.zeros(FEATURES, "i8")
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    return np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - 13), minlength=FEATURES)


def _vectors(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1 (or 0), logarithmic counts by inverse document frequency; and what shortness does to their similarity."""
    x = np.zeros((len(texts), FEATURES), "f4")
    for i, t in enumerate(texts):
        x[i] = grams(t)
    n = np.count_nonzero(x, axis=1)
    np.log1p(x, out=x)
    x *= idf
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None], np.sqrt(n / (n + SHORT))


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from spread-out first rows."""
    picks, best = [0], x @ x[0]
    while len(picks) < min(k, len(x)):
        picks.append(int(best.argmin()))
        best = np.maximum(best, x @ x[picks[-1]])
    c = x[picks].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if (own == j).any():
                m = x[own == j].mean(0)
                c[j] = m / max(1e-12, float(np.sqrt(m @ m)))
    return c


@dataclass
class Model:
    idf: np.ndarray
    langs: list[str]
    centroids: np.ndarray
    owner: np.ndarray
    floor: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, similarity and whether the text is rejected, of each text."""
        lang, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        use = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if self.langs else []
        for lo in range(0, len(use), 256):
            some = use[lo : lo + 256]
            x, shrink = _vectors([texts[i] for i in some], self.idf)
            sim = x @ self.centroids.T
            top = sim.argmax(1)
            for i, j, s, w in zip(some, self.owner[top], sim[np.arange(len(some)), top], shrink, strict=True):
                lang[i], score[i], rejected[i] = self.langs[j], min(1.0, max(0.0, float(s))), s < self.floor[j] * w
        return lang, score, rejected


def fit(docs: DataFrame, rows: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """A model from the rows of docs that ``rows`` selects and that have a text and a language.

    Document frequencies count all those rows. The centroids of a language are fitted to ``sample`` of its rows,
    those with the smallest id hashes. Document frequencies, centroids and counts by language come to the driver.
    """
    spark = docs.sparkSession
    own = docs.where(rows & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(doc_id)).alias("h"))

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, n = np.zeros(FEATURES, "i8"), 0
        for b in batches:
            for t in b["t"]:
                found += grams(t) > 0
            n += len(b)
        yield pd.DataFrame({"feature": np.append(np.arange(FEATURES), -1).astype("i4"), "n": np.append(found, n)})

    df = np.zeros(FEATURES + 1)
    for r in own.select("t").mapInPandas(seen, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        df[r["feature"]] = r["n"]
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype("f4")
    sizes = own.groupBy("lang").count().collect()
    cut = [(r["lang"], int(min(1.0, 1.5 * sample / r["count"]) * 2**62) - 1) for r in sizes]
    table = F.broadcast(local_table(spark, cut, "l string, most long"))  # a row for each language
    few = own.join(table, F.col("lang") == F.col("l")).where(F.shiftrightunsigned("h", 2) <= F.col("most"))
    first = Window.partitionBy("lang").orderBy("h", "t")
    few = few.withColumn("i", F.row_number().over(first)).where(F.col("i") <= sample).select("lang", "t")

    def centres(part: pd.DataFrame) -> pd.DataFrame:
        x, _ = _vectors(part["t"].tolist(), idf)
        x = x[x.any(1)]
        if not len(x):
            return pd.DataFrame({"lang": [], "centre": [], "floor": []})
        c = _cluster(x, centroids)
        floor = PART * float(np.quantile((x @ c.T).max(1), FEWEST))
        return pd.DataFrame({"lang": part["lang"].iloc[0], "centre": list(c), "floor": floor})

    got = sorted(few.groupBy("lang").applyInPandas(centres, "lang string, centre array<float>, floor double").collect(), key=lambda r: (r["lang"], r["centre"]))
    langs = sorted({r["lang"] for r in got})
    floor = {r["lang"]: r["floor"] for r in got}
    owner = np.array([langs.index(r["lang"]) for r in got], "i4")
    return Model(idf, langs, np.array([r["centre"] for r in got], "f4").reshape(-1, FEATURES), owner, np.array([floor[x] for x in langs]))


def identify(docs: DataFrame, model: Model, text: str = "text", prefix: str = "lang_") -> DataFrame:
    """docs with <prefix>pred, <prefix>score (0 to 1, the cosine to the nearest centroid) and <prefix>rejected.

    Null texts and texts without a letter get ``und``, score 0 and are rejected; other texts always get a learned
    language, and are rejected if their score is below their language's floor. A model without languages rejects
    all. Whole texts count; columns of these names are replaced; rows come out as often as they come in.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("pred string, score double, rejected boolean")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            lang, score, rejected = held.value.predict(t.tolist())
            yield pd.DataFrame({"pred": lang, "score": score, "rejected": rejected})

    out = docs.withColumn("__l", run(F.col(text)))
    return out.withColumns({f"{prefix}{c}": F.col(f"__l.{c}") for c in ("pred", "score", "rejected")}).drop("__l")


def held_out(doc_id: Column) -> Column:
    """True for a quarter of the ids, which no model is fitted to; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op5_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs, F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))
