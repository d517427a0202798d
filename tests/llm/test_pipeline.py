"""The pipeline's stages on the smallest tables, each against what it must do."""

import corpus_pipeline as cp
from oracle import same

from prismlake.llm import near_texts, pii, queries, simhash
from prismlake.plans.memory import BATCH, local_table, small_batches
from prismlake.plans.ordering import ranked
from prismlake.plans.scratch import Scratch

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == cp.COLUMNS, name
        if name == "language ID":
            assert docs.count() >= 0.98 * n
        if name == "SimHash near-dedup":
            kept = [r["text"] for r in docs.collect()]
            assert len(kept) == len(set(kept))
        if name == "PII":
            assert all(not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"]) for r in docs.collect())
    total = sum(len(r["text"].encode().split()) + 1 for r in docs.collect())
    assert cp.STAGES[-1][1](spark, docs, SF).agg({"tokens": "sum"}).first()[0] == total


def test_near_copies_of_rows_without_own_id(spark):
    rows = [(None, "a"), (None, "b"), (None, "a"), (3, "c"), (3, "d"), (3, "c"), (7, "b"), (9, "e"), (5, "e"), (None, "e")]
    words = {t: " ".join(f"{t}{i}" for i in range(60)) for t in "abcde"}
    docs = spark.createDataFrame([(i, words[t], "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"][0]) for r in cp.drop_near_copies(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted([(None, "a"), (7, "b"), (3, "c"), (3, "d"), (5, "e")], key=str)


def test_near_copies_are_those_of_the_grid_and_beyond(spark):
    """Groups of op3's fingerprints stay whole, also where shingle sets are less alike; like texts beyond two bits go too."""
    words = [f"word{i}" for i in range(200)]
    page = " ".join(["this line is on each page here"] * 300)
    texts = [f"{page} first ending of a page", f"{page} another end, which nothing else has", " ".join(words), " ".join([*words[:60], "changed", *words[61:120], "twice", *words[121:]]), " ".join(words[::-1])]
    fp, sets = [simhash.fingerprint(t) for t in texts], [near_texts.shingle_set(t, 5) for t in texts]
    like = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in (0, 2)]
    assert (fp[0] ^ fp[1]).bit_count() <= 2 < (fp[2] ^ fp[3]).bit_count() and like[0] < 0.8 <= like[1]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in cp.drop_near_copies(spark, docs, SF).collect()) == [0, 2, 4]


def odd_rows(spark, n=1):
    """Nulls in any column, empty and very long texts, ties and repeated rows, and columns that stages use inside."""
    long = " ".join(f"the cat number {i % 4999} sat on the mat" for i in range(20_000))
    rows = [(1, "the cat sat on the mat", "en", "a", 22), (None, None, None, None, None), (2, "", "en", "", 0), (3, long, None, "a", None), (3, long, None, "a", None), (4, "12 34", "en", None, 5), (5, "mail a.b@c.de and the cat sat on the mat", "en", "b", 1), (None, "the cat sat on the mat", "en", "a", 22)]
    extra = ", node long, block int, root int, place int, hash int, rank int, size int, h int, id string, src string"
    return spark.createDataFrame([(*r, *[None] * extra.count(",")) for r in rows * n], "doc_id long, text string, lang string, source string, n_chars long" + extra)


def test_stages_on_odd_rows(spark):
    rows = odd_rows(spark)
    for name, stage in cp.STAGES:
        got = stage(spark, rows, SF).collect()
        assert stage(spark, rows.limit(0), SF).count() == 0, name
        texts = [r["text"] for r in got] if name != "best-fit packing" else []
        if name == "language ID":
            assert None not in texts and "" not in texts and "12 34" not in texts
        if name == "SimHash near-dedup":
            assert len(got) == 5 and {r["doc_id"] for r in got if r["text"] == "the cat sat on the mat"} == {1}
        if name == "PII":
            assert len(got) == 8 and "mail [EMAIL] and the cat sat on the mat" in texts and None in texts
        if name == "mixing":
            assert max(texts.count(t) for t in set(texts)) <= 4
        if name == "best-fit packing":
            assert sum(r["tokens"] for r in got) == sum(len((r["text"] or "").split()) + 1 for r in rows.collect())


def test_order_of_rows_does_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd_rows(spark, 2).select(cp.COLUMNS))
    key = lambda rows: sorted((str(r["doc_id"]), r["text"] or "", r["source"] or "") for r in rows)
    one = cp.drop_near_copies(spark, docs, SF).collect()
    two = cp.drop_near_copies(spark, docs.orderBy("n_chars", "text").repartition(3, "lang"), SF).collect()
    assert key(one) == key(two) and len(one) < docs.count()


def test_batches_of_long_texts_are_bounded(spark):
    """Python workers of the text stages get a few MB at a time, not 10,000 texts; smaller settings and all rows stay."""
    import pyarrow as pa

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"

    def read(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "bytes"])

    text = " ".join(f"word{i}" for i in range(10_000))
    docs = spark.range(0, 300, 1, 1).selectExpr("id doc_id", f"concat(id, ' {text}') text", "'en' lang", "'s' source", "1L n_chars")
    for name, stage in cp.STAGES[:3]:
        spark.conf.unset(setting)
        stage(spark, docs.limit(0), SF)
        got = docs.select("text").mapInArrow(read, "rows long, bytes long").collect()
        assert sum(r["rows"] for r in got) == 300 and max(r["bytes"] for r in got) < BATCH + 2 * len(text), name
    spark.conf.set(setting, "64k")
    small_batches(spark)
    assert spark.conf.get(setting) == "64k"
    spark.conf.unset(setting)


def test_small_tables_start_no_python_workers(spark):
    got = ranked(spark.range(50).selectExpr("id % 7 a", "id b"), ["a", "b"], Scratch(spark, "test"))
    assert [r["rank"] for r in got.orderBy("a", "b").collect()] == list(range(50))
    for df in (got, local_table(spark, [("a", 1), (None, None)], "l string, n long"), local_table(spark, [], "l string, n long")):
        assert "ExistingRDD" not in df._jdf.queryExecution().executedPlan().toString()
    assert local_table(spark, [("a", 1), (None, None)], "l string, n long").collect() == [("a", 1), (None, None)]


def test_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd_rows(spark, 2).select(cp.COLUMNS))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = cp.run(spark, str(tmp_path)).toPandas()
    bins = got.groupby("bin").agg(used=("tokens", "sum"), length=("length", "max"))
    assert len(got) > 100 and (bins.used <= bins.length).all() and got.doc_id.nunique() > 80


def test_oracles(spark):
    for name, sql in queries.ORACLES.items():
        same(queries.QUERIES[name](spark, SF), sql, SF)
