"""The ten operators against brute force, and on nulls, empty texts, repeated rows, empty tables and clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prismlake.llm import ann, embed_dedup, langid, mixing, near_texts, packing, pii, repair_ids, sharding, simhash, warc
from prismlake.plans.components import connected_components
from prismlake.plans.scratch import Scratch, new_path

SF = "/root/testdata/sf0.001"
#: Columns that operators use inside, to clash with.
EXTRA = ", id string, size int, shard int, rank int, n int, h int, fp int, root int, t string, a int, b int, source_size int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long" + EXTRA
NONE = (None,) * (EXTRA.count(","))


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with nulls in any column, empty, long and equal texts, and repeated rows."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, "the cat sat on the mat", "en", "a", 1), (2, "the cat sat on the mat", "en", None, 1), (2, "the cat sat on the mat", "en", None, 1), (3, "", "en", "b", 0), (4, None, None, None, None), (None, "le chat noir", "fr", "", 2), (6, long, "en", "a", 3), (7, "+1 (555) 555-0199 at a.b@c.de, 10.0.0.1 x 300.1.1.1 x 4111 1111 1111 1111", "en", "a", 9), (8, "123 456", None, "\U0001f600", 1)]
    return spark.createDataFrame([(*r, *NONE) for r in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def groups_by_force(ids, near):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if near(a, b):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}


def test_hilbert_is_a_curve():
    at = np.array([[i, j, k] for i in range(8) for j in range(8) for k in range(8)])
    index = sharding.hilbert_index(at, 3)
    assert sorted(index) == list(range(512)) and (np.abs(np.diff(at[np.argsort(index)], axis=0)).sum(1) == 1).all()


def test_shards(docs, odd, none):
    for df in (docs, odd):
        got = sharding.hilbert_shards(df).toPandas()
        sizes = got.groupby("shard").slot.agg(["size", "max", "min"])
        n = df.count()
        assert len(got) == n and (sizes["max"] + 1 == sizes["size"]).all() and sizes["size"].max() - n // 24 <= 1
    want = sorted((zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 8) for r in odd.collect())
    assert sorted(zip(got.text_crc32, got["size"])) == want
    assert sharding.hilbert_shards(none).count() == 0


def test_shards_against_plain_placement(docs, odd):
    """Codes by plain counting, curve, order and runs as the docstring says; reruns and other partitions agree."""
    import xxhash

    for df in (docs, odd):
        rows = [(r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode()), r["source"], r["lang"]) for r in df.select("doc_id", "text", "source", "lang").collect()]
        n, codes = len(rows), []
        for k in (0, 1):
            least = min(r[k] for r in rows if r[k] is not None)
            step = [-1 if r[k] is None else int(np.floor(np.log2(float(r[k]) - least + 1) * 1024)) for r in rows]
            codes.append([sum(x < s for x in step) * 32 // n for s in step])
        for k in (3, 4):
            codes.append([xxhash.xxh64_intdigest((r[k] if r[k] is not None else "\0").encode(), 42) % 32 for r in rows])
        place = sharding.hilbert_index(np.array(codes).T, 5).tolist()
        low = lambda x: (x is not None, x or 0 if not isinstance(x, str) else x)
        order = sorted(range(n), key=lambda i: (place[i], low(rows[i][0]), rows[i][2], rows[i][1], low(rows[i][3]), low(rows[i][4])))
        q, r = divmod(n, 24)
        runs = [(s, k) for s in range(24) for k in range(q + (s < r))]
        want = sorted((*rows[i][:3], *at) for i, at in zip(order, runs)) if df is docs else sorted(((*rows[i][:3], *at) for i, at in zip(order, runs)), key=str)
        for part in (df, df.repartition(5)):
            got = [tuple(x[c] for c in ("doc_id", "size", "text_crc32", "shard", "slot")) for x in sharding.hilbert_shards(part).collect()]
            assert (sorted(got) if df is docs else sorted(got, key=str)) == want


def test_shards_prune(spark):
    """Shards whose bounds meet a box of a quarter of the ids and of the sizes: a few of 24, where runs by id alone meet all 6 of the id range."""
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, "x" * int(n), "a", "b") for i, n in enumerate(rng.integers(0, 900, 3000))], "doc_id long, text string, source string, lang string")
    got = sharding.hilbert_shards(df, words=()).toPandas()
    bounds = got.groupby("shard").agg(a=("doc_id", "min"), b=("doc_id", "max"), c=("size", "min"), d=("size", "max"))
    met = [((bounds.a < x + 750) & (bounds.b >= x) & (bounds.c < y + 225) & (bounds.d >= y)).sum() for x in range(0, 3000, 750) for y in range(8, 900, 225)]
    assert np.mean(met) <= 4 and max(met) <= 8


def test_near_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((12, 16))
    x = np.concatenate([base + rng.standard_normal(base.shape) * s for s in (0, 0.1, 0.15, 0.2)])
    label = [int(i % 3) for i in range(len(x))]
    rows = [(i, v.tolist(), lab) for i, (v, lab) in enumerate(zip(x, label))]
    rows += [(100, rows[0][1], 0), (101, None, 0), (102, [0.0] * 16, 0), (103, [float("nan")] * 16, 0), (104, rows[0][1], None), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"rank": F.lit(1), "id": F.lit("x"), "n": F.lit(0)})
    got = {r["vec_id"]: r for r in embed_dedup.near_vectors(df, chunk=4, block=16, window=8).collect()}
    v = {i: np.array(e, "f4").astype("f8") for i, e, lab in rows if lab is not None and i is not None and e and np.isfinite(e).all() and any(e)}
    lab = {i: lab for i, _, lab in rows}
    near = lambda a, b: lab[a] == lab[b] and v[a] @ v[b] / np.sqrt(v[a] @ v[a]) / np.sqrt(v[b] @ v[b]) >= 0.98
    roots = groups_by_force(sorted(v), near)
    assert len(got) == len(rows)
    for i in v:
        assert got[i]["n_links"] == sum(near(i, j) for j in v if j != i) and got[i]["component_id"] == roots[i] and got[i]["kept"] == (roots[i] == i)
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (101, 102, 103, 104))
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_in_a_dense_label(spark):
    rng = np.random.default_rng(9)
    n, dims, pairs = 12_000, 64, 300
    centre = rng.standard_normal(dims)
    centre /= np.sqrt(centre @ centre)

    def off(rows, around, cosine):
        e = rng.standard_normal((rows, dims))
        e -= (e * around).sum(-1, keepdims=True) * around
        return cosine * around + np.sqrt(1 - cosine**2) * e / np.sqrt((e * e).sum(1, keepdims=True))

    x = off(n, centre, np.sqrt(0.93))
    x[-pairs:] = off(pairs, x[:pairs], 0.981)
    x = x.astype("f4").astype("f8")
    y = x / np.sqrt((x * x).sum(1, keepdims=True))
    want = np.concatenate([(y[s : s + 2000] @ y.T >= 0.98).sum(1) for s in range(0, n, 2000)]) - 1
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embed_dedup.near_vectors(df).collect()}
    assert want.sum() >= 2 * pairs and sum(got[i]["n_links"] for i in got) == want.sum()
    assert all(got[i]["n_links"] == want[i] for i in got) and all(got[n - pairs + i]["component_id"] == got[i]["component_id"] for i in range(pairs))


def test_near_vectors_spread_and_in_cones(spark):
    """Planted pairs in a label of spread vectors, in a cone and in a tight one: 99 of 100 links of each at least, no wrong one."""
    rng, n, dims, pairs = np.random.default_rng(4), 4000, 64, 300

    def off(rows, around, cosine):
        e = rng.standard_normal((rows, dims))
        e -= (e * around).sum(-1, keepdims=True) * around
        return cosine * around + np.sqrt(1 - cosine**2) * e / np.sqrt((e * e).sum(1, keepdims=True))

    rows, want = [], []
    for label, mutual in enumerate((0.0, 0.865, 0.96)):
        centre = rng.standard_normal(dims)
        x = off(n, centre / np.sqrt(centre @ centre), np.sqrt(mutual))
        x[-pairs:] = off(pairs, x[:pairs], 0.983)
        x = x.astype("f4").astype("f8")
        y = x / np.sqrt((x * x).sum(1, keepdims=True))
        want.append(np.concatenate([(y[s : s + 1000] @ y.T >= 0.98).sum(1) for s in range(0, n, 1000)]) - 1)
        rows += [(label * n + i, v.tolist(), label) for i, v in enumerate(x)]
    got = {r["vec_id"]: r["n_links"] for r in embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    for label, links in enumerate(want):
        have = np.array([got[label * n + i] for i in range(n)])
        assert (have <= links).all() and have.sum() >= 0.99 * links.sum() and links.sum() >= 2 * pairs


def test_simhash(docs, odd, none):
    for df in (docs, odd):
        got = simhash.simhash_groups(df).collect()
        fp = {r["doc_id"]: int(r["fingerprint"], 16) for r in got if r["doc_id"] is not None}
        want = groups_by_force(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
        assert len(got) == df.count() and all(r["component_id"] == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert simhash.simhash_groups(none).count() == 0


def test_crowded_cells(spark):
    rng = np.random.default_rng(2)
    fps = sorted({int(x) ^ (1 << int(i)) ^ (1 << int(j)) for x in rng.integers(-(2**63), 2**63, 3) for i, j in rng.integers(0, 63, (40, 2))} | {-1, -2, 2**63 - 1, -(2**63)})
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "id long, fp long")
    want = groups_by_force(list(range(len(fps))), lambda a, b: ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= 2)
    for crowd in (1, 256):
        got = {r["fp"]: r["component_id"] for r in simhash.fingerprint_groups(rows, crowd=crowd).collect()}
        assert all(got[f] == want[i] for i, f in enumerate(fps))


def test_near_texts(spark, odd, none):
    words = [f"word{i}" for i in range(300)]
    copies = [(i, " ".join([*words[: 20 * i], "changed", *words[20 * i + 1 :]])) for i in range(1, 12)] + [(0, " ".join(words)), (50, " ".join(words[::-1]))]
    got = {r["id"]: r["component_id"] for r in near_texts.near_text_groups(spark.createDataFrame(copies, "doc_id long, text string")).collect()}
    assert got == {i: 0 for i in range(12)} | {50: 50}
    assert near_texts.near_text_groups(odd).count() == odd.count() and near_texts.near_text_groups(none).count() == 0


def test_rows_near_in_blocks():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, (4, 2)).astype("u8")
    fp = np.array([[int(x) ^ sum({1 << int(j) for j in rng.integers(0, 63, i % 9)}) for x in base[i % 4]] for i in range(400)], "u8")
    key = np.repeat([3, 5, 9, 11], [1, 40, 159, 200])
    near = [[j for j in range(400) if key[i] == key[j] and (fp[i] ^ fp[j]).tolist() and sum(int(x).bit_count() for x in fp[i] ^ fp[j]) <= 12] for i in range(400)]
    met, first = near_texts._first_near(key, fp, 12)
    assert met.tolist() == [len(x) > 1 for x in near] and first.tolist() == [x[0] for x in near]
    table = pa.table({"block": key, "node": np.arange(400)})
    for n in (7, 50, 1000):
        blocks = list(near_texts._whole_blocks(iter(table.to_batches(max_chunksize=n))))
        assert pa.concat_tables(blocks).equals(table) and sum(len(set(b["block"].to_pylist())) for b in blocks) == 4


def test_forest_and_common():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 60, (2, 50))
    label, kept = near_texts._forest(np.arange(60), a, b)
    want = groups_by_force(range(60), lambda x, y: any((x, y) in ((p, q), (q, p)) for p, q in zip(a, b)))
    assert label.tolist() == list(want.values()) and len(kept) == 60 - len(set(want.values()))
    sets = [rng.choice(9000, n, replace=False).tolist() for n in (0, 1, 50, 8000, 3000, 70)]
    p, q = np.triu_indices(6, 1)
    got = near_texts._common(pa.array(sets, pa.list_(pa.int64())), p, q)
    assert got.tolist() == [len(set(sets[x]) & set(sets[y])) for x, y in zip(p, q)]


def test_near_pairs_at_the_threshold(spark):
    """Planted pairs a little over 0.8, long and short ones; none of the short ones is missed, and no other text links."""
    rng, texts, want = np.random.default_rng(12), [], 0
    for k in range(1200):
        n = int(rng.integers(3, 36)) if k % 3 == 0 else int(rng.integers(60, 300))
        own = [f"w{x}" for x in rng.integers(0, 10**7, n + 4)]
        cut = int(rng.integers(0, max(1, n // 5)))
        like = own[: len(own) - cut] if k % 2 else [*own[: len(own) - cut // 2], *(f"x{x}" for x in rng.integers(0, 10**7, cut // 2))]
        texts += [" ".join(own), " ".join(like)]
    sets = [near_texts.shingle_set(t, 5) for t in texts]
    pair = [len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1]) for i in range(0, len(texts), 2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in near_texts.near_text_groups(docs).collect()}
    assert all(got[2 * k] == 2 * k and got[2 * k + 1] in (2 * k, 2 * k + 1) for k in range(1200))
    found = [got[2 * k + 1] == 2 * k for k in range(1200)]
    assert not any(f and not p for f, p in zip(found, pair))
    short = [min(len(sets[2 * k]), len(sets[2 * k + 1])) <= near_texts.SHORT for k in range(1200)]
    assert all(f for f, p, s in zip(found, pair, short) if p and s) and sum(pair) > 900
    assert sum(f for f, p, s in zip(found, pair, short) if p and not s) >= 0.98 * sum(p and not s for p, s in zip(pair, short))


def test_near_text_families(spark):
    """A large group of copies beside families of like texts: groups are those of all pairs of shingle sets at 0.8 or more."""
    rng = np.random.default_rng(9)
    texts = []
    for f in range(4):
        base = [f"f{f}w{w}" for w in rng.integers(0, 9999, 400)]
        for changed in (*[2] * (60 if f == 0 else 3), *[20] * 10, *[60] * 4):
            own = list(base)
            for k in rng.choice(400, changed, replace=False):
                own[k] = f"x{rng.integers(0, 10**9)}"
            texts.append(" ".join(own))
    sets = [near_texts.shingle_set(t, 5) for t in texts]
    want = groups_by_force(range(len(texts)), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for crowd in (near_texts.CROWD, 8):
        got = near_texts.near_text_groups(docs, crowd=crowd).collect()
        assert {r["id"]: r["component_id"] for r in got} == want and len(set(want.values())) > 10


def test_parts_of_crowded_cells(spark):
    """Rows of different roots meet in a block of two parts, and a large group's rows are read once for each part of the others."""
    roots = {0: [1] * 400 + list(range(1000, 1006)), 1: [2] * 300, 2: [3] * 90 + [4] * 70 + [5] * 5 + [6] * 5, 3: list(range(2000, 2050))}
    own = [(c, 10000 * c + i, r) for c, of in roots.items() for i, r in enumerate(of)]
    blocks = {}
    for r in near_texts._pairs_of_parts(spark.createDataFrame(own, "cell long, node long, root long"), 16, 4).collect():
        blocks.setdefault(r["node"], []).append(r["block"])
    rows = {c: sum(len(blocks.get(n, [])) for k, n, _ in own if k == c) for c in roots}
    assert rows[0] <= 400 + 6 * 26 and rows[1] == 0 and rows[2] <= 90 * 6 + 70 * 7 + 10 * 12 and rows[3] == 50 * 4
    assert all(set(blocks[a]) & set(blocks[b]) for c, a, x in own for d, b, y in own if c == d and x != y)
    sizes = np.unique(np.concatenate(list(blocks.values())), return_counts=True)[1]
    assert sizes.max() <= 4 * 16


def test_short_texts_in_a_crowded_cell(spark):
    """Short texts that share their smallest hash: groups are those of all pairs, whether the cell is split or not."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(24)]
    texts = [" ".join([*base[: 24 - k], *(f"x{x}" for x in rng.integers(0, 10**6, k))]) for k in [1] * 60 + [2] * 20 + [9] * 10 + [14] * 4]
    sets = [near_texts.shingle_set(t, 5) for t in texts]
    want = groups_by_force(range(len(texts)), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for crowd in (near_texts.CROWD, 8):
        assert {r["id"]: r["component_id"] for r in near_texts.near_text_groups(docs, crowd=crowd).collect()} == want


def test_warc(spark):
    body = "x" * 120
    rows = [(3, "http://a/b c", body), (1, None, body), (2, "u", "short"), (5, "u", "short"), (4, "u", None), (None, "u", body), (3, "v", body), (9, "u", "é" * 60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"id": F.lit(1), "n": F.lit(1), "digest": F.lit("")})
    folder = new_path(spark, "test")
    manifest = warc.write_archives(df, folder, range_bytes=200, roll_bytes=600)
    got = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.read_archives(manifest, folder).collect()), key=str)
    digest = lambda s: hashlib.sha256((s or "").encode()).hexdigest()
    want = [(i or 0, *(("revisit", 1) if s == body and i != 1 else ("response", None)), len((s or "").encode()), digest(s)) for i, _, s in rows]
    assert got == sorted(want, key=str)
    again = new_path(spark, "test")
    assert sorted(map(tuple, manifest.collect())) == sorted(map(tuple, warc.write_archives(df.repartition(3), again, range_bytes=200, roll_bytes=600).collect()))
    folder = new_path(spark, "test")
    assert warc.read_archives(warc.write_archives(df.limit(0), folder), folder).count() == 0


def test_archives_are_whole(spark):
    """Every record has a name of its own, revisits name a response; damage of any byte is found."""
    from prismlake.llm.files import read_whole

    body = "y" * 150
    rows = [(1, "u", body)] * 3 + [(2, "u", body), (2, "u", body), (None, "u", "z" * 200), (None, "u", "z" * 200), (5, "u", "tiny"), (5, "u", "tiny")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = new_path(spark, "test")
    files = [r["file"] for r in warc.write_archives(df, folder).collect()]
    heads = [h for f in files for h, _ in warc.records(read_whole(folder, f))]
    names = [h["WARC-Record-ID"] for h in heads]
    assert len(set(names)) == len(names) == 9 + len(files)
    responses = {h["WARC-Record-ID"] for h in heads if h["WARC-Type"] == "response"}
    assert all(h["WARC-Refers-To"] in responses for h in heads if h["WARC-Type"] == "revisit") and sum(h["WARC-Type"] == "revisit" for h in heads) == 4
    data = read_whole(folder, files[0])
    rng = np.random.default_rng(0)
    for at in rng.integers(0, len(data), 60).tolist():
        broken = bytearray(data)
        broken[at] ^= 1 << int(rng.integers(0, 8))
        try:
            assert [b for _, b in warc.records(bytes(broken))] == [b for _, b in warc.records(data)]  # a byte of a gzip head
        except (ValueError, KeyError, zlib.error):
            pass
    with pytest.raises((ValueError, zlib.error)):
        list(warc.records(data[:-9]))
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    with store.open_output_stream(f"{root}/{files[0]}", compression=None) as out:
        out.write(data + data)
    with pytest.raises(Exception, match="isn't the file of the manifest"):
        warc.read_archives(spark.read.parquet(f"{folder}/manifest"), folder).collect()


def test_language(docs, odd, none):
    model = langid.fit(docs, ~langid.held_out(F.col("doc_id")))
    got = langid.identify(docs, model).where(langid.held_out(F.col("doc_id"))).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
    seen = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert all(seen[i]["lang_pred"] == "und" and seen[i]["lang_rejected"] for i in (3, 4, 8)) and 0 <= seen[1]["lang_score"] <= 1
    assert langid.identify(none, langid.fit(none, F.lit(True))).count() == 0


def test_language_against_plain_comparison(docs):
    own = docs.where("doc_id is not null").select("doc_id", "text", "lang").collect()
    model = langid.fit(docs, ~langid.held_out(F.col("doc_id")))
    train = [r for r in own if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["text"] is not None and r["lang"] is not None]
    seen = sum((langid.grams(r["text"]) > 0).astype(int) for r in train)
    assert np.allclose(model.idf, np.log((1 + len(train)) / (1 + seen)) + 1, rtol=1e-5)
    assert model.langs == sorted({r["lang"] for r in train}) and (np.bincount(model.owner) <= langid.CENTROIDS).all()
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    for r in own:
        if r["text"] and any(c.isalpha() for c in r["text"]):
            x = langid._vectors([r["text"]], model.idf)[0][0]
            cosines = [float(sum(a * b for a, b in zip(x[x > 0].tolist(), c[x > 0].tolist()))) for c in model.centroids]
            assert got[r["doc_id"]]["lang_score"] == pytest.approx(max(cosines), abs=1e-4)
            assert cosines[[i for i, o in enumerate(model.owner) if model.langs[o] == got[r["doc_id"]]["lang_pred"]][0]] <= max(cosines) + 1e-6
            best = {model.langs[o] for c, o in zip(cosines, model.owner) if c >= max(cosines) - 1e-5}
            assert got[r["doc_id"]]["lang_pred"] in best
    again = {r["doc_id"]: r for r in langid.identify(docs.repartition(3), langid.fit(docs.repartition(3), ~langid.held_out(F.col("doc_id")))).collect()}
    assert all(again[i]["lang_pred"] == got[i]["lang_pred"] and again[i]["lang_score"] == pytest.approx(got[i]["lang_score"], abs=1e-5) for i in got)


def test_queries_give_their_columns(spark):
    """The thin queries: columns and kinds, laws and filters."""
    from prismlake.llm.queries import QUERIES

    kinds = {
        "op1_hilbert_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int", "op2_near_vectors": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
        "op3_simhash_groups": "doc_id bigint, fingerprint string, component_id bigint", "op5_language_centroids": "doc_id bigint, held_out boolean, lang_pred string, score double",
        "op6_personal_spans": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string", "op7_repair_ids": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
        "op8_beam_nearest": "query_id bigint, rank int, vec_id bigint, score double", "op9_mix_sources": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    }
    for name, columns in kinds.items():
        df = QUERIES[name](spark, SF)
        assert dict(x.split() for x in columns.split(", ")).items() <= dict(df.dtypes).items(), name
        rows = df.collect()
        if name == "op1_hilbert_shards":
            assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}
        if name == "op5_language_centroids":
            assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
        if name == "op8_beam_nearest":
            assert {r["query_id"] for r in rows} == set(range(0, 500, 20)) and all(r["vec_id"] != r["query_id"] for r in rows) and len(rows) == 500


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def spans_by_force(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if not (kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)) or kind == "phone" and not 10 <= len(digits) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans():
    rng = np.random.default_rng(4)
    pieces = ["a@b.c", "@", ".", "1", "12", "255.1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (555) 555-0199", " ", "-", "x_%+y", "é", "(", ")", "\n", "0001.2.3.4.5", "+"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces, rng.integers(0, 14)))
        assert pii.base_spans(text) == spans_by_force(text), text
    assert pii.base_spans("9" * 200_000) == [] and pii.base_spans("a" * 200_000 + "@") == []


def test_personal(odd, docs, none):
    field = pii.fit(docs)
    got = {r["doc_id"]: r for r in pii.find_personal(odd, field).collect()}
    r = got[7]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1) and got[4]["spans"] == ""
    assert r["base_sha256"] == hashlib.sha256(pii.joined(spans_by_force(odd.where("doc_id = 7").first()["text"])).encode()).hexdigest()
    assert pii.redacted("mail a.b@c.de now", field) == "mail [EMAIL] now"
    assert pii.find_personal(none, pii.fit(none)).count() == 0


def test_like_tokens_take_the_label():
    width, k = pii._WIDTH, len(pii.KINDS) + 1
    field = pii.Field(np.zeros((width, k)), np.zeros((k, k)), np.eye(k) * 6)
    text = "call +1 (555) 555-0199 or, later, 555-0199 but not 12 or 99-77"
    base = pii.base_spans(text)
    at = text.rindex("555-0199")
    assert pii.added_spans(text, base, field) == [(at, 3, at + 8)]


def test_marginals_are_those_of_all_label_sequences():
    """Exact where the links make no cycle, near where a skip link closes one; known labels hold."""
    from itertools import product

    rng, k = np.random.default_rng(2), len(pii.KINDS) + 1
    for chain, skip, off in (([(0, 1), (1, 2)], [], 1e-3), ([(0, 1)], [(1, 3), (3, 2)], 1e-3), ([(0, 1), (1, 2), (2, 3)], [(0, 3)], 0.06)):
        n = 4 if skip else 3
        pair = lambda: (lambda m: (m + m.T) / 2)(rng.standard_normal((k, k)) * 0.7)
        field = pii.Field(rng.standard_normal((pii._WIDTH, k)) * 0.5, pair(), pair())
        x, label = rng.integers(0, 2, (n, pii._WIDTH)).astype(float), np.array([2, 0, 0, 0][:n])
        want = np.zeros((n, k))
        for y in product(range(k), repeat=n):
            if y[0] == 2:
                score = sum((x[i] @ field.own)[y[i]] for i in range(n)) + sum(field.chain[y[i], y[j]] for i, j in chain) + sum(field.skip[y[i], y[j]] for i, j in skip)
                want[np.arange(n), y] += np.exp(score)
        want /= want.sum(1, keepdims=True)
        assert np.abs(field.marginals(x, label, chain, skip) - want).max() < off


def test_the_fitted_field_adds_repeats(docs):
    field = pii.fit(docs)
    cases = {
        "Call +1 (555) 555-0199 before noon. Ask for Ann at 555-0199 later on.": ("555-0199", 3),
        "Write to jane.doe@site.org today; her address was jane.doe@site until now.": ("jane.doe@site", 0),
        "The host 10.21.30.41 failed, and so did 10-21-30-41 an hour later.": ("10-21-30-41", 1),
        "Paid with 4111111111111111 and again with 4111/111111111111 in May.": ("4111/111111111111", 2),
    }
    for text, (weak, kind) in cases.items():
        base = pii.base_spans(text)
        at = text.rindex(weak) if kind else text.rindex(weak + " ")
        assert (at, kind, at + len(weak)) in pii.added_spans(text, base, field), text
        assert weak not in pii.redacted(text, field).replace("jane.doe@site.org", "")
    for text in ("Call +1 (555) 555-0199 before 12.30 on 4 May 2021, room 17 or 555.", "From 10.21.30.41 came 1021 rows in 3041 s.", "jane@site.org met john@home and Jane"):
        assert pii.added_spans(text, pii.base_spans(text), field) == [], text


def test_token_ids(spark, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, folder = Tokenizer.from_file(path), new_path(spark, "test")
    got = repair_ids.read_shards(repair_ids.write_shards(odd, folder, path, shard_bytes_=60), folder).orderBy("start").collect()
    start, rows = 0, sorted(odd.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    for r, g in zip(rows, got, strict=True):
        ids = np.array([*whole.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"]) == (r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    folder = new_path(spark, "test")
    assert repair_ids.read_shards(repair_ids.write_shards(none, folder, path), folder).count() == 0


def test_encoder_equals_whole_texts():
    import pyarrow as pa
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = np.random.default_rng(8)
    pieces = [chr(c) for c in range(256)] + list("'s'll'd  ıİΣςé\u0301\u0308中\u2003\u3000½ŉ\U0001f600") + ["<|endoftext|>", "'S ", "Ünï", "it's", "Word", " "]
    texts = ["".join(rng.choice(pieces, rng.integers(0, 14))) for _ in range(6000)] + ["", "x" * 50_000, "a b " * 20_000]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        whole, encoder = Tokenizer.from_file(path), repair_ids.Encoder(path)
        assert encoder.pieces == (name == "word_bpe_49k.json")
        ids, counts = encoder.batch(pa.array(texts))
        ends = np.cumsum(counts)
        for t, own in zip(texts, np.split(ids, ends[:-1]), strict=True):
            assert own.tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)
    assert not len(encoder.batch(pa.array([], pa.string()))[0])


def test_encoder_remembers_pieces_alone():
    """Only different pieces, and words that aren't cut, are looked up one by one; words are cut together."""
    import pyarrow as pa
    import public_tokenizers

    encoder = repair_ids.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    encoder.batch(pa.array(["Word word, WORD: word.", "a\x85word\xa0Ünï ünÏ中", "", "word-word ünÏ中"]))
    assert {x for x in encoder.known if x} == {"word", ",", ":", ".", "a", "ünï", "ünÏ中", "-"}


def test_rules_spelled_at_once():
    rng = np.random.default_rng(5)
    for deep in (True, False):
        rules = np.array([[rng.integers(max(0, 20 + k - 3) if deep and k < 12 else 0, 20 + k) for _ in range(2)] for k in range(60)])
        own = []
        for a, b in rules.tolist():
            own.append([y for x in (a, b) for y in (own[x - 20] if x >= 20 else [x])])
        length, got = repair_ids.expansions(rules, 20)
        assert length.tolist() == [len(x) for x in own] and [x.tolist() for x in got] == own
    assert repair_ids.expansions(np.empty((0, 2), "i8"), 20)[1] == []
    with pytest.raises(ValueError):
        repair_ids.expansions(np.array([[1, 21], [1, 2]]), 20)


def test_shards_are_dealt_by_number(spark):
    """A task for each shard, and texts are computed twice: for the ranges and for the files, not once more for a sample."""
    import public_tokenizers

    seen, folder = spark.sparkContext.accumulator(0), new_path(spark, "test")

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    docs = spark.createDataFrame([(k, f"text {k} of some") for k in range(60)], "doc_id long, text string").mapInArrow(count, "doc_id long, text string")
    manifest = repair_ids.write_shards(docs, folder, public_tokenizers.path("word_bpe_49k.json"), shard_bytes_=100)
    rows = manifest.withColumn("of", F.input_file_name()).collect()
    assert sum(r["docs"] for r in rows) == 60 and len(rows) == len({r["of"] for r in rows}) > 5
    assert seen.value == 120


def test_grammar_round_trip():
    rng = np.random.default_rng(3)
    for n, top in ((0, 5), (1, 5), (5000, 3), (20000, 50)):
        ids = rng.integers(0, top, n).astype("<u4")
        ids[n // 2 :] = 1
        shard = repair_ids.Shard(b"".join(repair_ids.shard_bytes(ids, [None], np.array([n]), 100)))
        assert np.array_equal(shard.read(0, n), ids)
        for a, b in ((n // 3, n // 3 + 7), (n // 2 - 2, n // 2 + 2), (n - 1, n)):
            assert np.array_equal(shard.read(max(a, 0), max(b, 0)) if n > 1 else ids[a:b], ids[max(a, 0) : max(b, 0)] if n > 1 else ids[a:b])


def test_grammar_to_its_end():
    """No pair is left that pays for a rule; documents are read alone; damage is found."""
    rng = np.random.default_rng(7)
    words = [rng.integers(0, 900, rng.integers(1, 9)).tolist() for _ in range(300)]
    docs = [[x for w in rng.integers(0, 300, rng.integers(0, 400)) for x in words[w]] for _ in range(700)]
    ids, ends = np.array([x for d in docs for x in d], "<u4"), np.cumsum([len(d) for d in docs])
    for first, times in ((1000, repair_ids.TIMES), (1000, 2), (65_000, 2)):
        seq, rules = repair_ids.compress(ids, first, times)
        n = {}
        at = 0
        while at + 1 < len(seq):  # without overlaps
            pair = (int(seq[at]), int(seq[at + 1]))
            n[pair] = n.get(pair, 0) + 1
            at += 1
        assert max(n.values()) < max(times, 3) and len(seq) < len(ids) / 3
        back = {first + k: r for k, r in enumerate(rules.tolist())}
        assert all(x < first + k and y < first + k for k, (x, y) in enumerate(rules.tolist()))
        length, own = repair_ids.expansions(rules, first)
        assert np.array_equal(np.concatenate([own[x - first] if x in back else [x] for x in seq.tolist()]), ids)
    data = b"".join(repair_ids.shard_bytes(ids, list(range(700)), ends, 1000))
    shard = repair_ids.Shard(data)
    assert all(shard.document(k).tolist() == docs[k] for k in range(0, 700, 7))
    for at in (9, 40, len(data) // 2, len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            repair_ids.Shard(bytes(broken)).read(0, len(ids))


def test_nearest(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((900, 12)) * rng.uniform(0.5, 2, (900, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(901, None), (902, [0.0] * 12), (903, [float("inf")] * 12), (None, [1.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit(0), "rank": F.lit(0), "shard": F.lit(0)})
    got = ann.nearest(df, df.where("vec_id % 20 = 0")).collect()
    y = x.astype("f4").astype("f8")
    want = {(q, int(i)) for q in range(0, 900, 20) for i in [j for j in np.argsort(-(y @ y[q])) if j != q][:20]}
    assert len(got) == 45 * 20 and len({(r["query_id"], r["vec_id"]) for r in got} & want) >= 0.95 * len(want)
    assert all(abs(r["score"] - y[r["query_id"]] @ y[r["vec_id"]]) < 1e-9 for r in got)
    assert ann.nearest(df.limit(0), df).count() == 0 and ann.nearest(df.limit(5), df.limit(5)).count() == 20


def test_nearest_of_copies(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((900, 12)).astype("f4").astype("f8")
    x[rng.permutation(900)[:300]] = x[np.repeat([0, 20, 41], [200, 60, 40])]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(40, x[40].tolist())] * 30, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0").dropDuplicates(["vec_id"])).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    ids = np.append(np.arange(900), [40] * 30)
    right = 0
    for q in range(0, 900, 20):
        score = (x @ x[q])[ids]
        want = [int(ids[j]) for j in np.lexsort([ids, -score.round(9)]) if ids[j] != q][:20]
        have = [i for _, i in sorted(got[q])]
        right += sum(min(have.count(i), want.count(i)) for i in set(want))
    assert right >= 0.99 * 45 * 20


def test_nearest_of_repeated_queries_ties_and_large_numbers(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.standard_normal((300, 6)) * 2)
    x[np.abs(x).sum(1) == 0] = 1
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    twice = df.where("vec_id % 20 = 0").unionByName(df.where("vec_id % 20 = 0")).unionByName(spark.createDataFrame([(20, [1.0] * 6)], df.schema))
    got = {}
    for r in ann.nearest(df, twice, beam=300).collect():
        got.setdefault((r["query_id"], r["rank"]), []).append((r["vec_id"], r["score"]))
    right = 0
    for q in range(0, 300, 20):
        score = x @ x[q]
        want = [int(j) for j in np.lexsort([np.arange(300), -score]) if j != q][:20]
        assert all(len(got[q, k]) == 1 + (q == 20) for k in range(1, 21))
        right += sum((w, score[w]) in got[q, k] for k, w in enumerate(want, 1))
    assert right >= 0.99 * 300
    big = spark.createDataFrame([(i, [1e200 * (i + 1), 1e200]) for i in range(30)], df.schema)
    assert [r["vec_id"] for r in ann.nearest(big, big.where("vec_id = 0"), k=3).orderBy("rank").collect()] == [1, 2, 3]  # all scores overflow: a tie
    small = spark.createDataFrame([(i, [1e-100 * (i + 1), 1e120]) for i in range(30)], df.schema)
    assert ann.nearest(small, small.where("vec_id = 0"), k=3).count() == 3
    deal = ann._dealt(spark, 37).select("shard", F.pmod(F.hash("deal"), F.lit(37)).alias("task")).collect()
    assert sorted(r["shard"] for r in deal) == list(range(37)) and all(r["shard"] == r["task"] for r in deal)


def test_mix(docs, odd, none):
    got = mixing.mix(docs).toPandas()
    own = got.groupby("source").agg(size=("size", "sum"), want=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    assert abs(own.want.sum() / own["size"].sum() - 1.5) < 1e-9 and (own.want <= 2 * own["size"] + 1e-9).all()
    assert ((own.taken - own.want).abs() <= own.most / 2 + 1e-6).all() and (got.taken <= 2 * got["size"]).all()
    texts = {r["doc_id"]: len(r["text"].encode().split()) for r in docs.collect()}
    assert all(texts[i] == n for i, n in zip(got.doc_id, got["size"]))
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(none).count() == 0
    assert mixing.copies(odd).columns == odd.columns


def fill(sizes, weights, total, most):
    """Shares of total by weight, none above most times its size; what is cut off goes to the others by weight."""
    caps, out, free = [most * s for s in sizes], [0.0] * len(sizes), list(range(len(sizes)))
    left = min(total, sum(caps))
    while free:
        each = left / sum(weights[i] for i in free)
        full = [i for i in free if weights[i] * each > caps[i]]
        for i in full or free:
            out[i] = caps[i] if full else weights[i] * each
        if not full:
            break
        left -= sum(caps[i] for i in full)
        free = [i for i in free if weights[i] * each <= caps[i]]
    return out


def test_fill(spark):
    rng = np.random.default_rng(3)
    cases = [([10, 10, 10], 1.5), ([0, 10], 1.5), ([0], 1.5), ([7, 0, 100, 3, 3, 50, 2, 1], 1.5), (rng.integers(0, 1000, 60).tolist(), 1.9), ([5, 6], 9.0)]
    for sizes, share in cases:
        names = [*(f"s{i:03d}" for i in range(len(sizes) - 1)), None]
        df = spark.createDataFrame(list(zip(names, sizes)), "source string, size long")
        got = {r["source"]: r["target"] for r in mixing.shares(df, (5, 2, 1), share, 2.0, Scratch(spark, "test")).collect()}
        want = fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], share * sum(sizes), 2)
        assert [got[n] for n in names] == pytest.approx(want)
    assert fill([10, 10, 10], [5, 2, 1], 45, 2) == pytest.approx([20, 50 / 3, 25 / 3]) and fill([0, 10], [5, 1], 15, 2) == [0, 15]
    assert mixing.shares(spark.createDataFrame([], "source string, size long"), (5, 2, 1), 1.5, 2.0, Scratch(spark, "test")).count() == 0


def test_mix_takes_what_sorting_by_hash_takes(spark):
    """The thresholds against plain sorting: each copy of a source takes the smallest hashes up to its budget, to the nearest row."""
    rng = np.random.default_rng(6)
    rows = [(int(i), " ".join(["w"] * int(n)), f"s{k}" if k else None) for i, (n, k) in enumerate(zip(rng.integers(0, 40, 900), rng.choice(5, 900, p=[0.1, 0.2, 0.3, 0.39, 0.01])))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    hashes = {r["doc_id"]: r["h"] for r in df.select("doc_id", mixing._hash("doc_id").alias("h")).collect()}
    got = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    for s in {r[2] for r in rows}:
        own = sorted((hashes[i], len(t.split()), i) for i, t, x in rows if x == s)
        size, target = sum(n for _, n, _ in own), got[own[0][2]]["target"]
        want = dict.fromkeys((i for _, _, i in own), 0)
        for k in range(2):
            budget, at = min(size, max(0.0, target - k * size)), 0
            for _, n, i in own:
                if budget >= size or (at < budget and (at + n <= budget or 2 * (budget - at) >= n)):
                    want[i] += 1 if budget > 0 else 0
                at += n
        assert {i: got[i]["copies"] for i in want if len(rows[i][1])} == {i: c for i, c in want.items() if len(rows[i][1])}, s
        assert all(got[i]["source_size"] == size for i in want)
    again = {r["doc_id"]: r for r in mixing.mix(df.repartition(7)).collect()}
    assert again == got


def test_pack(docs, odd, none):
    for df in (docs, odd):
        got = packing.pack(df, pieces=40).toPandas()
        want = sum(len((r["text"] or "").encode().split()) + 1 for r in df.collect())
        bins = got.groupby("bin").agg(used=("tokens", "sum"), length=("length", "max"))
        assert got.tokens.sum() == want and (bins.used <= bins.length).all() and set(bins.length) <= set(packing.LENGTHS)
        assert all((own.sort_values("offset").offset.to_numpy() == np.cumsum([0, *own.sort_values("offset").tokens])[:-1]).all() for _, own in got.groupby("bin"))
        assert all(c == min(x for x in packing.LENGTHS if x >= u) for u, c in zip(bins.used, bins.length))
    assert packing.pack(none).count() == 0


def test_lengths_are_chosen_jointly():
    """Against packings of one length alone, made here plainly: never dearer, and cheaper where lengths are mixed."""
    rng, lengths, below, mixed = np.random.default_rng(11), (64, 128, 256, 512), 0, 0
    costs = [n + 8.0 for n in lengths]
    for turn in range(60):
        kinds = rng.integers(1, 512, rng.integers(1, 6))
        pieces = sorted(rng.choice(kinds, rng.integers(1, 200)).tolist() if turn % 2 else rng.integers(1, 512, rng.integers(1, 200)).tolist(), reverse=True)
        bins, offsets, sized = packing.best_fit(pieces, lengths, costs)
        fill = {}
        for b, o, n in zip(bins, offsets, pieces):
            assert fill.get(b, 0) == o
            fill[b] = o + n
        assert sorted(fill) == list(range(len(sized))) and all(sized[b] == min(n for n in lengths if n >= u) for b, u in fill.items())
        total = sum(n + 8.0 for n in sized)
        for top in lengths:
            rooms = []
            for n in pieces:
                fits = [r for r in rooms if r[0] >= n]
                if not fits:
                    size = max(top, min(x for x in lengths if x >= n))
                    rooms.append([size, size])
                    fits = rooms[-1:]
                min(fits, key=lambda r: r[0])[0] -= n
            alone = sum(min(x for x in lengths if x >= size - left) + 8.0 for left, size in rooms)
            assert total <= alone
            below += total < alone - 1e-9 and top == lengths[-1]
        mixed += len(set(sized)) > 1
    assert below and mixed > 20
