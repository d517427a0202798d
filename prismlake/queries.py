"""Queries of the media-index operators over the driver's tables, with DuckDB SQL for each that SQL can express.

The tables have no photos, so columns stand in for file names, tags, pixels and boxes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from prismlake.functions import media, parsers, vector
from prismlake.operators import dedup, geocode, match, resume
from prismlake.operators.facets import facets
from prismlake.plans.scratch import Scratch

QUERIES, ORACLES = {}, {}
#: Differing bits of hashes of the embeddings that count as alike: the least distance on the smallest tables is 15.
ALIKE = 18


def query(sql: str | None = None):
    """Register a query under its name, and its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
SELECT 'lang' AS dimension, lang AS value, count(*) AS count FROM documents WHERE trim(lang) <> '' GROUP BY lang
UNION ALL SELECT 'source', source, count(*) FROM documents WHERE trim(source) <> '' GROUP BY source
""")
def facets_documents(spark, sf_dir):
    return facets(table(spark, sf_dir, "documents"), {"lang": "lang", "source": "source"})


@query("""
SELECT 'month' AS dimension, strftime(o_orderdate, '%Y-%m') AS value, count(*) AS count FROM orders GROUP BY 2
UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY 2
UNION ALL SELECT 'status', o_orderstatus, count(*) FROM orders GROUP BY 2
""")
def facets_orders_month(spark, sf_dir):
    month = media.year_month(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return facets(table(spark, sf_dir, "orders"), {"month": month, "priority": "o_orderpriority", "status": "o_orderstatus"})


@query("""
SELECT 'day_type' AS dimension, event_type AS value, count(*) AS count FROM events GROUP BY 2
UNION ALL SELECT 'month', strftime(ts, '%Y-%m'), count(*) FROM events GROUP BY 2
""")
def facets_events_month(spark, sf_dir):
    return facets(table(spark, sf_dir, "events"), {"day_type": "event_type", "month": media.year_month(F.date_format("ts", "yyyy:MM:dd"))})


@query("""
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE strftime(o_orderdate, '%Y-%m') END AS month FROM orders
""")
def year_month_mixed(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "yyyy:MM:dd HH:mm")).otherwise(F.concat(F.lit("taken "), F.date_format("o_orderdate", "yyyy-MM-dd")))
    return table(spark, sf_dir, "orders").select("o_orderkey", media.year_month(text).alias("month"))


_PIXELS = "list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 0.5) * 255) AS BIGINT))"
_HASHES = f"""h AS (SELECT vec_id, list_reduce(list_transform(px, lambda p, i: CASE WHEN p * len(px) >= list_sum(px) THEN (1::UBIGINT << (i - 1)::UBIGINT) ELSE 0::UBIGINT END), lambda a, b: a | b) AS h
  FROM (SELECT vec_id, {_PIXELS} AS px FROM embeddings))"""


def _pixels(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("px", F.transform("embedding", lambda x: F.floor((x.cast("double") + 0.5) * 255)))


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(table(spark, sf_dir, "embeddings")).select("vec_id", vector.average_hash(F.col("px")).alias("h"))


@query(f"WITH {_HASHES} SELECT vec_id, lpad(lower(to_hex(h)), 16, '0') AS phash FROM h")
def average_hash(spark, sf_dir):
    return _hashes(spark, sf_dir).select("vec_id", media.hash_hex(F.col("h")).alias("phash"))


@query(f"""
WITH p AS (SELECT vec_id, {_PIXELS} AS px FROM embeddings),
c AS (SELECT vec_id, px, 10 + 8 * (k // 6) + k % 6 AS i FROM p, range(36) t(k)),
l AS (SELECT vec_id, px[i - 1] + px[i + 1] + px[i - 8] + px[i + 8] - 4 * px[i] AS v FROM c)
SELECT vec_id, CAST(sum(v * v) * 36 - sum(v) * sum(v) AS DOUBLE) / 1296 AS blur FROM l GROUP BY vec_id
""")
def laplacian_blur(spark, sf_dir):
    return _pixels(table(spark, sf_dir, "embeddings")).select("vec_id", vector.laplacian_variance(F.col("px"), 8, 8).alias("blur"))


@query(f"""
WITH {_HASHES} SELECT a.vec_id AS a, b.vec_id AS b, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance
FROM h a JOIN h b ON a.vec_id < b.vec_id AND bit_count(xor(a.h, b.h)) <= 18
""")
def hamming_pairs(spark, sf_dir):
    rows = Scratch(spark, "hashes").keep(_hashes(spark, sf_dir))
    pairs = dedup.hash_pairs(rows, ALIKE).withColumnsRenamed({"a": "x", "b": "y"})
    pairs = pairs.unionByName(rows.select(F.col("h").alias("x"), F.col("h").alias("y")).distinct())
    one, two = rows.select(F.col("vec_id").alias("u"), F.col("h").alias("x")), rows.select(F.col("vec_id").alias("v"), F.col("h").alias("y"))
    found = pairs.join(one, "x").join(two, "y").where((F.col("u") != F.col("v")) & ((F.col("x") != F.col("y")) | (F.col("u") < F.col("v"))))
    return found.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), media.hamming(F.col("x"), F.col("y")).cast("int").alias("distance"))


@query(f"""
WITH RECURSIVE {_HASHES}, e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM h a JOIN h b ON bit_count(xor(a.h, b.h)) <= 18),
r AS (SELECT vec_id AS n, vec_id AS m FROM h UNION SELECT e.a, r.m FROM r JOIN e ON r.n = e.b),
g AS (SELECT n, min(m) AS root FROM r GROUP BY n)
SELECT n AS vec_id, dense_rank() OVER (ORDER BY root) AS duplicate_group, count(*) OVER (PARTITION BY root) AS group_size FROM g
""")
def near_dup_groups(spark, sf_dir):
    return dedup.duplicate_groups(Scratch(spark, "hashes").keep(_hashes(spark, sf_dir)), ALIKE, order=["vec_id"]).select("vec_id", "duplicate_group", "group_size")


@query("""
WITH s AS (SELECT f.vec_id, r.label AS person, r.vec_id AS photo, list_dot_product(CAST(f.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) AS sim
  FROM embeddings f CROSS JOIN embeddings r WHERE f.vec_id >= 50 AND r.vec_id < 50)
SELECT vec_id, CASE WHEN sim >= 0.363 THEN person END AS person FROM s
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, person, photo) = 1
""")
def best_match_people(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    refs = v.where("vec_id < 50").select(F.col("label").alias("person"), F.col("vec_id").alias("photo"), "embedding")
    return match.best_match(v.where("vec_id >= 50"), refs, key="vec_id").select("vec_id", "person")


@query("""
WITH s AS (SELECT f.vec_id, f.label, r.label AS person, r.vec_id AS photo, list_dot_product(CAST(f.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) AS sim
  FROM embeddings f CROSS JOIN embeddings r WHERE f.vec_id >= 50 AND r.vec_id < 50),
m AS (SELECT vec_id, label, CASE WHEN sim >= 0.363 THEN person END AS person FROM s
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, person, photo) = 1)
SELECT label AS file, count(*) FILTER (person IS NULL) AS unknown_faces, count(*) AS face_count FROM m GROUP BY label
""")
def face_counts(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    found = best_match_people(spark, sf_dir).join(v.select("vec_id", F.col("label").alias("file")), "vec_id")
    return match.face_counts(found).select("file", "unknown_faces", "face_count")


def _box(at: int) -> Column:
    e = lambda i: F.element_at("embedding", at + i).cast("double")
    return F.struct((e(0) + 1).alias("score"), e(1).alias("x"), e(2).alias("y"), (F.abs(e(3)) + 0.1).alias("w"), (F.abs(e(4)) + 0.1).alias("h"))


@query("""
WITH b AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
c AS (SELECT vec_id, e[2] AS x1, e[3] AS y1, abs(e[4]) + 0.1 AS w1, abs(e[5]) + 0.1 AS h1, e[12] AS x2, e[13] AS y2, abs(e[14]) + 0.1 AS w2, abs(e[15]) + 0.1 AS h2 FROM b),
i AS (SELECT *, greatest(least(x1 + w1, x2 + w2) - greatest(x1, x2), 0) * greatest(least(y1 + h1, y2 + h2) - greatest(y1, y2), 0) AS s FROM c)
SELECT vec_id, round(s / (w1 * h1 + w2 * h2 - s), 9) AS iou FROM i
""")
def iou_pairs(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vector.iou(_box(1), _box(11)), 9).alias("iou"))


@query("""
WITH RECURSIVE e AS (SELECT label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
b AS (SELECT label, e[1] + 1 AS score, e[2] AS x, e[3] AS y, abs(e[4]) + 0.1 AS w, abs(e[5]) + 0.1 AS h, row_number() OVER (PARTITION BY label ORDER BY e[1] DESC, e[2], e[3], abs(e[4]), abs(e[5])) AS rn FROM e),
r AS (SELECT b.label, b.rn, [{'score': b.score, 'x': b.x, 'y': b.y, 'w': b.w, 'h': b.h}] AS kept FROM b WHERE rn = 1
  UNION ALL SELECT b.label, b.rn, CASE WHEN (SELECT count(*) FROM (SELECT unnest(r.kept) AS k) u WHERE (greatest(least(u.k.x + u.k.w, b.x + b.w) - greatest(u.k.x, b.x), 0) * greatest(least(u.k.y + u.k.h, b.y + b.h) - greatest(u.k.y, b.y), 0))
    / (u.k.w * u.k.h + b.w * b.h - greatest(least(u.k.x + u.k.w, b.x + b.w) - greatest(u.k.x, b.x), 0) * greatest(least(u.k.y + u.k.h, b.y + b.h) - greatest(u.k.y, b.y), 0)) > 0.3) > 0 THEN r.kept ELSE list_append(r.kept, {'score': b.score, 'x': b.x, 'y': b.y, 'w': b.w, 'h': b.h}) END
  FROM r JOIN b ON b.label = r.label AND b.rn = r.rn + 1),
f AS (SELECT label, kept FROM r QUALIFY row_number() OVER (PARTITION BY label ORDER BY rn DESC) = 1),
g AS (SELECT label, unnest(range(len(kept))) AS place, unnest(kept) AS k FROM f)
SELECT label, CAST(place AS INTEGER) AS place, k.score AS score, k.x AS x, k.y AS y, k.w AS w, k.h AS h FROM g
""")
def nms_keep(spark, sf_dir):
    boxes = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.array_sort(F.collect_list(_box(1))).alias("boxes"))
    return boxes.select("label", F.posexplode(vector.keep_best(F.col("boxes"))).alias("place", "box")).select("label", "place", "box.*")


@query("""
WITH p AS (SELECT vec_id, unnest([CAST(embedding[i] AS DOUBLE) FOR i IN range(1, 11, 2)]) AS x, unnest([CAST(embedding[i + 1] AS DOUBLE) FOR i IN range(1, 11, 2)]) AS y, unnest([1.0::DOUBLE, 3, 2, 1, 3]) AS u, unnest([1.0::DOUBLE, 1, 2, 3, 3]) AS v FROM embeddings),
m AS (SELECT vec_id, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY vec_id),
s AS (SELECT vec_id, sum((x - cx) * (u - 2) + (y - cy) * (v - 2)) AS p, sum((x - cx) * (v - 2) - (y - cy) * (u - 2)) AS q, sum((x - cx) ** 2 + (y - cy) ** 2) AS s FROM p JOIN m USING (vec_id) GROUP BY vec_id)
SELECT vec_id, round(p / s, 6) AS a, round(q / s, 6) AS b FROM s
""")
def similarity_transform(spark, sf_dir):
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    src = F.array(*(point(F.element_at("embedding", i).cast("double"), F.element_at("embedding", i + 1).cast("double")) for i in range(1, 11, 2)))
    dst = F.array(*(point(F.lit(float(u)), F.lit(float(v))) for u, v in ((1, 1), (3, 1), (2, 2), (1, 3), (3, 3))))
    found = table(spark, sf_dir, "embeddings").select("vec_id", vector.similarity_transform(src, dst).alias("t"))
    return found.select("vec_id", F.round("t.a", 6).alias("a"), F.round("t.b", 6).alias("b"))


@query("""
SELECT l_orderkey, l_linenumber, (CASE WHEN l_linestatus = 'O' THEN -1 ELSE 1 END) * (l_quantity + l_linenumber / 60.0::DOUBLE + l_tax * 100 / 3600.0::DOUBLE) AS degrees FROM lineitem
""")
def dms_to_degrees(spark, sf_dir):
    ref = F.when(F.col("l_linestatus") == "O", "South").otherwise("North")
    value = media.degrees(F.col("l_quantity"), F.col("l_linenumber").cast("double"), F.col("l_tax") * 100, ref, "S")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", value.alias("degrees"))


@query("""
SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS lat, CASE WHEN l_linestatus = 'O' THEN -1 ELSE 1 END * (l_linenumber + 0.5::DOUBLE) AS lon FROM lineitem
""")
def iso6709_parse(spark, sf_dir):
    lon = F.concat(F.when(F.col("l_linestatus") == "O", "-").otherwise("+"), F.lit("00"), F.col("l_linenumber").cast("string"), F.lit(".5"))
    text = F.concat(F.lit("+"), F.col("l_quantity").cast("string"), lon, F.when(F.col("l_linenumber") % 2 == 0, "+123.4/").otherwise("/"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", parsers.iso6709(text).alias("p")).select("l_orderkey", "l_linenumber", "p.lat", "p.lon")


@query("""
WITH k AS (SELECT event_id, CAST(round(value * 100) AS BIGINT) AS a, CAST(round(user_id / 7.0::DOUBLE * 100) AS BIGINT) AS b FROM events),
f AS (SELECT a, b, min(event_id) AS first FROM k GROUP BY a, b)
SELECT event_id, 'place ' || first AS place FROM k JOIN f USING (a, b)
""")
def geo_cell_lookup(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("lat"), (F.col("user_id") / F.lit(7.0)).alias("lon"))
    keyed = rows.select("event_id", media.geo_cell(F.col("lat")).alias("lat_key"), media.geo_cell(F.col("lon")).alias("lon_key"))
    places = keyed.groupBy("lat_key", "lon_key").agg(F.concat(F.lit("place "), F.min("event_id").cast("string")).alias("place"))
    return geocode.with_places(rows, places, "lat", "lon").select("event_id", "place")


@query("""
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'Town ' || json_extract_string(props, '$.k') || ', Land' WHEN event_id % 4 = 1 THEN 'Land' WHEN event_id % 4 = 2 THEN 'Spot' END AS place FROM events
""")
def json_extract_coalesce(spark, sf_dir):
    k = F.col("event_id") % 4
    town = F.concat(F.lit('{"address": {"city": 7, "town": "Town '), F.get_json_object("props", "$.k"), F.lit('", "country": "Land"}}'))
    body = F.when(k == 0, town).when(k == 1, '{"address": {"country": "Land"}}').when(k == 2, '{"display_name": "Spot"}').otherwise("{}")
    return table(spark, sf_dir, "events").select("event_id", parsers.place_name(body).alias("place"))


_FLAT = "regexp_replace(text, '\\s+', ' ', 'g')"


@query(f"""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN trim(left(t, 40)) ELSE 'two' END AS description, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'a, b' END AS tags, CASE WHEN doc_id % 3 = 1 THEN lang ELSE '' END AS ocr_text
FROM (SELECT doc_id, lang, trim('x' || {_FLAT}) AS t FROM documents)
""")
def structured_response(spark, sf_dir):
    k, flat = F.col("doc_id") % 3, F.trim(F.concat(F.lit("x"), F.regexp_replace("text", r"\s+", " ")))
    labelled = F.concat(F.lit("DESCRIPTION: one\r\n  DESCRIPTION:  two \nTAGS: a, b\nTEXT: "), F.when(k == 1, F.col("lang")).otherwise("None"), F.lit("\n"))
    text = F.when(k == 0, F.left(flat, F.lit(40))).otherwise(labelled)
    return table(spark, sf_dir, "documents").select("doc_id", parsers.structured_response(text).alias("r")).select("doc_id", "r.*")


@query(f"""
SELECT doc_id, t AS description, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'a, b' END AS tags, CASE WHEN doc_id % 3 = 1 THEN t ELSE '' END AS ocr_text
FROM (SELECT doc_id, trim('x' || {_FLAT}) AS t FROM documents)
""")
def structured_response_whole(spark, sf_dir):
    """Whole texts, as a response without labels and as the values of labels."""
    k, flat = F.col("doc_id") % 3, F.trim(F.concat(F.lit("x"), F.regexp_replace("text", r"\s+", " ")))
    labelled = F.concat(F.lit("DESCRIPTION: one\r\n  DESCRIPTION:  "), flat, F.lit(" \nTAGS: a, b\nTEXT: "), F.when(k == 1, flat).otherwise("None"), F.lit("\n"))
    text = F.when(k == 0, flat).otherwise(labelled)
    return table(spark, sf_dir, "documents").select("doc_id", parsers.structured_response(text).alias("r")).select("doc_id", "r.*")


@query(f"""
SELECT doc_id, CASE WHEN length(t) > 240 THEN left(t, 240) || '…' ELSE t END AS tail FROM (SELECT doc_id, trim('x' || {_FLAT}) AS t FROM documents)
""")
def reasoning_tail(spark, sf_dir):
    text = F.concat(F.lit("first line\n\n 2. **"), F.trim(F.concat(F.lit("x"), F.regexp_replace("text", r"\s+", " "))), F.lit("\n \n"))
    return table(spark, sf_dir, "documents").select("doc_id", parsers.reasoning_tail(text).alias("tail"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand || '=x' ELSE 'fallback' END AS model, CAST(p_size AS VARCHAR) AS max_tokens FROM part
""")
def kv_config_merge(spark, sf_dir):
    text = F.concat(F.lit("# model = no\n\nno pair\nmax_tokens = 1\n model = "), F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_brand"), F.lit("=x"))).otherwise(""), F.lit("\nmax_tokens="), F.col("p_size").cast("string"))
    kv = parsers.key_values(text)
    return table(spark, sf_dir, "part").select("p_partkey", media.first_filled(kv["model"], F.lit("fallback")).alias("model"), kv["max_tokens"].alias("max_tokens"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as file names in folders, with all kinds of extensions."""
    ext = F.element_at(F.array(*map(F.lit, ["JPG", "Cr2", "heic", "MP4", "txt", "tiff", ""])), (F.col("p_partkey") % 7 + 1).cast("int"))
    name = F.concat(F.lit("lib/"), F.regexp_replace("p_brand", "#", "-"), F.when(F.col("p_size") % 5 == 0, "/_Index/").otherwise("/"), F.col("p_partkey").cast("string"), F.lit("."), ext)
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("file"))


_FILES = "(SELECT p_partkey, 'lib/' || replace(p_brand, '#', '-') || CASE WHEN p_size % 5 = 0 THEN '/_Index/' ELSE '/' END || p_partkey || '.' || (['JPG', 'Cr2', 'heic', 'MP4', 'txt', 'tiff', ''])[p_partkey % 7 + 1] AS file FROM part)"


@query(f"SELECT p_partkey, (['image', 'raw', 'heic', 'video', 'image', 'image', 'image'])[p_partkey % 7 + 1] AS media_type, p_partkey % 7 NOT IN (4, 6) AS supported FROM {_FILES}")
def media_kind(spark, sf_dir):
    return _files(spark, sf_dir).select("p_partkey", media.media_kind(F.col("file")).alias("media_type"), media.is_supported(F.col("file")).alias("supported"))


@query(f"SELECT p_partkey, file FROM {_FILES} WHERE file NOT LIKE '%/\\_Index/%' ESCAPE '\\'")
def exclude_subtree(spark, sf_dir):
    names = media.excluded_names(F.lit(" _INDEX , ,thumbs"))
    return _files(spark, sf_dir).where(~media.in_excluded(F.col("file"), names))


@query("SELECT page_id, row_number() OVER (ORDER BY string_split(url, '/'), page_id) AS place FROM pages")
def path_order(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", media.path_key(F.col("url")).alias("key"))
    return resume.with_chunks(pages, ["key", "page_id"]).select("page_id", F.col("row_no").alias("place"))


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_anti(spark, sf_dir):
    return resume.not_done(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source")


@query("""
SELECT doc_id, CAST((rn + 29) // 70 + 3 AS INTEGER) AS chunk, printf('shots_%03d.csv', (rn + 29) // 70 + 3) AS chunk_file FROM (SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) AS rn FROM documents)
""")
def chunk_assign(spark, sf_dir):
    rows = resume.with_chunks(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source", "doc_id"], 70, start=3, carry=30, stem="shots")
    return rows.select("doc_id", "chunk", "chunk_file")


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN 'landscape' WHEN p_size < 25 THEN 'portrait' ELSE 'square' END AS orientation, p_size || 'x25' AS resolution FROM part")
def orientation_label(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", media.orientation(F.col("p_size"), F.lit(25)).alias("orientation"), media.resolution(F.col("p_size"), F.lit(25)).alias("resolution"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 2 = 1 THEN 'yes' ELSE 'no' END AS flash FROM part")
def flash_tristate(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", media.flash(F.when(F.col("p_size") % 5 != 0, F.col("p_size"))).alias("flash"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 AND p_partkey % 7 <> 3 THEN 'yes' ELSE '' END AS is_screenshot FROM part")
def screenshot_flag(spark, sf_dir):
    rows = _files(spark, sf_dir).join(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), "p_partkey")
    make = F.when(F.col("p_size") % 3 != 0, F.col("p_brand"))
    return rows.select("p_partkey", media.screenshot(media.media_kind(F.col("file")), make, F.lit("")).alias("is_screenshot"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_type ELSE p_brand || ' ' || p_type END AS camera FROM part")
def camera_label(spark, sf_dir):
    make = F.when(F.col("p_size") % 4 != 0, F.concat(F.lit('"\t'), F.col("p_brand"), F.lit('"')))
    return table(spark, sf_dir, "part").select("p_partkey", media.camera(make, F.concat(F.col("p_type"), F.lit("  "))).alias("camera"))


@query("SELECT l_orderkey, l_linenumber, printf('%.1f', l_extendedprice) AS one, printf('%.6f', l_discount) AS six, CASE WHEN l_linenumber = 1 THEN '' ELSE CAST(l_linenumber - 1 AS VARCHAR) END AS n FROM lineitem")
def fixed_point_text(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", media.fixed_text(F.col("l_extendedprice"), 1).alias("one"), media.fixed_text(F.col("l_discount"), 6).alias("six"), media.zero_blank(F.col("l_linenumber") - 1).alias("n"))


@query(f"""
SELECT file, CASE WHEN p_size % 9 = 0 THEN '' ELSE p_size || 'x25' END AS resolution, CASE WHEN p_size % 9 = 0 THEN '' ELSE printf('%.1f', p_retailprice) END AS blur_score, CASE WHEN p_size % 9 = 0 THEN 'bad file' ELSE p_name END AS description
FROM {_FILES} f JOIN part USING (p_partkey)
""")
def index_csv_row(spark, sf_dir):
    from prismlake.sources.index_csv import index_cells

    rows = _files(spark, sf_dir).join(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", "p_name"), "p_partkey")
    typed = rows.select("file", media.media_kind(F.col("file")).alias("media_type"), media.resolution(F.col("p_size"), F.lit(25)).alias("resolution"), F.col("p_retailprice").alias("blur"), F.col("p_name").alias("description"), F.when(F.col("p_size") % 9 == 0, "bad file").alias("error"))
    return index_cells(typed).select("file", "resolution", "blur_score", "description")


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Gate: ' || event_id || ', Road' WHEN 1 THEN 'Lot 7: 8}, Land' WHEN 2 THEN 'Land' END AS place FROM events
""")
def place_by_type(spark, sf_dir):
    """Names with numbers inside them, and values that are numbers, true or lists."""
    k, n = F.col("event_id") % 4, F.col("event_id").cast("string")
    gate = F.concat(F.lit('{"address": {"city": '), n, F.lit('}, "display_name": "Gate: '), n, F.lit(', Road"}'))
    lot = F.lit('{"address": {"city": 1.5e3, "town": "Lot 7: 8}", "country": "Land"}}')
    body = F.when(k == 0, gate).when(k == 1, lot).when(k == 2, F.lit('{"address": {"city": ["x"], "town": true, "country": "Land"}, "display_name": "D"}')).otherwise(F.lit('{"display_name": 5}'))
    return table(spark, sf_dir, "events").select("event_id", parsers.place_name(body).alias("place"))


@query("""
SELECT vec_id, round(3 * embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: 9 * x::DOUBLE * x::DOUBLE))), 9) AS first, round(3 * embedding[64]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: 9 * x::DOUBLE * x::DOUBLE))), 9) AS last FROM embeddings
""")
def unit_vectors(spark, sf_dir):
    unit = vector.normalised(F.transform("embedding", lambda x: x.cast("double") * 3))
    return table(spark, sf_dir, "embeddings").select("vec_id", unit.alias("u")).select("vec_id", F.round(F.element_at("u", 1), 9).alias("first"), F.round(F.element_at("u", -1), 9).alias("last"))


@query("""
SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN user_id + 0.5::DOUBLE END AS duration, CASE event_id % 3 WHEN 0 THEN 'whole' WHEN 1 THEN 'second' END AS creation_time,
  CASE event_id % 2 WHEN 0 THEN '+1+2/' ELSE '+3+4/' END AS location, CAST(user_id AS INTEGER) AS width, 9 AS height FROM events
""")
def container_probe(spark, sf_dir):
    e, user = F.col("event_id"), F.col("user_id").cast("string")
    tags = F.concat(F.when(e % 3 == 0, F.lit('"creation_time": "whole", ')).otherwise(""), F.when(e % 2 == 0, F.lit('"com.apple.quicktime.location.ISO6709": "+1+2/", ')).otherwise(""), F.lit('"location": "+3+4/"'))
    long = F.when(e % 5 == 0, F.lit("N/A")).otherwise(F.concat(user, F.lit(".5")))
    other = F.when(e % 3 == 1, F.lit('"tags": {"creation_time": "second"}, ')).otherwise("")
    body = F.concat(F.lit('{"format": {"duration": "'), long, F.lit('", "tags": {'), tags, F.lit('}}, "streams": [{"codec_type": "audio"}, {'), other, F.lit('"codec_type": "video", "width": '), user, F.lit(', "height": 9}, {"codec_type": "video", "width": 1, "height": 1}]}'))
    return table(spark, sf_dir, "events").select("event_id", parsers.container_metadata(body).alias("m")).select("event_id", "m.*")


@query(f"SELECT p_partkey, substr(file, 5) AS file, replace(p_brand, '#', '-') || ', ' || p_type AS names FROM {_FILES} JOIN part USING (p_partkey)")
def paths_and_lists(spark, sf_dir):
    rows = _files(spark, sf_dir).join(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), "p_partkey")
    return rows.select("p_partkey", media.relative_path(F.col("file"), "lib").alias("file"), media.list_text(F.array(F.regexp_replace("p_brand", "#", "-"), "p_type")).alias("names"))


@query(f"""
WITH RECURSIVE {_HASHES}, e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM h a JOIN h b ON bit_count(xor(a.h, b.h)) <= 18),
r AS (SELECT vec_id AS n, vec_id AS m FROM h UNION SELECT e.a, r.m FROM r JOIN e ON r.n = e.b),
g AS (SELECT n, min(m) AS root FROM r GROUP BY n),
d AS (SELECT n, dense_rank() OVER (ORDER BY root) AS id, count(*) OVER (PARTITION BY root) AS size FROM g)
SELECT n AS vec_id, CASE WHEN size > 1 THEN CAST(id AS VARCHAR) ELSE '' END AS cell FROM d
""")
def shown_groups(spark, sf_dir):
    return near_dup_groups(spark, sf_dir).select("vec_id", dedup.shown_group(F.col("duplicate_group"), F.col("group_size")).alias("cell"))


@query("""
WITH s AS (SELECT f.vec_id, f.label, r.label AS person, r.vec_id AS photo, list_dot_product(CAST(f.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) AS sim
  FROM embeddings f CROSS JOIN embeddings r WHERE f.vec_id >= 50 AND r.vec_id < 50),
m AS (SELECT vec_id, label, CASE WHEN sim >= 0.363 THEN person END AS person FROM s
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, person, photo) = 1)
SELECT label AS file, coalesce(string_agg(CAST(person AS VARCHAR), ', ' ORDER BY vec_id), '') AS people FROM m GROUP BY label
""")
def people_in_order(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    found = best_match_people(spark, sf_dir).join(v.select("vec_id", F.col("label").alias("file")), "vec_id")
    return match.face_counts(found, order="vec_id").select("file", media.list_text(F.col("people").cast("array<string>")).alias("people"))
