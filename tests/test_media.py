"""Sources, kernels, parsers and sinks on small fixtures."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlake.functions import image, media, parsers, vector
from prismlake.operators import dedup, geocode, vision
from prismlake.plans import config
from prismlake.plans.engine import MediaIndex
from prismlake.sources import index_csv
from prismlake.sources.exif import read_exif
from prismlake.sources.walk import media_files


def bmp(pixels):
    h, w, _ = pixels.shape
    rows = b"".join(r[:, ::-1].tobytes() + bytes(-3 * w % 4) for r in pixels[::-1])
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + len(rows), 0, 0, 54, 40, w, h, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_hamming_cases(spark):
    got = [one(spark, media.hamming(F.lit(a), F.lit(b))) for a, b in ((0x1234, 0x1234), (0b1010, 0b0010), (0b1111, 0))]
    assert got == [0, 1, 4]


def test_group_cases(spark):
    rows = spark.createDataFrame([(0, 0), (1, 1), (2, 3), (3, -1), (4, None)], "i long, h long")
    got = dedup.duplicate_groups(rows, 1, order=["i"]).orderBy("i").collect()
    assert [(r["duplicate_group"], r["group_size"]) for r in got] == [(1, 3)] * 3 + [(2, 1), (3, 1)]


def test_banded_pairs_are_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63, 60)
    hashes = sorted({int(x) ^ (1 << int(i)) ^ (1 << int(j)) for x in base for i, j in rng.integers(0, 62, (6, 2))})
    want = {(a, b) for a in hashes for b in hashes if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 6}
    got = dedup.hash_pairs(spark.createDataFrame([(h,) for h in hashes], "h long"))
    assert {tuple(r) for r in got.collect()} == want and want


def test_geo_cell(spark):
    cell = lambda x: one(spark, media.geo_cell(F.lit(x)))
    assert cell(48.1301) == cell(48.1304) != cell(48.20) and cell(-0.125) == -13 and cell(float("nan")) is None


@pytest.mark.parametrize("text, lat, lon", [("+48.1351+011.5820/", 48.1351, 11.582), ("+40.7128-074.0060/", 40.7128, -74.006), ("+48.1351+011.5820+123.4/", 48.1351, 11.582), ("", None, None), ("junk", None, None)])
def test_iso6709(spark, text, lat, lon):
    assert tuple(one(spark, parsers.iso6709(F.lit(text)))) == (lat, lon)


def test_kinds(spark):
    names = ["a.CR2", "a.heic", "a.mp4", "a.jpg", ".jpg", "x/a.", "b"]
    got = spark.createDataFrame([(n,) for n in names], "f string").select(media.media_kind(F.col("f")), media.is_supported(F.col("f"))).collect()
    assert [tuple(r) for r in got] == [("raw", True), ("heic", True), ("video", True), ("image", True), *[("image", False)] * 3]


def test_blur_and_hash():
    flat = np.full((50, 50, 3), 128, "u1")
    board = np.where((np.indices((50, 50)).sum(0) % 2)[:, :, None], 255, 0).repeat(3, 2).astype("u1")
    assert image.blur(flat) < 0.001 < image.blur(board)
    dark, half = np.zeros((64, 64, 3), "u1"), np.zeros((64, 64, 3), "u1")
    half[:, 32:] = 255
    assert image.average_hash(dark) == -1 != image.average_hash(half)


def test_responses(spark):
    get = lambda t: tuple(one(spark, parsers.structured_response(F.lit(t))))
    assert get("DESCRIPTION: a dog\nTAGS: dog, park\nTEXT: none") == ("a dog", "dog, park", "")
    assert get("just words") == ("just words", "", "")
    assert get("DESCRIPTION: x\nTAGS: y\nTEXT: Main Street\nTEXT: none")[2] == "Main Street"
    assert one(spark, parsers.reasoning_tail(F.lit("a\n 3. last one \n\n"))) == "last one"
    assert one(spark, parsers.reasoning_tail(F.lit(" \n"))) == parsers.EMPTY_REASONING


def test_probe_and_place(spark):
    probe = '{"format":{"duration":"4.5","tags":{"location":"+1+2/"}},"streams":[{"codec_type":"audio","tags":{"creation_time":"2020"}},{"codec_type":"video","width":8,"height":6}]}'
    assert tuple(one(spark, parsers.container_metadata(F.lit(probe)))) == (4.5, "2020", "+1+2/", 8, 6)
    assert one(spark, parsers.place_name(F.lit('{"address":{"city":3,"town":"T","country":"C"}}'))) == "T, C"
    assert one(spark, parsers.place_name(F.lit("{}"))) is None


def test_fixed_text(spark):
    assert [one(spark, media.fixed_text(F.lit(x), 1)) for x in (0.25, 0.35, 1234.56)] == ["0.2", "0.3", "1234.6"]


def test_overlap_and_choice(spark):
    boxes = [(0.9, 0.0, 0.0, 10.0, 10.0), (0.95, 1.0, 1.0, 10.0, 10.0), (0.5, 50.0, 50.0, 5.0, 5.0), (float("nan"), 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame([([tuple(b) for b in boxes],)], "b array<struct<score:double,x:double,y:double,w:double,h:double>>")
    assert [r["score"] for r in df.select(vector.keep_best(F.col("b")).alias("k")).first()["k"]] == [0.95, 0.5]


def test_detector_cell():
    out = [np.zeros((n * n, k), "f4") for k in (1, 1, 4, 10) for n in (80, 40, 20)]
    out[0][81], out[3][81] = 1, 1
    d = image.detections(out, 0.5, 8, 0)
    assert d.shape == (1, 15) and d[0, 0] == 1 and np.allclose(d[0, 1:5], [(8 - 4 - 8) / 0.5, (8 - 4) / 0.5, 16, 16])


def test_exif():
    value = lambda tag, kind, n, v: struct.pack("<HHI", tag, kind, n) + v
    ifd = struct.pack("<H", 2) + value(271, 2, 3, b"Me\0\0") + value(274, 3, 1, struct.pack("<HH", 6, 0)) + bytes(4)
    tiff = b"II*\0" + struct.pack("<I", 8) + ifd
    jpeg = b"\xff\xd8\xff\xe1" + (8 + len(tiff)).to_bytes(2, "big") + b"Exif\0\0" + tiff + b"\xff\xda"
    for data in (tiff, jpeg):
        assert read_exif(data)["camera_make"] == "Me" and read_exif(data)["orientation"] == 6
    assert read_exif(b"II*\0\xff")["orientation"] == 1 and read_exif(b"")["datetime"] is None


def test_config(tmp_path):
    f = tmp_path / "c"
    f.write_text("# x\nendpoint = http://a?b=c\nmodel=old\nmodel = m\nbad line\n")
    got = config.resolve(config.VisionConfig(), str(f), env={"PRISMLAKE_API_KEY": "secret"})
    assert got.usable() and got.model == "m" and got.endpoint.endswith("b=c") and got.max_tokens == 600 and "secret" not in repr(got)
    assert not config.resolve(config.VisionConfig(), str(tmp_path / "none"), env={}).usable()


def test_vision_and_geocode(spark):
    images = spark.createDataFrame([("a", bytearray(b"x"))], "file string, jpeg binary")
    cfg = config.VisionConfig("p", "http://e", "m", "", 5)
    got = vision.describe(images, cfg, send=lambda *a: ('{"choices":[{"message":{"content":"DESCRIPTION: d\\nTAGS: t\\nTEXT: none"}}]}', None)).first()
    assert tuple(got) == ("a", "d", "t", "")
    assert vision.describe(images, cfg, send=lambda *a: (None, "[vision error: x]")).first()["description"] == "[vision error: x]"
    rows = spark.createDataFrame([("a", 1.001, 2.0), ("b", 1.002, 2.0), ("c", None, 1.0)], "file string, gps_lat double, gps_lon double")
    known = spark.createDataFrame([], "lat_key long, lon_key long, place string")
    places = geocode.resolve(geocode.cells(rows), known, lambda a, b: '{"display_name": "%s"}' % a, spacing=0)
    assert [r["place"] for r in geocode.with_places(rows, places).orderBy("file").collect()] == ["1.001", "1.001", None]


def test_walk_build_resume(spark, tmp_path):
    src, out = tmp_path / "lib", tmp_path / "out"
    for d in ("_index", ".hidden", "Thumbs", "a", "a-b"):
        (src / d).mkdir(parents=True)
        (src / d / "1.bmp").write_bytes(bmp(np.random.default_rng(len(d)).integers(0, 255, (9, 12, 3), "u1")))
    (src / "bad.jpg").write_text("no picture")
    (src / "note.txt").write_text("x")
    os.symlink(src, src / "a" / "loop")
    os.symlink(src / "nowhere.jpg", src / "dangling.jpg")
    files = [r["file"] for r in media_files(spark, str(src), "thumbs").collect()]
    assert files == [".hidden/1.bmp", "_index/1.bmp", "a/1.bmp", "a-b/1.bmp", "bad.jpg", "dangling.jpg"]
    out.mkdir()
    MediaIndex(str(src), f"file://{out}", exclude="thumbs", rotate_rows=4).build(spark)
    assert sorted(p.name for p in out.iterdir() if not p.name.startswith(("_", "."))) == ["facets.csv", "index_001.csv", "index_002.csv"]
    read = lambda: index_csv.read_index(spark, [p for _, p in index_csv.chunk_files(spark, f"file://{out}")])
    rows = {r["file"]: r for r in read().collect()}
    assert list(sorted(rows)) == sorted(files) and rows["a/1.bmp"]["resolution"] == "12x9" and rows["bad.jpg"]["description"].startswith("unreadable") and rows["bad.jpg"]["phash"] == ""
    (src / "new.bmp").write_bytes(bmp(np.zeros((5, 5, 3), "u1")))
    MediaIndex(str(src), f"file://{out}", exclude="thumbs", rotate_rows=4, resume=True).build(spark)
    assert sorted(r["file"] for r in read().collect()) == sorted([*files, "new.bmp"])
