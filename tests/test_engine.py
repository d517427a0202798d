"""Pictures, videos, faces, descriptions and places through the whole run, and the kernels under it."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_media import bmp, one

from prismlake import __main__ as command
from prismlake.functions import image, jpeg, media, parsers, vector
from prismlake.operators import dedup, geocode, match, vision
from prismlake.operators.decode import decode
from prismlake.operators.faces import Faces, load_faces, reference_people
from prismlake.plans import config
from prismlake.plans.engine import MediaIndex
from prismlake.sources import index_csv
from prismlake.sources.exif import read_exif
from prismlake.sources.tools import Tools, find_tool
from prismlake.streaming.resume import keep_indexed


def smooth(h, w, seed=0):
    y, x = np.mgrid[0:h, 0:w]
    a, b, c = np.random.default_rng(seed).uniform(0.02, 0.2, 3)
    return (127 + 100 * np.stack([np.sin(x * a), np.cos(y * b), np.sin((x + y) * c)], 2)).astype("u1")


def exif_tiff(orientation=1):
    """Make, orientation, date, flash and GPS of a small TIFF part."""
    entry = lambda tag, kind, n, v: struct.pack("<HHI", tag, kind, n) + v
    number = lambda v: struct.pack("<I", v)
    short = lambda v: struct.pack("<HH", v, 0)
    top, more, gps, text = 8, 8 + 2 + 5 * 12 + 4, 8 + 66 + 2 + 2 * 12 + 4, 300
    data = struct.pack("<2sHI", b"II", 42, top)
    data += struct.pack("<H", 5) + entry(271, 2, 4, b"Mak\0") + entry(272, 2, 4, b"Mod\0") + entry(274, 3, 1, short(orientation)) + entry(34665, 4, 1, number(more)) + entry(34853, 4, 1, number(gps)) + bytes(4)
    data += struct.pack("<H", 2) + entry(36867, 2, 20, number(text)) + entry(37385, 3, 1, short(1)) + bytes(4)
    data += struct.pack("<H", 4) + entry(1, 2, 2, b"S\0\0\0") + entry(2, 5, 3, number(text + 20)) + entry(3, 2, 2, b"E\0\0\0") + entry(4, 5, 3, number(text + 44)) + bytes(4)
    data = data.ljust(text, b"\0") + b"2021:05:04 10:11:12\0"
    return data + struct.pack("<6I", 10, 1, 30, 1, 0, 1) + struct.pack("<6I", 20, 1, 0, 1, 36, 1)


def with_exif(data, orientation=1):
    tiff = exif_tiff(orientation)
    return data[:2] + b"\xff\xe1" + (8 + len(tiff)).to_bytes(2, "big") + b"Exif\0\0" + tiff + data[2:]


def test_jpeg_is_read_by_spark(spark, tmp_path):
    shots = {"a": smooth(37, 61), "b": smooth(8, 8, 1), "c": smooth(100, 3, 2), "flat": np.full((20, 20, 3), 90, "u1"), "noise": np.random.default_rng(0).integers(0, 256, (40, 40, 3)).astype("u1")}
    for name, x in shots.items():
        (tmp_path / f"{name}.jpg").write_bytes(jpeg.encode(x))
    got = {r["image"]["origin"].rpartition("/")[2][:-4]: r["image"] for r in spark.read.format("image").load(str(tmp_path)).collect()}
    for name, x in shots.items():
        back = np.frombuffer(got[name]["data"], "u1").reshape(got[name]["height"], got[name]["width"], 3)[:, :, ::-1]
        assert back.shape == x.shape and np.abs(back.astype(int) - x).mean() < (12 if name == "noise" else 3), name


def test_exif_of_other_containers():
    tiff = exif_tiff(6)
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sBI", 1, b"gAMA", 0, 0) + struct.pack(">I4s", len(tiff), b"eXIf") + tiff + bytes(4)
    heif = struct.pack(">I4s", 16, b"ftyp") + b"heic" + bytes(20) + b"Exif\0\0xx" + bytes(9) + b"Exif\0\0" + tiff
    for data in (with_exif(jpeg.encode(smooth(9, 9)), 6), png, heif, tiff):
        got = read_exif(data)
        assert (got["camera_make"], got["orientation"], got["flash"], got["datetime"]) == ("Mak", 6, 1, "2021:05:04 10:11:12")
        assert got["gps_lat"] == -10.5 and got["gps_lon"] == pytest.approx(20.01)
    assert read_exif(png[:20])["camera_make"] is None and read_exif(heif[:40])["camera_make"] is None


def test_upright():
    x = np.arange(12).reshape(3, 4, 1)
    want = {1: x, 2: x[:, ::-1], 3: x[::-1, ::-1], 4: x[::-1], 5: x.transpose(1, 0, 2), 6: x.transpose(1, 0, 2)[:, ::-1], 7: x.transpose(1, 0, 2)[::-1, ::-1], 8: x.transpose(1, 0, 2)[::-1], 9: x}
    for k, y in want.items():
        assert np.array_equal(image.upright(x, k), y), k


def test_letterbox_and_tensor():
    square, scale, left, top = image.letterboxed(np.full((10, 20, 3), (1, 2, 3), "u1"))
    assert square.shape == (640, 640, 3) and (scale, left, top) == (32.0, 0, 160) and square[159].max() == 0 and square[160, 0].tolist() == [1, 2, 3]
    t = image.tensor(square)
    assert t.shape == (1, 3, 640, 640) and t.dtype == np.float32 and t[0, :, 320, 320].tolist() == [3.0, 2.0, 1.0]


def test_alignment(spark):
    target = np.array(image.LANDMARKS)
    for a, b, tx, ty in ((1.0, 0.0, 0.0, 0.0), (0.5, 0.2, 3.0, -4.0)):
        source = (target - [tx, ty]) @ np.linalg.inv(np.array([[a, b], [-b, a]]))
        assert np.allclose(image.similarity(source, target), (a, b, tx, ty))
        points = lambda p: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in p))
        assert np.allclose(one(spark, vector.similarity_transform(points(source), points(target))), (a, b, tx, ty))
    assert image.similarity(np.ones((5, 2)), target)[:2] == (0.0, 0.0)
    x = smooth(200, 200)
    assert np.array_equal(image.aligned(x, 1, 0, 0, 0), x[:112, :112]) and image.aligned(x, 0, 0, 5, 5).max() == 0
    moved = image.aligned(x, 1, 0, 100, 100)
    assert moved[:100].max() == 0 and np.array_equal(moved[100:, 100:], x[:12, :12])


def test_kept_faces_are_those_of_the_expression(spark):
    rng = np.random.default_rng(5)
    for n in (0, 1, 30):
        rows = np.round(np.concatenate([rng.uniform(0.9, 1, (n, 1)), rng.uniform(0, 40, (n, 2)), rng.uniform(-1, 20, (n, 2)), np.zeros((n, 10))], 1), 3)
        df = spark.createDataFrame([([tuple(map(float, r[:5])) for r in rows],)], "b array<struct<score:double,x:double,y:double,w:double,h:double>>")
        want = [tuple(r) for r in df.select(vector.keep_best(F.col("b")).alias("k")).first()["k"]]
        assert [tuple(r[:5]) for r in image.kept(rows).tolist()] == want


def test_small_functions(spark):
    assert one(spark, vector.normalised(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8] and one(spark, vector.normalised(F.array(F.lit(0.0)))) == [0.0]
    assert one(spark, media.list_text(F.array(F.lit("a"), F.lit("b")))) == "a, b"
    assert one(spark, media.relative_path(F.lit("/a.b/c/d.jpg"), "/a.b")) == "c/d.jpg"
    place = lambda body: one(spark, parsers.place_name(F.lit(body)))
    assert place('{"display_name":"Gate: 12, Road"}') == "Gate: 12, Road"
    assert place('{"address":{"city":7,"town":true,"village":"V","country":["x"]},"display_name":"D"}') == "V"
    assert place('{"address":{"city":""},"display_name":5}') is None and place("{") is None and place(None) is None


def test_far_hashes_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63, 40)
    hashes = sorted({int(x) ^ sum({1 << int(i) for i in rng.integers(0, 62, n)}) for x in base for n in (0, 10, 17)})
    want = {(a, b) for a in hashes for b in hashes if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 18}
    df = spark.createDataFrame([(h,) for h in [*hashes, hashes[0], None]], "h long")
    for size in (7, dedup.BLOCK):
        monkeypatch.setattr(dedup, "BLOCK", size)
        assert sorted(map(tuple, dedup.hash_pairs(df, 18).collect())) == sorted(want) and want
        groups = {r["h"]: r["duplicate_group"] for r in dedup.duplicate_groups(df, 18, order=["h"]).collect()}
        assert all(groups[a] == groups[b] for a, b in want)
        links = [tuple(r) for r in dedup.hash_pairs(df, 18, links=True).collect()]
        root = {h: h for h in hashes}
        for _ in hashes:
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        assert all(groups[a] == groups[b] for a, b in links) and len(set(root.values())) == len({groups[h] for h in hashes}) < len(hashes)
    assert dedup.hash_pairs(df.limit(0), 18).count() == 0


def test_references_in_blocks(spark):
    rng = np.random.default_rng(4)
    unit = lambda n: [(v / np.sqrt(v @ v)).tolist() for v in rng.standard_normal((n, 6))]
    faces = spark.createDataFrame(list(enumerate(unit(50))), "face long, embedding array<double>")
    refs = unit(30)
    people = spark.createDataFrame([(f"p{i % 7}", i, v) for i, v in enumerate([*refs, refs[0]])], "person string, photo long, embedding array<double>")
    near = [sorted(map(tuple, match.best_match(faces, people, block=b).collect())) for b in (match.BLOCK, 500)]
    assert near[0] == near[1] and any(p for _, p, _ in near[0])
    assert match.best_match(faces, people.limit(0)).where("person is null").count() == 50


def test_requests():
    cfg = config.VisionConfig("p", "http://e/", "m", "key", 5)
    url, headers, body, wait = vision.request(cfg, b"xyz", ollama=True)
    assert (url, headers, wait) == ("http://e/api/generate", {}, 120) and body["images"] == ["eHl6"] and body["stream"] is False
    url, headers, body, wait = vision.request(cfg, b"xyz")
    assert headers == {"Authorization": "Bearer key"} and wait == 60 and body["max_tokens"] == 5
    assert body["messages"][0]["content"][1]["image_url"]["url"] == "data:image/jpeg;base64,eHl6"
    assert vision.call("http://127.0.0.1:9/none", {}, {}, 2)[1].startswith(vision.FAILED)


def test_ollama_answers(spark):
    images = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"y"))], "file string, jpeg binary")
    cfg = config.VisionConfig("ollama", "http://e", "m")
    got = vision.describe(images, cfg, ollama=True, send=lambda *a: (json.dumps({"response": "DESCRIPTION: d\nTAGS: t\nTEXT: Main Street"}), None)).collect()
    assert [tuple(r)[1:] for r in got] == [("d", "t", "Main Street")] * 2
    with pytest.raises(ValueError):
        vision.describe(images, config.VisionConfig())


def script(path, text):
    path.write_text(text)
    path.chmod(0o755)
    return str(path)


@pytest.fixture
def stubs(tmp_path):
    """Programs that give a description and a frame, and face models that find a face in bright pictures."""
    tools = tmp_path / "tools"
    tools.mkdir()
    (tools / "frame.bmp").write_bytes(bmp(smooth(24, 32, 5)))
    (tools / "meta.json").write_text(json.dumps({"format": {"duration": "7.25", "tags": {"creation_time": "2020-02-03T04:05:06Z", "location": "+48.1351+011.5820/"}}, "streams": [{"codec_type": "video", "width": 32, "height": 24}]}))
    script(tools / "ffmpeg", f'#!/bin/sh\ncase "$*" in *broken*) echo bad >&2; exit 1;; esac\necho "$*" >> {tools}/calls\ncat {tools}/frame.bmp\n')
    script(tools / "ffprobe", f"#!/bin/sh\ncat {tools}/meta.json\n")

    def detect(x):
        out = [np.zeros((n * n, k), "f4") for k in (1, 1, 4, 10) for n in (80, 40, 20)]
        if x.mean() > 30:
            out[0][81], out[3][81] = 1, 1
            out[9][81] = np.arange(10) * 3.0
        return out

    return tools, Faces(detect, lambda x: np.array([1.0, 0, 0]) if x.max() < 250 else np.array([0, 1.0, 0]))


def test_tools(stubs, tmp_path):
    tools = stubs[0]
    assert find_tool("ffmpeg", str(tools)) == str(tools / "ffmpeg") and find_tool("no-such-program") is None
    both = Tools.found(str(tools))
    assert json.loads(both.describe("x"))["format"]["duration"] == "7.25" and both.frame("x", 7.25)[:2] == b"BM"
    both.frame("y", 4.0)
    assert [c.split()[3] for c in (tools / "calls").read_text().splitlines()] == ["2", "0"]
    with pytest.raises(ValueError, match="bad"):
        both.frame("broken", None)


def test_every_column(spark, tmp_path, stubs):
    tools, faces = stubs
    src, people, out = tmp_path / "lib", tmp_path / "people", tmp_path / "out"
    for d in (src / "_hidden", people / "Ann", people / "Bob", out):
        d.mkdir(parents=True)
    (src / "turned 1.jpg").write_bytes(with_exif(jpeg.encode(smooth(48, 80, 1) // 2 + 127), 6))
    (src / "_hidden" / "again.jpg").write_bytes(with_exif(jpeg.encode(smooth(48, 80, 1) // 2 + 127), 6))
    java = spark._jvm.java
    shot = java.awt.image.BufferedImage(30, 20, 10)
    for kind in ("png", "tiff"):
        assert spark._jvm.javax.imageio.ImageIO.write(shot, kind, java.io.File(str(src / f"grey.{kind}")))
    (src / "bright.jpg").write_bytes(jpeg.encode(np.full((60, 60, 3), 255, "u1")))
    for name in ("clip.mp4", "shot.heic", "raw.cr2", "broken.mov", "bad.png"):
        (src / name).write_bytes(b"no picture")
    (people / "Ann" / "1.jpg").write_bytes(jpeg.encode(np.full((60, 60, 3), 150, "u1")))
    (people / "Bob" / "1.bmp").write_bytes(bmp(np.zeros((60, 60, 3), "u1")))
    refs = reference_people(spark, str(people), faces).collect()
    assert [(r["person"], r["photo"], r["embedding"]) for r in refs] == [("Ann", "1.jpg", [1.0, 0.0, 0.0])]
    calls = tmp_path / "asked"

    def fetch(lat, lon):
        with open(calls, "a") as f:
            f.write(f"{lat} {lon}\n")
        return '{"address": {"town": "T", "country": "C"}}'

    def send(*request):
        return '{"choices":[{"message":{"content":"DESCRIPTION: seen\\nTAGS: x, y\\nTEXT: Main Street"}}]}', None

    run = lambda **more: MediaIndex(str(src), f"file://{out}", tools=Tools.found(str(tools)), faces=faces, people=str(people), fetch=fetch, cells=f"file://{tmp_path}/cells", spacing=0, vision=config.VisionConfig("p", "http://e", "m"), send=send, **more)
    index = run()
    index.build(spark)
    read = lambda: {r["file"]: r for r in index_csv.read_index(spark, [p for _, p in index_csv.chunk_files(spark, f"file://{out}")]).collect()}
    rows = read()
    assert all(any(r[c] for r in rows.values()) for c in index_csv.COLUMNS), [c for c in index_csv.COLUMNS if not any(r[c] for r in rows.values())]
    r = rows["turned 1.jpg"]
    assert (r["resolution"], r["orientation"], r["camera"], r["flash"], r["place"], r["gps_lat"], r["date_taken"]) == ("48x80", "portrait", "Mak Mod", "yes", "T, C", "-10.500000", "2021:05:04 10:11:12")
    assert (r["people"], r["face_count"], r["description"], r["tags"], r["ocr_text"]) == ("Ann", "1", "seen", "x, y", "Main Street")
    assert r["duplicate_group"] and r["duplicate_group"] == rows["_hidden/again.jpg"]["duplicate_group"] and r["phash"] == rows["_hidden/again.jpg"]["phash"]
    v = rows["clip.mp4"]
    assert (v["duration"], v["date_taken"], v["gps_lat"], v["resolution"], v["is_screenshot"]) == ("7.2", "2020-02-03T04:05:06Z", "48.135100", "32x24", "")
    assert rows["shot.heic"]["resolution"] == "32x24" and rows["grey.png"]["resolution"] == rows["grey.tiff"]["resolution"] == "30x20" and rows["grey.png"]["is_screenshot"] == "yes" and rows["grey.png"]["face_count"] == ""
    assert all(rows[f]["description"].startswith("unreadable") and not rows[f]["blur_score"] for f in ("raw.cr2", "broken.mov", "bad.png"))
    assert rows["bright.jpg"]["unknown_faces"] == rows["bright.jpg"]["face_count"] == "1" and rows["bright.jpg"]["people"] == ""
    assert index.counts == {"found": 10, "new": 10, "rows": 10, "errors": 3, "chunks": 1} and len(calls.read_text().splitlines()) == 2
    (src / "late.jpg").write_bytes(with_exif(jpeg.encode(smooth(20, 20)), 1))
    run(resume=True).build(spark)
    assert len(read()) == 11 and len(calls.read_text().splitlines()) == 2  # its cell is remembered
    run(rotate_rows=2).build(spark)
    assert sorted(p.name for p in out.glob("index_*.csv")) == [f"index_{k:03d}.csv" for k in range(1, 7)]
    MediaIndex(str(src), f"file://{out}", exclude="_hidden").build(spark)
    assert [p.name for p in out.glob("index_*.csv")] == ["index_001.csv"] and len(read()) == 10  # chunks of the longer run are gone


def test_models_that_are_not_there(tmp_path):
    assert load_faces(str(tmp_path)) is None
    for name in ("yunet.onnx", "sface.onnx"):
        (tmp_path / name).write_bytes(b"no model")
    assert load_faces(str(tmp_path)) is None


def test_decoders_and_lost_files(spark, tmp_path):
    (tmp_path / "a.cr2").write_bytes(b"\x05\x06")
    rows = [("a.cr2", str(tmp_path / "a.cr2")), ("b.jpg", None), ("a.cr2", str(tmp_path / "a.cr2"))]
    df = spark.createDataFrame(rows, "file string, abs_path string")
    got = decode(df, {"raw": lambda data: np.full((data[0], data[1], 3), 9, "u1")}).collect()
    assert sorted((r["file"], r["resolution"] or "", r["error"] or "") for r in got) == [("a.cr2", "6x5", "")] * 2 + [("b.jpg", "", "unreadable: no such file")]
    assert decode(df.limit(0)).count() == 0


def test_stream_indexes_each_file_once(spark, tmp_path):
    lists, out = tmp_path / "lists", tmp_path / "out"
    lists.mkdir()
    out.mkdir()
    for k in range(3):
        (tmp_path / f"{k}.bmp").write_bytes(bmp(smooth(9, 9, k)))
        (lists / f"{k}.json").write_text("".join(json.dumps({"file": f"{j}.bmp", "abs_path": str(tmp_path / f"{j}.bmp")}) + "\n" for j in (0, k)))
    for _ in range(2):
        files = spark.readStream.schema("file string, abs_path string").option("maxFilesPerTrigger", 1).json(str(lists))
        keep_indexed(files, f"file://{out}", f"file://{tmp_path}/check", per_chunk=2).awaitTermination()
    found = index_csv.chunk_files(spark, f"file://{out}")
    rows = index_csv.read_index(spark, [p for _, p in found]).collect()
    assert sorted(r["file"] for r in rows) == ["0.bmp", "1.bmp", "2.bmp"] and [n for n, _ in found] == [1, 2] and rows[0]["resolution"] == "9x9"


def test_geocoder_address(monkeypatch):
    asked = []

    class Answer:
        def __enter__(self):
            return self

        def __exit__(self, *a):
            pass

        def read(self):
            return b'{"display_name": "D"}'

    monkeypatch.setattr("urllib.request.urlopen", lambda r, timeout: asked.append((r.full_url, r.get_header("User-agent"), timeout)) or Answer())
    assert geocode.service("http://g/reverse", "me")(1.5, -2.0) == '{"display_name": "D"}'
    assert asked == [("http://g/reverse?format=json&lat=1.5&lon=-2.0&zoom=10&addressdetails=1", "me", 10)]


def test_command_line(capsys, tmp_path):
    assert command.main(["--print-config-example"]) == 0 and "endpoint" in capsys.readouterr().out
    f = tmp_path / "c"
    f.write_text("endpoint=http://x\nmodel=m\n")
    index = command.index_of(command.parser().parse_args(["--folder", "a", "--out", "b", "--config", str(f), "--no-dedup", "--exclude", "x"]))
    assert index.describes() and index.dedup_threshold is None and index.exclude == "x" and not index.ollama
    assert not command.index_of(command.parser().parse_args(["--folder", "a", "--no-vision", "--config", str(f)])).describes()
    assert not command.index_of(command.parser().parse_args(["--folder", "a"])).describes()
    assert command.index_of(command.parser().parse_args(["--folder", "a", "--ollama", "http://o", "--ollama-model", "m"])).ollama
    with pytest.raises(ValueError):
        MediaIndex("a", "b", dedup_threshold=65)
    with pytest.raises(SystemExit):
        command.main([])
