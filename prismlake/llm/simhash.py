"""SimHash near-duplicates: fingerprints meet in a grid over per-segment bit counts and are then compared exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from prismlake.plans.components import connected_components
from prismlake.plans.scratch import Scratch

_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype="u1")[:, None], axis=1, bitorder="little").astype("i8")
_LANES = np.arange(8) * 256
#: Cells with more fingerprints than this are refined to one-bit segments.
CROWD = 256


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64 bits: bit i is set if it is set in over half of the XXH64 hashes of the text's word shingles, repeats counted.

    A-Z are lowered; words are runs of anything but ASCII white space; fewer words than a shingle has make one
    shingle; a text without words, or null, has 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= shingle:
        return digest(join(words), seed)
    hashes = np.array([digest(join(s), seed) for s in zip(*(words[i:] for i in range(shingle)), strict=False)], "<u8")
    lanes = hashes.view("u1").reshape(-1, 8) + _LANES
    ones = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS_OF_BYTE
    return int.from_bytes(np.packbits(ones.ravel() * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(id, fp) of each row of docs, fp as the signed view of the 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py(), shingle) for x in b.column(1)], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(run, "id long, fp long")


def _counts(fp: Column, width: int) -> Column:
    """The counts of set bits in segments of ``width`` (4 or 1) bits, each in the segment's own place."""
    if width == 1:
        return fp
    nibble = F.lit(0x1111111111111111)
    return sum((F.shiftrightunsigned(fp, i).bitwiseAND(nibble) for i in range(1, 4)), fp.bitwiseAND(nibble))


def _cells(counts: Column, width: int) -> Column:
    """The grid cells within Manhattan distance 1 of the counts.

    Two points at distance 2 or less have a common cell of this kind: the points between them. So all pairs whose
    counts differ by 2 or less meet, and the Hamming distance is never below that difference.
    """
    if width == 1:
        steps = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: counts.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
        return F.array_append(steps, counts)
    at = lambda i: F.call_function("shiftrightunsigned", counts, i * 4).bitwiseAND(15)
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i * 4)
    places = F.sequence(F.lit(0), F.lit(15))
    up = F.transform(F.filter(places, lambda i: at(i) < 4), lambda i: counts + one(i))
    down = F.transform(F.filter(places, lambda i: at(i) > 0), lambda i: counts - one(i))
    return F.array_append(F.concat(up, down), counts)


def _differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of differing bits of signed 64-bit numbers."""
    return np.bitwise_count((x ^ y).view("u8"))


def _links(fps: np.ndarray, ids: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A link for each member that is not the smallest id of its component under the distance."""
    label, near = np.argsort(np.argsort(ids, kind="stable"), kind="stable"), _differing(fps[:, None], fps[None, :]) <= distance
    order = np.argsort(ids, kind="stable")
    while True:
        new = np.where(near, label[None, :], len(ids)).min(1)
        new = new[order[new]]
        if (new == label).all():
            break
        label = new
    root = ids[order[label]]
    return [(int(a), int(r)) for a, r in zip(ids, root, strict=True) if a != r]


def _meet(cells: DataFrame, distance: int, crowd: int) -> DataFrame:
    """(a, b, crowded fp) from rows (cell, fp, id): links within each cell, or else every member of a crowded cell.

    Cells are read as a sorted stream, so no more than ``crowd`` members of one are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, crowded = np.empty((0, 3), "i8"), None

        def out(links: list, many: np.ndarray) -> pa.RecordBatch:
            a = np.array(links, "i8").reshape(-1, 2)
            none = len(many) * [None]
            return pa.RecordBatch.from_arrays([pa.array([*a[:, 0].tolist(), *many[:, 2].tolist()], pa.int64()), pa.array([*a[:, 1].tolist(), *none], pa.int64()), pa.array([*len(a) * [None], *many[:, 1].tolist()], pa.int64())], names=["a", "b", "fp"])

        def work(rows: np.ndarray) -> pa.RecordBatch:
            """Rows of whole cells."""
            cut = np.flatnonzero(np.diff(rows[:, 0], prepend=rows[0, 0] ^ 1, append=rows[-1, 0] ^ 1))
            size, links, many = np.diff(cut), [], []
            two = cut[:-1][size == 2]
            near = two[_differing(rows[two, 1], rows[two + 1, 1]) <= distance]
            links += [(int(x), int(y)) for x, y in zip(rows[near, 2], rows[near + 1, 2], strict=True)]
            for k in np.flatnonzero(size > 2):
                own = rows[cut[k] : cut[k + 1]]
                if len(own) > crowd:
                    many.append(own)
                else:
                    links += _links(own[:, 1], own[:, 2], distance)
            return out(links, np.concatenate(many) if many else held[:0])

        for b in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1).astype("i8")
            if crowded is not None:
                same = rows[:, 0] == crowded
                if same.any():
                    yield out([], rows[same])
                rows = rows[~same]
            if not len(rows):
                continue
            rows, crowded = np.concatenate([held, rows]), None
            last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            held = rows[last:]
            if last:
                yield work(rows[:last])
            if len(held) > crowd:
                yield out([], held)
                held, crowded = held[:0], int(held[0, 0])
        if len(held):
            yield work(held)

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long, fp long")


def fingerprint_groups(rows: DataFrame, distance: int = 2, crowd: int = CROWD, scratch: Scratch | None = None) -> DataFrame:
    """(fp, component_id) of each fp of rows (id, fp): the smallest id that links within ``distance`` bits (2 at most) reach.

    Equal fingerprints are one point first. Points are put in the cells around their 16 four-bit segment counts and
    compared where they meet; those of cells with over ``crowd`` points are put in the cells around their 64 one-bit
    segments instead, which hold 65 points at most, so crowded cells lose no link and make no square. Null ids take
    no part: an fp that only they have gets a null component.
    """
    if not 0 <= distance <= 2:
        raise ValueError("cells around a point serve distances up to 2")
    scratch = scratch or Scratch(rows.sparkSession, "simhash")
    points = scratch.keep(rows.groupBy("fp").agg(F.min("id").alias("id")))
    known = points.where(F.col("id").isNotNull())
    cells = known.select(F.explode(_cells(_counts(F.col("fp"), 4), 4)).alias("cell"), "fp", "id")
    met = scratch.keep(_meet(cells, distance, crowd).distinct())
    links = met.where(F.col("b").isNotNull()).select("a", "b")
    crowded = met.where(F.col("fp").isNotNull()).select("fp", F.col("a").alias("id"))
    if not crowded.isEmpty():
        fine = crowded.select(F.explode(_cells(F.col("fp"), 1)).alias("cell"), "fp", "id")
        links = links.unionByName(_meet(fine, distance, 65).where(F.col("b").isNotNull()).select("a", "b"))
    roots = connected_components(links, scratch=scratch).select(F.col("node").alias("id"), "root")
    groups = scratch.keep(points.join(roots, "id", "left").select("fp", F.coalesce("root", "id").alias("component_id")))
    scratch.only(groups)
    return groups


def simhash_groups(docs: DataFrame, distance: int = 2, shingle: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of docs; fingerprint as 16 hex digits.

    Null and empty texts have fingerprint zero and link like any other; null ids have a null component_id unless
    their fingerprint occurs with another id; repeated rows come out as often as they come in; an empty table gives
    an empty result. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.keep(fingerprints(docs, text, doc_id, shingle))
    groups = fingerprint_groups(rows, distance)
    return rows.join(groups, "fp").select(F.col("id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
