"""SimHash near-duplicates at a Jaccard similarity of word shingles: wide fingerprints in single-bit segments."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from prismlake.plans.components import connected_components
from prismlake.plans.scratch import Scratch

#: 64-bit lanes of a wide fingerprint, those that go along into the cells, and the least bits of a cell's key.
LANES, CARRIED, KEY = 16, 2, 16
#: Part of the pairs at the threshold that may have no cell in common.
MISSED = 0.01
#: Rows of a block at most; cells with more are split. Texts of so many shingles at most are joined by their sets.
CROWD, SHORT = 4096, 32
#: So many ids or cells go along with each task; more are joined by a shuffle.
_BROADCAST = 1_000_000
#: Where in a cell's number that of its table begins.
_TABLE = 48
#: Blocks up to this size are compared side by side.
_SIDE = 64
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype="u1")[:, None], axis=1, bitorder="little").astype("f8")
_PLACES = np.arange(8) * 256
_MIX = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64 for k in range(64)], "u8")


def shingle_set(text: str | None, shingle: int) -> set[int]:
    """XXH64 hashes of the different word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= shingle:
        return {digest(join(words), 42)} if words else set()
    return {digest(join(s), 42) for s in zip(*(words[i:] for i in range(shingle)), strict=False)}


def wide_fingerprints(sets: list[np.ndarray], lanes: int = LANES) -> np.ndarray:
    """SimHash of ``lanes`` times 64 bits for each array of hashes of different shingles; 0 without any."""
    size = np.array([len(s) for s in sets], "i8")
    out = np.zeros((len(sets), lanes), "<u8")
    if not size.sum():
        return out
    h = np.concatenate(sets)
    place = (np.repeat(np.arange(len(sets)) * 2048, size)[:, None] + _PLACES).astype("i4")
    for k in range(lanes):
        x = (h ^ _MIX[k]) * _MIX[1]
        x = (x ^ (x >> np.uint64(32))) * _MIX[2]
        x ^= x >> np.uint64(29)
        ones = np.bincount((x.view("u1").reshape(-1, 8) + place).ravel(), minlength=2048 * len(sets)).reshape(-1, 256).astype("f8") @ _BITS_OF_BYTE
        out[:, k] = np.packbits(ones.reshape(len(sets), 64) * 2 > size[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _in_turns(texts: pa.Array, shingle: int) -> Iterator[list[np.ndarray]]:
    """The shingle sets of the texts, some at a time."""
    held, total = [], 0
    for t in texts:
        own = shingle_set(t.as_py(), shingle)
        held.append(np.fromiter(own, "u8", len(own)))
        total += len(own)
        if len(held) == 128 or total > 1 << 16:
            yield held
            held, total = [], 0
    if held:
        yield held


def bounds(bits: int, similarity: float) -> tuple[int, int]:
    """Differing bits of ``bits`` that make a pair surely, and at most, a pair of sets of the similarity."""
    angle = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    spread = np.sqrt(bits * angle * (1 - angle))
    return int(bits * angle - 3 * spread), int(bits * angle + 4 * spread)


def tables(points: int, similarity: float, bits: int) -> np.ndarray:
    """(tables, width): the bits that make the keys of each table, so that all but ``MISSED`` of the pairs at the threshold meet.

    Keys get a bit for each doubling of the points past 2**20, so that a cell holds a few points by chance at any
    size; the tables needed then grow with a root of the points.
    """
    width = max(KEY, int(np.ceil(np.log2(max(points, 1)))) - 4)
    same = (1 - np.arccos(2 * similarity / (1 + similarity)) / np.pi) ** width
    count = int(np.ceil(np.log(MISSED) / np.log(1 - same)))
    deal, every = np.random.default_rng(1), bits // width
    turns = [deal.permutation(bits)[: every * width].reshape(every, width) for _ in range(-(-count // every))]
    return np.concatenate(turns)[:count]


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole blocks, from a stream sorted by its first column, a block's number."""
    held: list[pa.Table] = []
    for b in batches:
        if not b.num_rows:
            continue
        key, rows = b.column(0).to_numpy(), pa.Table.from_batches([b])
        new = int(np.searchsorted(key, key[-1]))
        if held and held[-1].column(0)[-1].as_py() != key[-1] or not held and new:
            yield pa.concat_tables([*held, rows[:new]])
            held, rows = [], rows[new:]
        held.append(rows)
    if held:
        yield pa.concat_tables(held)


def _numbers(table: pa.Table, *at: int) -> list[np.ndarray]:
    return [table.column(i).to_numpy() for i in at]


def _starts(key: np.ndarray) -> np.ndarray:
    """Where blocks start, and the end."""
    return np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints (..., lanes)."""
    return np.bitwise_count(x ^ y).sum(-1, dtype="i4")


def _first_near(key: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row (sorted by block): is any other of its block near, and the first near one or else itself."""
    starts = _starts(key)
    size, n = np.diff(starts), len(key)
    met, first = np.zeros(n, bool), np.arange(n)
    ends = np.repeat(starts[1:], size)
    at = np.flatnonzero(np.repeat((size > 1) & (size <= _SIDE), size))
    for off in range(1, _SIDE):
        at = at[at + off < ends[at]]
        if not len(at):
            break
        near = at[_far(fp[at], fp[at + off]) <= most]
        met[near] = met[near + off] = True
        np.minimum.at(first, near + off, near)
    for k in np.flatnonzero(size > _SIDE):
        lo, hi = starts[k], starts[k + 1]
        for s in range(lo, hi, 256):
            e = min(s + 256, hi)
            near = _far(fp[s:e, None], fp[None, lo:hi]) <= most
            met[s:e] = near.sum(1) > 1
            first[s:e] = lo + near.argmax(1)
    return met, first


def _forest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels after the links a, b are added, and the links, one for each label that gave way, that do so."""
    kept = []
    order = np.arange(len(a))
    while len(order):
        x, y = label[a[order]], label[b[order]]
        order, x, y = order[x != y], x[x != y], y[x != y]
        if not len(order):
            break
        high, low = np.maximum(x, y), np.minimum(x, y)
        _, one = np.unique(high, return_index=True)
        kept.append(order[one])
        to = np.arange(label.max() + 1)
        to[high[one]] = low[one]
        while (to != to[to]).any():
            to = to[to]
        label = to[label]
    return label, np.concatenate(kept) if kept else order


def _pairs(root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of different roots, some at a time."""
    n = len(root)
    step = max(1, (1 << 16) // n)
    for s in range(0, n, step):
        a, b = np.nonzero((root[s : s + step, None] != root[None, :]) & (np.arange(s, min(s + step, n))[:, None] < np.arange(n)[None, :]))
        yield a + s, b


def _common(sets: pa.ListArray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many items the sets a and b have in common, each."""
    size = np.diff(sets.offsets.to_numpy())
    _, item = np.unique(sets.flatten().to_numpy(), return_inverse=True)
    order = np.argsort(item, kind="stable")
    row, item = np.repeat(np.arange(len(size)), size)[order], item[order]
    top, out = int(item[-1]) + 1 if len(item) else 0, np.zeros(len(a), "i8")
    for lo in range(0, top, 1 << 12):
        s, e = np.searchsorted(item, [lo, lo + (1 << 12)])
        has = np.zeros((len(size), min(1 << 12, -(-(top - lo) // 64) * 64)), bool)
        has[row[s:e], item[s:e] - lo] = True
        bits = np.packbits(has, axis=1).view("u8")
        for k in range(0, len(a), 1 << 14):
            out[k : k + (1 << 14)] += np.bitwise_count(bits[a[k : k + (1 << 14)]] & bits[b[k : k + (1 << 14)]]).sum(1, dtype="i8")
    return out


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= _BROADCAST else df


def _part() -> Column:
    """The part of its cell that a row is in."""
    return F.pmod(F.xxhash64("node", "cell"), F.col("parts"))


def _numbered(*parts: Column) -> Column:
    """Number of a block that is part of a cell; it tells the cell's table."""
    within = F.xxhash64("cell", *parts).bitwiseAND((1 << _TABLE) - 1)
    return F.shiftleft(F.shiftright("cell", _TABLE), _TABLE).bitwiseOR(within)


def _pairs_of_parts(own: DataFrame, crowd: int, cells: int) -> DataFrame:
    """(block, node) for each two parts of a cell that hold different roots; own: cell, node, root, of so many cells.

    A root with more than ``crowd`` rows in a cell has parts of its own, which meet the parts of other roots only:
    a large group that has joined is read once for each part of the other rows, not once for each of its own parts.
    """
    counts = own.groupBy("cell", "root").count()
    kind = F.when(F.col("count") > crowd, F.col("root")).otherwise(F.lit(-1).cast("long"))
    kinds = counts.groupBy("cell", kind.alias("kind")).agg(F.ceil(F.sum("count") / crowd).alias("parts")).groupBy("cell").agg(F.collect_list(F.struct("kind", "parts")).alias("kinds"))
    of = lambda k: F.get(F.filter("kinds", lambda x: x["kind"] == k), F.lit(0))
    rows = own.join(_small(kinds, cells), "cell").withColumn("mine", F.coalesce(of(F.col("root")), of(F.lit(-1))))
    met = rows.select("cell", "node", "mine", F.explode(F.filter("kinds", lambda x: (x["kind"] != F.col("mine.kind")) | (x["kind"] == -1))).alias("other"))
    both = met.select("cell", "node", F.xxhash64("mine.kind", F.pmod(F.xxhash64("node", "cell"), F.col("mine.parts"))).alias("x"), "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("other.parts") - 1)).alias("part"))
    return both.withColumn("y", F.xxhash64("other.kind", "part")).select(_numbered(F.least("x", "y"), F.greatest("x", "y")).alias("block"), "node")


def _mixed_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Number and rows of each block (block, node, root, ...) that has more than one root."""
    for rows in _whole_blocks(batches):
        key, root = _numbers(rows, 0, 2)
        starts = _starts(key)
        for k in np.flatnonzero(np.minimum.reduceat(root, starts[:-1]) != np.maximum.reduceat(root, starts[:-1])):
            yield int(key[starts[k]]), rows[starts[k] : starts[k + 1]]


def near_text_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, lanes: int = LANES, text: str = "text", doc_id: str = "doc_id", crowd: int = CROWD, groups: DataFrame | None = None) -> DataFrame:
    """(id, component_id) of each row of docs; texts link at a Jaccard similarity of their word shingle sets of ``similarity`` or more.

    Sets of that similarity have a known angle, and so fingerprints a known part of differing bits (about 15 % at
    0.8), which no cell around four-bit counts can span: their distances are no smaller than those of strangers. So
    the segments are single bits here, whose Manhattan distance is the Hamming distance, and the grid is that of
    ``tables``: two texts meet where all bits of one key are equal, as 99 of 100 pairs at the threshold do, and more
    above it. In a cell they are compared by the first lanes, which strangers don't pass; those that pass are
    compared over all lanes, and pairs around the angle's distance by their shingle sets.

    Each step gives no more rows than it has read, so a group of copies never emits its pairs: a text names the
    first near one of its cell; blocks that are left with several groups give one link for each two groups that
    join, or the texts in doubt, whose sets are then compared within the block. Texts of ``SHORT`` shingles at most,
    for which the angle doesn't hold, meet by the smallest hashes of their sets, as many as two sets of that
    similarity can't be without a common one of, and are compared by the sets, so none of their links is missed.

    Cells with more than ``crowd`` rows are split: by salt first, and then, if that leaves several groups in it, in
    pairs of parts of different groups, so a task never holds more than two parts of a cell.

    ``groups``, (id, component_id) with component_id the smallest id, are groups found before, such as those of
    ``simhash_groups``: their links stay, and only texts of different groups are compared. Ids occur once then.

    Equal texts are one point; texts without words link with one another only; ids are the smallest of equal
    fingerprints, null ids take no part (component null). Empty tables give empty results.
    """
    scratch = Scratch(docs.sparkSession, "near")
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t"))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for own in _in_turns(b.column(1), shingle):
                fp = [x.tobytes() for x in wide_fingerprints(own, lanes)]
                yield pa.RecordBatch.from_arrays([b.column(0)[at : at + len(own)], pa.array(fp, pa.binary()), pa.array([len(x) for x in own], pa.int64())], names=["id", "fp", "n"])
                at += len(own)

    rows = scratch.keep(texts.mapInArrow(prints, "id long, fp binary, n long"))
    points = scratch.keep(rows.groupBy("fp").agg(F.min("id").alias("id"), F.min("n").alias("n")).withColumn("node", F.monotonically_increasing_id()))
    known = points.where(F.col("id").isNotNull() & (F.col("n") > SHORT)).select("node", "fp")
    picks = tables(known.count(), similarity, lanes * 64)
    sure, most = bounds(lanes * 64, similarity)
    first_most = bounds(CARRIED * 64, similarity)[1]

    def prints_of(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, lanes)

    def keys(fp: np.ndarray) -> np.ndarray:
        """The numbers of the cells of each fingerprint, a column for each table."""
        bits = np.unpackbits(fp.view("u1").reshape(len(fp), -1), axis=1)
        return bits[:, picks] @ (1 << np.arange(picks.shape[1], dtype="i8")) + (np.arange(len(picks)) << _TABLE)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                fp = prints_of(part.column(1))
                own = [part.column(0).to_numpy(), *fp[:, :CARRIED].T.view("i8")]
                yield pa.RecordBatch.from_arrays([pa.array(keys(fp).ravel()), *(pa.array(np.repeat(x, len(picks))) for x in own)], names=["cell", "node", *names])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _whole_blocks(batches):
            key, node, *lane = _numbers(held, *range(held.num_columns))
            met, first = _first_near(key, np.stack(lane, 1).view("u8"), first_most)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[met], node[met], node[first[met]])], names=["block", "node", "first"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = pa.array(_far(prints_of(b.column(2)), prints_of(b.column(3))) <= sure)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(near), b.column(1).filter(near)], names=["a", "b"])

    def close(block: int, root: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(a, b, differing bits) of the pairs of different roots that may be similar and meet in no earlier table."""
        table, own = block >> _TABLE, keys(fp)
        for a, b in _pairs(root):
            far = _far(fp[a], fp[b])
            a, b, far = a[far <= most], b[far <= most], far[far <= most]
            for k in range(table if len(a) else 0):
                new = own[a, k] != own[b, k]
                a, b, far = a[new], b[new], far[new]
            yield a, b, far

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of surely similar texts, one for each two groups that join, and the texts in doubt that are left."""
        for block, rows in _mixed_blocks(batches):
            node, root = _numbers(rows, 1, 2)
            found = [np.stack(x) for x in close(block, root, prints_of(rows.column(3)))]
            a, b, far = np.concatenate(found, 1)
            _, label = np.unique(root, return_inverse=True)
            link = far <= sure
            label, kept = _forest(label, a[link], b[link])
            left = ~link & (label[a] != label[b])
            x, y, doubt = node[a[link][kept]], node[b[link][kept]], node[np.unique([a[left], b[left]])]
            if n := len(x) + len(doubt):
                yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.array(np.concatenate([x, doubt])), pa.array([*y.tolist(), *[None] * len(doubt)], pa.int64())], names=["block", "a", "b"])

    def exact(batches: Iterator[pa.RecordBatch], by_fp: bool) -> Iterator[pa.RecordBatch]:
        """Links of similar sets, one for each two groups that join."""
        for block, rows in _mixed_blocks(batches):
            node, root = _numbers(rows, 1, 2)
            own = rows.column(3).combine_chunks()
            size = np.diff(own.offsets.to_numpy())
            found = [np.stack(x[:2]) for x in (close(block, root, prints_of(rows.column(4))) if by_fp else _pairs(root))]
            a, b = np.concatenate(found, 1)
            fit = np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b])
            a, b = a[fit], b[fit]
            common = _common(own, a, b)
            near = common >= similarity * (size[a] + size[b] - common)
            _, kept = _forest(np.unique(root, return_inverse=True)[1], a[near], b[near])
            if len(kept):
                yield pa.RecordBatch.from_arrays([pa.array(node[a[near][kept]]), pa.array(node[b[near][kept]])], names=["a", "b"])

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _whole_blocks(batches):
            key, root = _numbers(held, 0, 2)
            starts = _starts(key)
            own = np.minimum.reduceat(root, starts[:-1]) != np.maximum.reduceat(root, starts[:-1])
            yield from held.filter(pa.array(np.repeat(own, np.diff(starts)))).to_batches()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own in _in_turns(b.column(1), shingle):
                fp = [x.tobytes() for x in wide_fingerprints(own, lanes)]
                yield pa.RecordBatch.from_arrays([pa.array(fp, pa.binary()), pa.array([x.view("i8") for x in own], pa.list_(pa.int64()))], names=["fp", "set"])

    def sets_of(nodes: DataFrame) -> DataFrame:
        """(node, fp, set); rows of one id can have several texts."""
        ids = scratch.keep(nodes.select("node").join(points, "node").select("id").distinct())
        own = texts.join(_small(ids, ids.count()), "id").mapInArrow(sets, "fp binary, set array<long>").dropDuplicates(["fp"])
        return scratch.keep(own.join(points.select("fp", "node"), "fp").select("node", "fp", "set"))

    def crowded(placed: DataFrame) -> tuple[DataFrame, int]:
        """(cell, parts) of the cells with more than ``crowd`` rows, and how many there are."""
        many = scratch.keep(placed.groupBy("cell").count().where(F.col("count") > crowd).select("cell", F.ceil(F.col("count") / crowd).alias("parts")))
        return many, many.count()

    def by_block(df: DataFrame) -> DataFrame:
        return df.repartition("block").sortWithinPartitions("block")

    def joined(links: DataFrame) -> DataFrame:
        """(node, root) of all texts that have a link."""
        return scratch.keep(connected_components(links, scratch=scratch))

    def rooted(df: DataFrame, roots: DataFrame) -> DataFrame:
        return df.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def gathered(df: DataFrame) -> DataFrame:
        """A row for each text, with its blocks: joins by node meet no text twice. A text has a block in each table at most, in cells that are split as many as there are parts."""
        return df.groupBy("node").agg(F.collect_set("block").alias("blocks"))

    def each(df: DataFrame, *columns: str) -> DataFrame:
        return df.select(F.explode("blocks").alias("block"), "node", *columns)

    def mixed(df: DataFrame, roots: DataFrame) -> DataFrame:
        """(node, root, blocks) of the texts in blocks with several roots, and those blocks."""
        apart = by_block(each(rooted(gathered(df), roots), "root")).mapInArrow(several, "block long, node long, root long")
        return scratch.keep(apart.groupBy("node").agg(F.first("root").alias("root"), F.collect_list("block").alias("blocks")))

    def by_sets(blocks: DataFrame, few: DataFrame, roots: DataFrame) -> DataFrame:
        """Links within blocks of short texts."""
        own = each(mixed(blocks, roots).join(few.select("node", "set"), "node"), "root", "set")
        return by_block(own).mapInArrow(lambda x: exact(x, False), "a long, b long")

    def links_of(groups: DataFrame) -> DataFrame:
        """A link for each different text of a group with that of the group's smallest id."""
        at = rows.where(F.col("id").isNotNull()).join(points.select("fp", "node"), "fp").select("id", F.col("node").alias("b"))
        others = at.join(groups.where("id != component_id"), "id").select("component_id", "b").distinct()
        return others.join(at.select(F.col("id").alias("component_id"), F.col("b").alias("a")), "component_id").select("a", "b")

    def edges(roots: DataFrame) -> DataFrame:
        return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))

    # Long texts: those that are near by the first lanes, and links by all lanes.
    names = [f"lane{k}" for k in range(CARRIED)]
    placed = known.mapInArrow(cells, ", ".join(f"{x} long" for x in ["cell", "node", *names]))
    many, n = crowded(placed)
    split = placed.join(_small(many, n), "cell", "left").withColumn("block", F.when(F.col("parts").isNull(), F.col("cell")).otherwise(_numbered(_part())))
    met = scratch.keep(split.select("block", "node", *names).repartition("block").sortWithinPartitions("block", "node").mapInArrow(meet, "block long, node long, first long"))
    stars = met.where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    one, two = known.select(F.col("node").alias("a"), F.col("fp").alias("x")), known.select(F.col("node").alias("b"), F.col("fp").alias("y"))
    links = stars.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")
    roots = joined(links if groups is None else links.unionByName(links_of(groups)))
    blocks = met.select("block", "node")
    if n:
        own = scratch.keep(rooted(split.where(F.col("parts").isNotNull()).select("cell", "node"), roots))
        blocks = blocks.unionByName(_pairs_of_parts(own, crowd, n))
    left = rooted(gathered(blocks), roots).join(known, "node")
    found = scratch.keep(by_block(each(left, "root", "fp")).mapInArrow(wide, "block long, a long, b long"))
    roots = joined(edges(roots).unionByName(found.where(F.col("b").isNotNull()).select("a", "b")))

    # Short texts, and long ones in doubt: links by the sets.
    few = sets_of(points.where(F.col("id").isNotNull() & F.col("n").between(1, int(SHORT / similarity))))
    shared = F.size("set") - F.ceil(similarity * F.size("set") - 1e-9).cast("int") + 1
    shorts = few.select(F.explode(F.slice(F.array_sort("set"), F.lit(1), shared)).alias("cell"), "node")
    many, n = crowded(shorts)
    shorts = shorts.join(_small(many, n), "cell", "left")
    short = shorts.where(F.col("parts").isNull()).select(F.col("cell").alias("block"), "node")
    if n:
        split = shorts.where(F.col("parts").isNotNull())
        roots = joined(edges(roots).unionByName(by_sets(split.select(_numbered(_part()).alias("block"), "node"), few, roots)))
        own = scratch.keep(rooted(split.select("cell", "node"), roots))
        short = short.unionByName(_pairs_of_parts(own, crowd, n))
    doubt = scratch.keep(gathered(found.where(F.col("b").isNull()).select("block", F.col("a").alias("node"))))
    long = each(rooted(doubt, roots).join(sets_of(doubt), "node"), "root", "set", "fp")
    links = by_block(long).mapInArrow(lambda x: exact(x, True), "a long, b long").unionByName(by_sets(short, few, roots))
    roots = joined(edges(roots).unionByName(links))

    of = rooted(points.where(F.col("id").isNotNull()).select("node", "fp", "id"), roots)
    first = of.groupBy("root").agg(F.min("id").alias("component_id"))
    final = scratch.keep(points.select("fp").join(of.join(first, "root").select("fp", "component_id"), "fp", "left"))
    scratch.only(rows, final)
    return rows.join(final, "fp").select("id", "component_id")
