"""Token ids in files of their own format, compressed by a Re-Pair grammar for each shard."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from prismlake.llm.files import in_range, open_whole, range_starts, write_whole
from prismlake.plans.ordering import ranked
from prismlake.plans.scratch import Scratch, new_path

#: Text bytes of a shard, and how often a pair must occur: a rule takes 12 bytes and saves a symbol of two for each.
SHARD, TIMES = 12 << 20, 7
#: Symbols of a file's block, which has a checksum of its own.
BLOCK = 1 << 16
#: Pieces, and words that aren't cut, whose ids a worker remembers in each of two generations.
REMEMBERED = 400_000
#: Words cut at once, and pieces looked up between two looks at how many are remembered.
_TURN = 50_000
#: Bits of the hash by which places of chosen pairs are found.
_BUCKETS = 18
#: Vocabularies up to this size leave room for rules in symbols of two bytes.
_TWO_BYTES = 60_000
_MAGIC = b"RPG2"

# The normalizer and the splitter of tokenizers whose texts can be cut into pieces here, and what \s, \p{L}
# and \p{N} are among the first 256 characters.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_WIDE_SPACES, _LETTERS, _NUMBERS = "\x85\xa0", "a-zA-Zªµºà-öø-ÿÀ-ÖØ-ß", "0-9²³¹¼½¾"

# Read by Arrow's regular expressions.
_PIECE = f"[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)|[{_NUMBERS}]|[^\\t-\\r {_WIDE_SPACES}{_LETTERS}{_NUMBERS}]+"
_OTHER = r"[^\x00-\x{ff}]"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else the next from 256 on."""
    prints = [33 <= b <= 126 or 161 <= b <= 172 or b >= 174 for b in range(256)]
    return [chr(b) if prints[b] else chr(256 + b - sum(prints[:b])) for b in range(256)]


class Encoder:
    """Encodes whole texts, each different word of a batch once and each different piece of its words, remembering pieces.

    Pieces are cut as the tokenizer's own splitter does, which never lets a token span two, so ids equal those of
    the whole text. Words with characters past the first 256, which may change under normalization, or with one of
    the tokenizer's special strings go through the library, and so do whole texts under tokenizers with other rules.
    """

    def __init__(self, path: str):
        self.tokenizer, self.known, self.older = _tokenizer(path), {}, {}
        self.model, self.letters = self.tokenizer.model, dict(enumerate(_byte_letters()))
        rules = json.loads(self.tokenizer.to_str())
        split = rules["pre_tokenizer"] or {}
        steps = split.get("pretokenizers", [])
        self.whole = "|".join([_OTHER, *(re.escape(t["content"]) for t in rules["added_tokens"])])
        self.pieces = rules["normalizer"] == _NORMALIZER and [x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": _SPLIT} and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        letters = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(letters)]
        return pack(f"<{len(ids)}I", *ids)

    def _remembered(self, names: list[str], make: Callable[[str], bytes]) -> list[bytes]:
        out = []
        for lo in range(0, len(names), _TURN):
            if len(self.known) > REMEMBERED:
                self.known, self.older = {}, self.known
            turn = names[lo : lo + _TURN]
            found = list(map(self.known.get, turn))
            for k, x in enumerate(found):
                if x is None:
                    w = turn[k]
                    found[k] = self.known[w] = self.older[w] if w in self.older else make(w)
            out += found
        return out

    def _cut(self, words: pa.Array) -> pa.Array:
        """The pieces of each word, among them empty ones."""
        spaced = pc.replace_substring_regex(pc.utf8_lower(words), f"[{_WIDE_SPACES}]", " ")
        return pc.ascii_split_whitespace(pc.replace_substring_regex(spaced, _PIECE, r"\0 "))

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        whole = pc.match_substring_regex(words, self.whole)
        own = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        if len(own):  # an empty piece holds the place of each
            words, apart = pc.if_else(whole, "", words), words.take(pa.array(own)).to_pylist()
        cut = [self._cut(words[lo : lo + _TURN]) for lo in range(0, len(words), _TURN)]
        cuts = np.cumsum(np.concatenate([[0], *(np.diff(x.offsets.to_numpy()) for x in cut)]))
        coded = pa.chunked_array([x.flatten() for x in cut], pa.string()).dictionary_encode().combine_chunks()
        known, at = self._remembered(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self._piece), coded.indices.to_numpy()
        if len(own):
            at = at.copy()
            at[cuts[own]] = len(known) + np.arange(len(own))
            known += self._remembered(apart, self._whole)
        return _joined(known, at, cuts)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts): the ids of the texts one after another, and how many each text has."""
        if not self.pieces:
            return _joined([self._whole(t.as_py()) for t in texts], np.arange(len(texts)), np.arange(len(texts) + 1))
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        ids, size = self._words(coded.dictionary)
        at = coded.indices.to_numpy()
        return _gather(ids, np.cumsum(size) - size, size, at), _counts(size, at, words.offsets.to_numpy())


def _joined(known: list[bytes], at: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts) of rows made of the items ``at`` of known; row k has those from cuts[k] to cuts[k + 1]."""
    size = np.fromiter(map(len, known), "i8", len(known)) // 4
    return _gather(np.frombuffer(b"".join(known), "<u4"), np.cumsum(size) - size, size, at), _counts(size, at, cuts)


def _counts(size: np.ndarray, at: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(size[at])])[cuts])


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The stretches ``at`` of flat, one after another; stretch k has size[k] items from start[k] on."""
    sizes = size[at]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    where = np.arange(total)
    where += np.repeat(start[at] - (ends - sizes), sizes)
    return flat[where]


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """A worker's encoder, which its later tasks use too."""
    return Encoder(path)


def _chosen(value: np.ndarray, slot: np.ndarray, n: np.ndarray, bits: int, most: int) -> np.ndarray:
    """Which of the pairs to replace at once, the most frequent first: none starts with a symbol that another ends with, and their hashes differ."""
    heads, tails, slots, out = set(), set(), set(), []
    for k in np.lexsort([value, -n]).tolist():
        if len(out) == most:
            break
        v, place = int(value[k]), int(slot[k])
        x, y = v >> bits, v & ((1 << bits) - 1)
        if x in tails or y in heads or place in slots or x == y and (x in heads or y in tails):
            continue
        heads.add(x)
        tails.add(y)
        slots.add(place)
        out.append(k)
    return np.array(out, "i8")


def compress(ids: np.ndarray, first: int, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, rules): rule k, a pair of symbols, is what symbol first + k stands for.

    Each round counts all pairs and replaces frequent ones by new symbols, from the left: the most frequent, and
    with it others at least an eighth as frequent that can't overlap those taken. Rounds go on until no pair occurs
    ``times`` times, as fewer don't pay for their rule, or all symbols of two bytes are used, since wider ones would
    cost more than further rules save. Where the ids leave no room in two bytes, symbols have four.
    """
    bits, symbol_kind, pair_kind = (16, "u2", "u4") if first <= _TWO_BYTES else (32, "u4", "u8")
    seq, rules, turn, wide = ids.astype(symbol_kind), np.empty((0, 2), "i8"), 0, np.dtype(pair_kind).type
    shift = wide(2 * bits - _BUCKETS)
    while len(seq) > 1 and first + len(rules) < 1 << bits:
        pair = seq[:-1].astype(pair_kind)
        pair <<= bits
        pair |= seq[1:]
        in_order = np.sort(pair)
        cut = np.concatenate([[0], np.flatnonzero(in_order[1:] != in_order[:-1]) + 1, [len(pair)]])
        n = np.diff(cut)
        often = np.flatnonzero(n >= max(times, int(n.max()) // 8))
        if not len(often):
            break
        value, n = in_order[cut[often]], n[often]
        odd = wide((0x9E3779B97F4A7C15 * (2 * turn + 1) % 2**64 >> (64 - 2 * bits)) | 1)
        turn += 1
        value = value[_chosen(value, (value * odd) >> shift, n, bits, (1 << bits) - first - len(rules))]
        taken, table = np.zeros(1 << _BUCKETS, bool), np.zeros(1 << _BUCKETS, "i4")
        taken[(value * odd) >> shift], table[(value * odd) >> shift] = True, np.arange(len(value))
        bucket = pair * odd
        bucket >>= shift
        place = np.flatnonzero(taken[bucket])
        which = table[bucket[place]]
        same = value[which] == pair[place]
        place, which = place[same], which[same]
        start = np.flatnonzero(np.diff(place, prepend=-2) != 1)
        every = (np.arange(len(place)) - np.repeat(start, np.diff(start, append=len(place)))) % 2 == 0
        place, which = place[every], which[every]
        seq[place] = (first + len(rules) + which).astype(symbol_kind)
        rules = np.concatenate([rules, np.stack([value >> wide(bits), value & wide((1 << bits) - 1)], 1).astype("i8")])
        left = np.ones(len(seq), bool)
        left[place + 1] = False
        seq = seq[left]
    return seq, rules


def _spelled(rules: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Length of what each rule stands for, and the ids of all rules one after another. Rules whose parts are known are worked out at once."""
    needs = np.maximum.accumulate(rules.max(axis=1)) if len(rules) else np.empty(0, "i8")
    size, done, steps = np.ones(first + len(rules), "i8"), 0, []
    while done < len(rules):
        stop = int(np.searchsorted(needs, first + done))
        if stop <= done:
            raise ValueError("a rule of later rules")
        size[first + done : first + stop] = size[rules[done:stop]].sum(axis=1)
        steps.append((done, stop))
        done = stop
    start = np.cumsum(size) - size
    flat = np.concatenate([np.arange(first), np.empty(int(size[first:].sum()), "i8")])
    for lo, hi in steps:
        at = int(start[first + lo])
        ids = _gather(flat, start, size, rules[lo:hi].ravel())
        flat[at : at + len(ids)] = ids
    return size[first:], flat[first:]


def expansions(rules: np.ndarray, first: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Length and ids of what each rule stands for."""
    length, flat = _spelled(rules, first)
    return length, np.split(flat, np.cumsum(length)[:-1]) if len(length) else []


class Shard:
    """A shard's file: ids of documents one after another, readable from any place without the rest.

    Opening reads the rules and the documents' places; ``read`` and ``document`` read the blocks of the sequence
    that they need. Every part has a checksum.
    """

    def __init__(self, file: pa.NativeFile | bytes):
        self.file = pa.BufferReader(file) if isinstance(file, bytes) else file
        start = self.file.read_at(12, 0)
        n = int.from_bytes(start[4:8], "little")
        head = self.file.read_at(n, 12)
        if start[:4] != _MAGIC or zlib.crc32(head) != int.from_bytes(start[8:12], "little"):
            raise ValueError("not a shard of this format, or a damaged one")
        parts, at = json.loads(head), 12 + n
        for name, kind, count, crc in parts["arrays"]:
            size = count * np.dtype(kind).itemsize
            if name == "sequence":
                self.kind, self.count, self.from_ = np.dtype(kind), count, at
            else:
                data = self.file.read_at(size, at)
                if zlib.crc32(data) != crc:
                    raise ValueError("damaged shard")
                setattr(self, name, np.frombuffer(data, kind))
            at += size
        self.first = parts["first"]
        length, own = _spelled(self.rules.reshape(-1, 2).astype("i8"), self.first)
        if not np.array_equal(length, self.lengths):
            raise ValueError("wrong expansion lengths")
        self._flat = np.concatenate([np.arange(self.first), own])
        self._from = np.concatenate([np.arange(self.first), self.first + np.cumsum(length) - length])
        self._size = np.concatenate([np.ones(self.first, "i8"), length])

    def _symbols(self, block: int) -> np.ndarray:
        lo, hi = block * BLOCK, min(self.count, (block + 1) * BLOCK)
        data = self.file.read_at((hi - lo) * self.kind.itemsize, self.from_ + lo * self.kind.itemsize)
        if zlib.crc32(data) != self.crcs[block]:
            raise ValueError("damaged shard")
        return np.frombuffer(data, self.kind)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids from start to stop of the shard."""
        out = []
        block = max(0, int(np.searchsorted(self.before, start, side="right")) - 1)
        while stop > start and block < len(self.before) and self.before[block] < stop:
            symbols = self._symbols(block)
            ends = int(self.before[block]) + np.cumsum(self._size[symbols])
            a, b = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, stop, side="left")) + 1
            ids = _gather(self._flat, self._from, self._size, symbols[a:b])
            skip = max(0, start - int(ends[a] - self._size[symbols[a]]))
            begin = max(start, int(ends[a] - self._size[symbols[a]]))
            out.append(ids[skip : skip + stop - begin])
            block += 1
        return np.concatenate(out).astype("<u4") if out else np.empty(0, "<u4")

    def document(self, k: int) -> np.ndarray:
        """Ids of the shard's document k."""
        return self.read(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def shard_bytes(ids: np.ndarray, doc_ids: list[int | None], ends: np.ndarray, first: int) -> list[bytes]:
    """A shard's file: rules, expansion lengths, documents, the ids before each block of the sequence, and the sequence."""
    seq, rules = compress(ids, first)
    lengths, _ = _spelled(rules, first)
    size = np.concatenate([np.ones(first, "i8"), lengths])
    before = np.cumsum(np.concatenate([[0], np.add.reduceat(size[seq], np.arange(0, len(seq), BLOCK))]) if len(seq) else [0])[:-1]
    seq = seq.astype("<u2" if first + len(rules) <= 1 << 16 else "<u4")
    crcs = [zlib.crc32(seq[lo : lo + BLOCK].tobytes()) for lo in range(0, len(seq), BLOCK)]
    known = np.array([d is not None for d in doc_ids], "u1")
    arrays = {"rules": rules.ravel().astype("<u4"), "lengths": lengths.astype("<u4"), "doc_ids": np.array([d or 0 for d in doc_ids], "<i8"), "known": known, "ends": ends.astype("<i8"), "before": before.astype("<i8"), "crcs": np.array(crcs, "<u4"), "sequence": seq}
    body = [x.tobytes() for x in arrays.values()]
    head = json.dumps({"first": first, "arrays": [[k, x.dtype.str, len(x), zlib.crc32(d)] for (k, x), d in zip(arrays.items(), body, strict=True)]}).encode()
    return [_MAGIC, len(head).to_bytes(4, "little"), zlib.crc32(head).to_bytes(4, "little"), head, *body]


_MANIFEST = "shard int, file string, docs long, tokens long, symbols long, bytes long"


def write_shards(docs: DataFrame, folder: str, tokenizer: str | Callable[[], str], end: int = 1, text: str = "text", doc_id: str = "doc_id", shard_bytes_: int = SHARD) -> DataFrame:
    """Write the ids of every whole text of docs, each with ``end`` behind, and return the manifest, a row for each shard.

    ``tokenizer`` is the path of its file, or a function that gives it, which is called where the task runs.
    Shards are ranges of about ``shard_bytes_`` of text in the order of doc_id (nulls first), then CRC; rows of an
    id stay in one. A shard's task holds its ids. Names and bytes depend on the rows alone, files appear whole, and
    the manifest comes last. Null and empty texts have the end mark alone; docs without rows give no file.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "ids")
    body = F.coalesce(F.col(text), F.lit(""))
    id_ = F.col(doc_id).cast("long")
    keys = scratch.keep(docs.select(id_.alias("id"), (F.octet_length(body) + 1).cast("long").alias("n")))
    starts = range_starts(keys, ["id", "n"], "n", shard_bytes_, scratch)
    rows = docs.select(in_range(spark, starts, id_).alias("shard"), id_.alias("id"), body.alias("t"), F.crc32(body.cast("binary")).alias("crc"))
    dealt = rows.repartitionById(len(starts) + 1, "shard").sortWithinPartitions("shard", "id", "crc", F.octet_length("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer() if callable(tokenizer) else tokenizer
        encoder, at, files = _encoder(path), None, []
        first = _tokenizer(path).get_vocab_size()
        parts, counts, ids = [], [], []

        def close() -> None:
            nonlocal parts, counts, ids
            name = f"ids-{at:06d}.rpg"
            ends = np.cumsum(np.concatenate(counts))
            data = shard_bytes(np.concatenate(parts), ids, ends, first)
            write_whole(folder, name, data)
            arrays = {k: n for k, _, n, _ in json.loads(data[3])["arrays"]}
            files.append((at, name, len(ids), int(ends[-1]), arrays["sequence"], sum(map(len, data))))
            parts, counts, ids = [], [], []

        for b in batches:
            if not b.num_rows:
                continue
            got, n = encoder.batch(b.column(2))
            got, n = np.insert(got, np.cumsum(n), end), n + 1
            cuts, shards = np.concatenate([[0], np.cumsum(n)]), b.column(0).to_numpy()
            new = np.flatnonzero(np.diff(shards, prepend=shards[0] - 1, append=shards[-1] + 1))
            for lo, hi in zip(new[:-1].tolist(), new[1:].tolist(), strict=True):
                if shards[lo] != at:
                    if ids:
                        close()
                    at = int(shards[lo])
                parts.append(got[cuts[lo] : cuts[hi]])
                counts.append(n[lo:hi])
                ids += b.column(1)[lo:hi].to_pylist()
        if ids:
            close()
        columns = list(zip(*files, strict=True)) or [[]] * 6
        kinds = [pa.int32(), pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _MANIFEST.split(", ")])

    dealt.mapInArrow(run, _MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files; start counts the ids before it in all shards."""
    scratch = Scratch(manifest.sparkSession, "ids")
    files = ranked(manifest.select("shard", "file", "tokens"), ["shard"], scratch, running={"before": "tokens"}).select("file", "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with open_whole(folder, name) as file:
                    shard = Shard(file)
                    ends = shard.ends.tolist()
                    begins = [0, *ends[:-1]]
                    ids = [int(d) if k else None for d, k in zip(shard.doc_ids, shard.known, strict=True)]
                    every = shard.read(0, ends[-1])
                    crcs = [zlib.crc32(every[s:e].tobytes()) for s, e in zip(begins, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([first + s for s in begins], pa.int64()), pa.array(np.diff(ends, prepend=0), pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = max(1, min(manifest.count(), 100_000))
    return files.repartition(tasks).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    def path() -> str:
        import public_tokenizers

        return public_tokenizers.path("word_bpe_49k.json")

    folder = new_path(spark, "ids")
    manifest = write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, path)
    return read_shards(manifest, folder)
