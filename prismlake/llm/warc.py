"""WARC archives: a deterministic sharded writer, committed by temporary names and a manifest, and a reader."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from prismlake.llm.files import in_range, range_starts, read_whole, write_whole
from prismlake.plans.scratch import Scratch, new_path

#: Payload bytes of a range (one task writes it), compressed bytes at which a file is full, least bytes to be revisited.
RANGE, ROLL, LEAST = 24 << 20, 8 << 20, 100
_DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "file string, records long, bytes long, sha256 string, first_page long, last_page long"


def _record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member without a time stamp."""
    head = {"WARC-Type": kind, "WARC-Date": _DATE, **fields, "WARC-Block-Digest": "sha256:" + hashlib.sha256(block).hexdigest(), "Content-Length": str(len(block))}
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return pack.compress(text.encode()) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def _urn(page: int | None, digest: str, copy: int = 0) -> str:
    """Names differ for each row: ``copy`` numbers those of one page and payload."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page}/{digest}' + f'/{copy}' * (copy > 0))}>"


def page_record(page: int | None, url: str | None, payload: bytes, size: int, digest: str, first: int | None, revisit: bool, copy: int = 0) -> bytes:
    """The response or revisit record of a page; revisits carry the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = {
        "WARC-Record-ID": _urn(page, digest, copy), "WARC-Target-URI": quote(url, safe="/:?#[]@!$&'()*+,;=%~") if url else f"urn:page:{page}",
        "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha256:{digest}", "X-Page-ID": "" if page is None else str(page),
    }
    if revisit:
        fields |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": _urn(first, digest), "X-Refers-To-Page": str(first), "X-Payload-Length": str(size)}
    return _record("revisit" if revisit else "response", fields, http if revisit else http + payload)


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", range_bytes: int = RANGE, roll_bytes: int = ROLL) -> DataFrame:
    """Write every row of pages to folder as WARC records and return the manifest, a row for each file.

    Rows go in the order of page_id (nulls first), then digest. Ranges of about ``range_bytes`` of payload are
    written by a task each, as files that are closed at ``roll_bytes`` of compressed data (a longer record fills
    one alone). Names and bytes depend on the rows alone; files appear under their names when they are whole, and
    only those of the manifest, which is written last, count, so lost and repeated tasks leave no trace.

    Of rows with equal payloads of at least 100 bytes the one with the smallest page_id is the response, others
    revisit it; of rows that also share that page_id all but one revisit it. A null html is an empty payload, a
    null url gets a urn; rows with a null page_id revisit too, and are responses when all of their payload are.
    Pages without rows give no file. Payloads are shuffled once, and not those of revisits.
    """
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession, "warc")
    body = F.coalesce(F.col(html), F.lit(""))
    all_ = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), body.alias("html"), F.octet_length(body).cast("long").alias("n"), F.sha2(body.cast("binary"), 256).alias("digest"))
    keys = scratch.keep(all_.select("id", "n", "digest"))
    first = keys.where(F.col("n") >= LEAST).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("times")).where("times > 1 and first is not null").select("digest", "first")
    again = keys.where(F.col("n") >= LEAST).join(first, "digest").where(~F.col("id").eqNullSafe(F.col("first"))).select("id", "digest", "first").distinct()
    starts = range_starts(keys, ["id", "digest"], "n", range_bytes, scratch)
    run_of = in_range(spark, starts, F.col("id")).alias("run")
    notes = again.select(run_of, "id", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), F.lit(0).cast("long").alias("n"), "first")
    rows = all_.select(run_of, "id", "digest", F.lit(1).alias("kind"), "url", "html", "n", F.lit(None).cast("long").alias("first")).unionByName(notes)
    dealt = rows.repartitionByRange(len(starts) + 1, "run").sortWithinPartitions("run", "id", "digest", "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, parts, size, ids, at, number, last, copy = [], [], 0, [], None, 0, (None, None, None), 0

        def close() -> None:
            nonlocal parts, size, ids, number
            name = f"pages-{at:06d}-{number:04d}.warc.gz"
            head = _record("warcinfo", {"WARC-Record-ID": _urn(None, name), "WARC-Filename": name, "Content-Type": "application/warc-fields"}, b"software: prismlake\r\nformat: WARC File Format 1.1\r\n")
            write_whole(folder, name, [head, *parts])
            digest = hashlib.sha256(head)
            for p in parts:
                digest.update(p)
            known = [i for i in ids if i is not None]
            files.append((name, len(parts), size + len(head), digest.hexdigest(), min(known, default=None), max(known, default=None)))
            parts, size, ids, number = [], 0, [], number + 1

        for b in batches:
            for row in b.to_pylist():
                if row["run"] != at:
                    if parts:
                        close()
                    at, number = row["run"], 0
                key = (row["id"], row["digest"])
                if not row["kind"]:
                    last = (*key, row["first"], False)
                    continue
                repeated = last[:2] == key and last[3]
                origin = last[2] if last[:2] == key else None
                revisit = origin is not None or repeated and row["n"] >= LEAST and row["id"] is not None
                origin = row["id"] if origin is None else origin
                copy = copy + 1 if repeated else 0
                last = (*key, last[2] if last[:2] == key else None, True)
                part = page_record(row["id"], row["url"], b"" if revisit else row["html"].encode("utf-8", "surrogatepass"), row["n"], row["digest"], origin, revisit, copy)
                if parts and size + len(part) > roll_bytes:
                    close()
                parts.append(part)
                size += len(part)
                ids.append(row["id"])
        if parts:
            close()
        columns = list(zip(*files, strict=True)) or [[]] * 6
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _MANIFEST.split(", ")])

    dealt.mapInArrow(run, _MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Head and block of each gzip member of an archive; a wrong length or block digest is an error."""
    while data:
        member = zlib.decompressobj(31)
        text = member.decompress(data)
        if not member.eof:
            raise ValueError("an archive ends within a record")
        data = member.unused_data
        head, _, rest = text.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        block = rest[: int(fields["Content-Length"])]
        if rest[len(block) :] != b"\r\n\r\n" or "sha256:" + hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"]:
            raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
        yield fields, block


def read_archives(manifest: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """A row for each page record of the manifest's files: page_id, url, payload_bytes, payload_digest, record_type, refers_to, file.

    Responses' lengths and digests are taken anew from their payloads and must equal the heads; revisits have those
    of their heads. ``payloads`` adds the payload (null for revisits). A file holds ``roll_bytes`` or one record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = read_whole(folder, name)
                if hashlib.sha256(data).hexdigest() != want:
                    raise ValueError(f"{name} isn't the file of the manifest")
                out = []
                for f, block in records(data):
                    if f["WARC-Type"] == "warcinfo":
                        continue
                    page, digest, response = f["X-Page-ID"], f["WARC-Payload-Digest"].removeprefix("sha256:"), f["WARC-Type"] == "response"
                    payload = block.partition(b"\r\n\r\n")[2]
                    if response and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{name}: wrong payload digest of page {page}")
                    refers = None if response or f["X-Refers-To-Page"] == "None" else int(f["X-Refers-To-Page"])
                    out.append((int(page) if page else None, f["WARC-Target-URI"], len(payload) if response else int(f["X-Payload-Length"]), digest, f["WARC-Type"], refers, name, *([payload if response else None] * payloads)))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), *[pa.binary()] * payloads]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", *["payload"] * payloads]
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string" + ", payload binary" * payloads
    files = manifest.count()
    return manifest.select("file", "sha256").repartition(max(1, files)).mapInArrow(run, schema)


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "archives")
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS d FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS f FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND f < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND f < page_id THEN f END AS refers_to
FROM r
"""
