"""The index as CSV chunk files: cells, rolling writer, reader, facets file."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from prismlake.functions import media
from prismlake.operators.dedup import shown_group
from prismlake.operators.facets import facets
from prismlake.operators.resume import ROWS, with_chunks

# The columns of the index, in order.
COLUMNS = [
    "file", "media_type", "date_taken", "gps_lat", "gps_lon", "place", "camera", "resolution", "duration", "orientation", "flash",
    "blur_score", "phash", "duplicate_group", "is_screenshot", "people", "unknown_faces", "face_count", "tags", "ocr_text", "description",
]
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])


def index_cells(rows: DataFrame) -> DataFrame:
    """The 21 text cells of each typed row; missing columns are empty, error rows have file, kind and the error as description."""
    has = set(rows.columns)
    col = lambda c: F.col(c) if c in has else F.lit(None)
    fixed = {"gps_lat": ("gps_lat", 6), "gps_lon": ("gps_lon", 6), "duration": ("duration", 1), "blur_score": ("blur", 1)}

    def cell(c: str) -> Column:
        if c in fixed:
            name, places = fixed[c]
            return media.fixed_text(col(name).cast("double"), places)
        if c == "phash":
            return media.hash_hex(col(c).cast("long"))
        if c == "duplicate_group":
            return shown_group(col(c), col("group_size"))
        if c == "people":
            return media.list_text(col(c).cast("array<string>"))
        if c in ("unknown_faces", "face_count"):
            return media.zero_blank(col(c))
        return col(c).cast("string")

    failed = col("error").isNotNull()
    plain = {c: F.coalesce(cell(c), F.lit("")) for c in COLUMNS}
    shown = {c: x if c in ("file", "media_type") else F.when(failed, F.coalesce(col("error"), F.lit("")) if c == "description" else F.lit("")).otherwise(x) for c, x in plain.items()}
    return rows.select(*(x.alias(c) for c, x in shown.items()))


def chunk_files(spark: SparkSession, folder: str, stem: str = "index") -> list[tuple[int, str]]:
    """(number, path) of each file stem_<number>.csv in the folder, by number; padded or not."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder or ".")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [f.getPath() for f in fs.listStatus(path) if f.isFile()]
    found = [(re.fullmatch(re.escape(stem) + r"_(\d+)\.csv", p.getName()), p.toString()) for p in names]
    return sorted((int(m[1]), p) for m, p in found if m)


def read_index(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All rows of chunk files as text cells; rows with another number of cells are dropped, empty cells are empty texts."""
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    reader = spark.read.option("columnPruning", "false")  # else malformed rows pass when few columns are read
    rows = reader.csv(paths, schema=SCHEMA, header=True, multiLine=True, escape='"', quote='"', mode="DROPMALFORMED", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return rows.fillna("")


def write_index(rows: DataFrame, folder: str, stem: str = "index", per_chunk: int = ROWS, append: bool = False) -> list[str]:
    """Write the cells of rows, in path order, to chunk files of ``per_chunk`` rows (0: one file stem.csv) and return their paths.

    ``append`` fills up the last chunk and goes on behind it; otherwise the old chunks go once the new ones are
    there. Each chunk is built by one task, under a temporary name, and renamed when all are whole; no rows write
    nothing.
    """
    from prismlake.plans.files import delete_files, publish, write_text

    spark, folder = rows.sparkSession, folder or "."
    old = chunk_files(spark, folder, stem)
    start, carry, kept = 1, 0, ""
    if append and old:
        start, last = old[-1]
        carry = read_index(spark, [last]).count()
        start, carry, kept = (start + 1, 0, "") if per_chunk and carry >= per_chunk else (start, carry, last)
    cells = index_cells(rows).withColumn("__key", media.path_key(F.col("file")))
    dealt = with_chunks(cells, ["__key"], per_chunk or 1 << 40, start, carry, stem)
    name = F.col("chunk_file") if per_chunk else F.lit(f"{stem}.csv")
    if kept:
        dealt = dealt.select(*COLUMNS, "row_no", name.alias("name")).unionByName(read_index(spark, [kept]).withColumn("row_no", F.monotonically_increasing_id() - (1 << 62)).withColumn("name", F.lit(kept.rpartition("/")[2])))
    else:
        dealt = dealt.select(*COLUMNS, "row_no", name.alias("name"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, text = None, []
        for b in batches:
            for name_, part in b.groupby("name", sort=False):
                if name_ != at:
                    if text:
                        yield pd.DataFrame({"aside": [write_text(folder, at, text)], "name": [at]})
                    at, text = name_, [",".join(COLUMNS) + "\n"]
                text.append(part[COLUMNS].to_csv(index=False, header=False, lineterminator="\n"))
        if text:
            yield pd.DataFrame({"aside": [write_text(folder, at, text)], "name": [at]})

    done = dealt.repartition("name").sortWithinPartitions("name", "row_no").mapInPandas(write, "aside string, name string").collect()  # a row for each file
    paths = publish(spark, folder, [(r["aside"], r["name"]) for r in done])
    if not append:
        delete_files(spark, [p for _, p in old if p.rpartition("/")[2] not in {r["name"] for r in done}])
    return paths


def index_facets(index: DataFrame) -> DataFrame:
    """Facets of the index: media_type, date_month, place, camera, resolution."""
    month = media.year_month(F.col("date_taken"))
    return facets(index, {"media_type": "media_type", "date_month": month, "place": "place", "camera": "camera", "resolution": "resolution"})


def write_facets(index: DataFrame, folder: str) -> str:
    """Write the facets as facets.csv; there are as many rows as different values."""
    from prismlake.plans.files import publish, write_text

    rows = index_facets(index)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text = ["dimension,value,count\n", *(b.to_csv(index=False, header=False, lineterminator="\n") for b in batches)]
        yield pd.DataFrame({"aside": [write_text(folder, "facets.csv", text)]})

    spark = index.sparkSession
    got = rows.coalesce(1).mapInPandas(write, "aside string").collect()
    return publish(spark, folder, [(got[0]["aside"], "facets.csv")])[0]
