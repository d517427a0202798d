"""Place names by grid cell: each cell is resolved once and remembered."""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from prismlake.functions.media import geo_cell
from prismlake.functions.parsers import place_name

#: Seconds between calls, of all tasks together.
SPACING = 1.1
_CELLS = "lat_key long, lon_key long, place string"


def service(address: str, agent: str, seconds: float = 10) -> Callable[[float, float], str | None]:
    """A fetch for ``resolve`` that asks a reverse geocoder over HTTP; coordinates leave the cluster."""

    def fetch(lat: float, lon: float) -> str | None:
        asked = urllib.parse.urlencode({"format": "json", "lat": lat, "lon": lon, "zoom": 10, "addressdetails": 1})
        request = urllib.request.Request(f"{address}?{asked}", headers={"User-Agent": agent})
        with urllib.request.urlopen(request, timeout=seconds) as got:
            text = got.read().decode("utf-8", "replace")
        json.loads(text)
        return text

    return fetch


def cells(rows: DataFrame, lat: str = "gps_lat", lon: str = "gps_lon", order: str = "file") -> DataFrame:
    """(lat_key, lon_key, lat, lon) of each cell, with the coordinates of its first row in ``order``."""
    keyed = rows.select(geo_cell(F.col(lat)).alias("lat_key"), geo_cell(F.col(lon)).alias("lon_key"), F.col(lat).alias("lat"), F.col(lon).alias("lon"), F.col(order).alias("o"))
    first = keyed.where("lat_key is not null and lon_key is not null").groupBy("lat_key", "lon_key").agg(F.min(F.struct("o", "lat", "lon")).alias("f"))
    return first.select("lat_key", "lon_key", "f.lat", "f.lon")


def resolve(wanted: DataFrame, known: DataFrame, fetch: Callable[[float, float], str | None], spacing: float = SPACING) -> DataFrame:
    """Cells with their places: known ones, and others by ``fetch``, which gives a geocoder's JSON or None.

    The service takes one call in ``spacing`` seconds, so all new cells go through one task; failed ones stay null
    and are remembered like others.
    """
    new = wanted.join(known.select("lat_key", "lon_key"), ["lat_key", "lon_key"], "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = -spacing
        for b in batches:
            out = []
            for lat, lon in zip(b["lat"], b["lon"], strict=True):
                time.sleep(max(0.0, last + spacing - time.monotonic()))
                try:
                    out.append(fetch(lat, lon))
                except Exception:
                    out.append(None)
                last = time.monotonic()
            yield b[["lat_key", "lon_key"]].assign(body=pd.Series(out, dtype=object, index=b.index))

    got = new.coalesce(1).mapInPandas(run, "lat_key long, lon_key long, body string")
    return known.select("lat_key", "lon_key", "place").unionByName(got.select("lat_key", "lon_key", place_name(F.col("body")).alias("place")))


def remembered(wanted: DataFrame, table: str, fetch: Callable[[float, float], str | None], spacing: float = SPACING) -> DataFrame:
    """All cells of the Parquet table at the path ``table``, to which new ones are added first; failed ones are kept, too."""
    spark = wanted.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    exists = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    known = spark.read.schema(_CELLS).parquet(table) if exists else spark.createDataFrame([], _CELLS)
    new = wanted.join(known.select("lat_key", "lon_key"), ["lat_key", "lon_key"], "left_anti")
    resolve(new, spark.createDataFrame([], _CELLS), fetch, spacing).write.mode("append").parquet(table)
    return spark.read.schema(_CELLS).parquet(table)


def with_places(rows: DataFrame, places: DataFrame, lat: str = "gps_lat", lon: str = "gps_lon") -> DataFrame:
    """rows with the place of their cell; null without coordinates or place."""
    near = places.select(F.col("lat_key").alias("__a"), F.col("lon_key").alias("__b"), "place")
    return rows.join(near, (geo_cell(F.col(lat)) == F.col("__a")) & (geo_cell(F.col(lon)) == F.col("__b")), "left").drop("__a", "__b")
