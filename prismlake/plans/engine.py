"""The whole index run: list, skip what is done, decode, enrich, group, write, count facets."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from prismlake.operators import dedup, geocode, match
from prismlake.operators.decode import decode
from prismlake.operators.faces import Faces, load_faces, reference_people
from prismlake.operators.resume import ROWS, not_done
from prismlake.operators.vision import call, describe
from prismlake.plans.config import VisionConfig
from prismlake.plans.scratch import Scratch
from prismlake.sources import index_csv
from prismlake.sources.tools import Tools
from prismlake.sources.walk import media_files

_log = logging.getLogger(__name__)


@dataclass
class MediaIndex:
    """Options of a run. ``out``: the folder of the chunk files.

    ``fetch``: a geocoder, none by default; ``cells``: path of a Parquet table in which cells are kept between runs.
    ``tools``: programs for videos and HEIC pictures. ``models``: folder of the face models, or ``faces`` itself;
    ``people``: folder of reference photos. ``vision``: a service that describes pictures, which leave the cluster for
    it; used only if it has an endpoint and a model; ``ollama``: it speaks that protocol; ``tasks``: calls at once.
    ``counts`` has the numbers of the last run.
    """

    folder: str
    out: str
    stem: str = "index"
    exclude: str = ""
    resume: bool = False
    dedup_threshold: int | None = dedup.THRESHOLD
    rotate_rows: int = ROWS
    decoders: dict | None = None
    fetch: Callable[[float, float], str | None] | None = None
    cells: str | None = None
    spacing: float = geocode.SPACING
    tools: Tools | None = None
    models: str | None = None
    faces: Faces | None = None
    people: str | None = None
    vision: VisionConfig | None = None
    ollama: bool = False
    send: Callable = call
    tasks: int = 4
    counts: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        if self.dedup_threshold is not None and not 0 <= self.dedup_threshold <= 64:
            raise ValueError("dedup_threshold is from 0 to 64")

    def describes(self) -> bool:
        """Whether pictures are described: only by a service that is given and whole."""
        if self.vision is None:
            return False
        if not self.vision.usable():
            _log.warning("no descriptions: the service has no endpoint or no model")
        return self.vision.usable()

    def _placed(self, rows: DataFrame, scratch: Scratch) -> DataFrame:
        wanted = geocode.cells(rows)
        if self.cells:
            return geocode.with_places(rows, geocode.remembered(wanted, self.cells, self.fetch, self.spacing))
        none = rows.sparkSession.createDataFrame([], "lat_key long, lon_key long, place string")
        return geocode.with_places(rows, scratch.keep(geocode.resolve(wanted, none, self.fetch, self.spacing)))

    def _identified(self, rows: DataFrame, people: DataFrame | None) -> DataFrame:
        """rows with the names, unknown faces and faces of each file."""
        one = rows.where(F.size("faces") > 0).select("file", F.posexplode("faces").alias("n", "f"))
        one = one.select(F.struct("file", "n").alias("face"), F.col("f.embedding").alias("embedding"))
        if people is None:
            found = one.select("face", F.lit(None).cast("string").alias("person"))
        else:
            found = match.best_match(one, people)
        counts = match.face_counts(found.select("face.file", "face.n", "person"), order="n")
        return rows.join(counts, "file", "left")

    def rows(self, spark: SparkSession) -> DataFrame:
        """Typed rows of the files that this run is to index."""
        scratch = Scratch(spark, "index")
        files = scratch.keep(media_files(spark, self.folder, self.exclude))
        total = files.count()
        if self.resume:
            paths = [p for _, p in index_csv.chunk_files(spark, self.out, self.stem)]
            files = scratch.keep(not_done(files, index_csv.read_index(spark, paths)))
        self.counts = {"found": total, "new": files.count()}
        _log.info("%d files, %d of them new", total, self.counts["new"])
        faces = self.faces or (load_faces(self.models) if self.models else None)
        describes = self.describes()
        rows = scratch.keep(decode(files, self.decoders, self.tools, faces, describes))
        _log.info("%d files are read", self.counts["new"])
        if self.fetch:
            rows = self._placed(rows, scratch)
        if faces:
            people = scratch.keep(reference_people(spark, self.people, faces)) if self.people else None
            rows = self._identified(rows, people)
        if describes:
            seen = describe(rows.where(F.col("jpeg").isNotNull()), self.vision, self.ollama, self.tasks, self.send)
            rows = rows.join(scratch.keep(seen), "file", "left")
        rows = rows.drop("faces", "jpeg")
        if self.dedup_threshold is not None:
            keyed = rows.withColumn("__key", F.split("file", "/"))
            rows = dedup.duplicate_groups(keyed, self.dedup_threshold, "phash", ["__key"], "error").drop("__key")
        return rows

    def build(self, spark: SparkSession) -> list[str]:
        """Write the index and facets.csv beside it; the paths of the files written."""
        rows = Scratch(spark, "index").keep(self.rows(spark))
        done = rows.agg(F.count("*"), F.count("error")).first()
        self.counts |= {"rows": done[0], "errors": done[1], "chunks": 0}
        if not done[0] and self.resume:
            return []
        paths = index_csv.write_index(rows, self.out, self.stem, self.rotate_rows, self.resume)
        self.counts["chunks"] = len(paths)
        _log.info("%d rows, %d of them errors, in %d files", done[0], done[1], len(paths))
        every = [p for _, p in index_csv.chunk_files(spark, self.out, self.stem)] or paths
        return [*paths, index_csv.write_facets(index_csv.read_index(spark, every), self.out)]
