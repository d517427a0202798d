"""The index kept up to date by a stream of file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from prismlake.operators import resume
from prismlake.operators.decode import decode
from prismlake.sources import index_csv


def keep_indexed(files: DataFrame, out: str, checkpoint: str, stem: str = "index", per_chunk: int = resume.ROWS, decoders: dict | None = None) -> StreamingQuery:
    """Index each new file of a stream (file, abs_path) once: every batch leaves out what is done and appends the rest.

    A batch that is run again after a failure finds its files done. Groups of duplicates are those of a batch run.
    """

    def batch(rows: DataFrame, _: int) -> None:
        paths = [p for _, p in index_csv.chunk_files(rows.sparkSession, out, stem)]
        new = resume.not_done(rows.dropDuplicates(["file"]), index_csv.read_index(rows.sparkSession, paths))
        if not new.isEmpty():
            index_csv.write_index(decode(new, decoders), out, stem, per_chunk, append=True)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
