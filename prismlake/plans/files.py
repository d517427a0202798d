"""Text files that tasks write aside and the driver renames."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + os.path.abspath(folder))


def write_text(folder: str, name: str, parts: list[str]) -> str:
    """Write a file under a name of this attempt's own in folder/_aside, and return that name."""
    store, root = _store(folder)
    store.create_dir(f"{root}/_aside", recursive=True)
    aside = f"{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(f"{root}/_aside/{aside}", compression=None) as out:
        for p in parts:
            out.write(p.encode())
    return aside


def publish(spark: SparkSession, folder: str, files: list[tuple[str, str]]) -> list[str]:
    """Give files written aside their names; what else lies aside, from lost attempts, goes."""
    store, root = _store(folder)
    for aside, name in files:
        store.move(f"{root}/_aside/{aside}", f"{root}/{name}")
    if store.get_file_info(f"{root}/_aside").type != fs.FileType.NotFound:
        store.delete_dir(f"{root}/_aside")
    return [f"{folder.rstrip('/')}/{name}" for _, name in files]


def delete_files(spark: SparkSession, paths: list[str]) -> None:
    from prismlake.plans.scratch import delete

    delete(spark, *paths)
