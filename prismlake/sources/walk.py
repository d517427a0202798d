"""A folder tree as a DataFrame, by a Python data source: hidden names too, no directory links, pruned folders."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from prismlake.functions.media import is_supported, path_key

#: Folders deeper than this below the root aren't read.
DEPTH = 64


def _listed(path: str) -> list[os.DirEntry]:
    try:
        with os.scandir(path) as found:
            return sorted(found, key=lambda e: e.name)
    except OSError:
        return []


def _is_file(entry: os.DirEntry) -> bool:
    """Files, and links to anything but a folder, dangling ones too; not sockets, pipes and devices."""
    return not entry.is_dir() if entry.is_symlink() else entry.is_file(follow_symlinks=False)


def walk(root: str, below: str, depth: int, excluded: frozenset[str]) -> Iterator[tuple[str, str, int, float]]:
    """(relative, absolute, length, time) of the files under root/below, a folder at that depth."""
    todo = [(below, depth)]
    while todo:
        at, level = todo.pop()
        for e in _listed(os.path.join(root, at)):
            name = f"{at}/{e.name}" if at else e.name
            if e.is_dir(follow_symlinks=False):
                if e.name.lower() not in excluded and level < DEPTH:
                    todo.append((name, level + 1))
            elif _is_file(e):
                yield name, e.path, *_stat(e)


def _stat(entry: os.DirEntry) -> tuple[int, float]:
    try:
        s = entry.stat()
        return s.st_size, s.st_mtime
    except OSError:
        return 0, 0.0


class _Part(InputPartition):
    def __init__(self, below: str | None):
        self.below = below


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.excluded = frozenset(x.strip().lower() for x in options.get("exclude", "").split(",") if x.strip())

    def partitions(self):
        """One for each folder at the top, and one for the files there."""
        tops = [e.name for e in _listed(self.root) if e.is_dir(follow_symlinks=False) and e.name.lower() not in self.excluded]
        return [_Part(None), *map(_Part, tops)]

    def read(self, partition):
        if partition.below is None:
            for e in _listed(self.root):
                if not e.is_dir(follow_symlinks=False) and _is_file(e):
                    yield (e.name, e.path, *_stat(e))
        else:
            yield from walk(self.root, partition.below, 1, self.excluded)


class MediaWalk(DataSource):
    """Options: path (a folder all executors see), exclude (names of folders, comma list)."""

    @classmethod
    def name(cls):
        return "media_walk"

    def schema(self):
        return "file string, abs_path string, length long, mtime double"

    def reader(self, schema):
        return _Reader(self.options)


def media_files(spark: SparkSession, folder: str, exclude: str = "") -> DataFrame:
    """Supported files under a folder in path order."""
    from pyspark.sql import functions as F

    spark.dataSource.register(MediaWalk)
    files = spark.read.format("media_walk").option("path", folder if "://" in folder else os.path.abspath(folder)).option("exclude", exclude).load()
    return files.where(is_supported(F.col("file"))).orderBy(path_key(F.col("file")))
