"""A source tree as a Spark data source: spark.read.format("repo").option("repo_id", ...).load(root).

The built-in binary file source drops files whose names begin with _ or ., which
loses package files, and lists pruned directories; this one does neither.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from srcloom.functions.paths import INCLUDE_SUFFIXES, LANGUAGES, SKIP_DIRS

SCHEMA = "repo_id string, file_path string, language string, text string"
#: Levels of the tree the driver lists; what lies deeper is walked by the tasks, in so many partitions at most.
LISTED_LEVELS, MOST_PARTITIONS = 2, 1024


def file_suffix(name: str) -> str:
    stem, dot, last = name.rpartition(".")
    return "." + last.lower() if dot and stem else ""


def _kept(folder: str, dirs: list[str], names: list[str]) -> tuple[list[str], list[str]]:
    """Directories to descend into and files to keep of a folder, in a fixed order."""
    inside = sorted(x for x in dirs if x not in SKIP_DIRS and not x.startswith("."))
    return inside, [os.path.join(folder, x) for x in sorted(names) if file_suffix(x) in INCLUDE_SUFFIXES]


def walk(root: str, below: str | None = None) -> Iterator[str]:
    """Paths, relative to root, of the kept files in the folder below (root itself if none is given) and under it."""
    root = os.path.realpath(root)
    for folder, dirs, names in os.walk(below or root):
        dirs[:], files = _kept(folder, dirs, names)
        for path in files:
            yield os.path.relpath(path, root)


def shares(root: str) -> list[tuple[list[str], list[str]]]:
    """(folders, files) per partition: the folders at the last listed level and the files above them."""
    level, files = [os.path.realpath(root)], []
    for _ in range(LISTED_LEVELS):
        deeper = []
        for folder in level:
            entries = list(os.scandir(folder))
            inside, here = _kept(folder, [e.name for e in entries if e.is_dir(follow_symlinks=False)], [e.name for e in entries if e.is_file()])
            deeper += [os.path.join(folder, d) for d in inside]
            files += here
        level = deeper
    n = max(1, min(MOST_PARTITIONS, len(level) + (len(files) > 0)))
    return [(level[k::n], files[k::n]) for k in range(n)]


def load_text(path: str) -> str | None:
    """Text of a file; null unless it is strict UTF-8 without NUL.  Newlines are made universal, a BOM is kept."""
    try:
        with open(path, encoding="utf-8", newline=None) as f:
            text = f.read()
    except (OSError, UnicodeDecodeError):
        return None
    return None if "\0" in text else text


class Share(InputPartition):
    def __init__(self, folders: list[str], files: list[str]):
        self.folders, self.files = folders, files


class RepoReader(DataSourceReader):
    """Reads a tree on a file system all executors share."""

    def __init__(self, root: str, repo_id: str):
        self.root, self.repo_id = os.path.realpath(root), repo_id
        if not os.path.isdir(self.root):
            raise ValueError(f"no such folder: {root}")

    def partitions(self) -> list[Share]:
        return [Share(*x) for x in shares(self.root)]

    def read(self, partition: Share) -> Iterator[tuple]:
        paths = chain((os.path.relpath(f, self.root) for f in partition.files), *(walk(self.root, d) for d in partition.folders))
        for path in paths:
            yield self.repo_id, path.replace(os.sep, "/"), LANGUAGES.get(file_suffix(os.path.basename(path)), "unknown"), load_text(os.path.join(self.root, path))


class RepoSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repo"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RepoReader:
        root = self.options.get("path")
        if not root:
            raise ValueError("load() needs the folder")
        return RepoReader(root, self.options.get("repo_id", os.path.basename(os.path.realpath(root))))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RepoSource)
