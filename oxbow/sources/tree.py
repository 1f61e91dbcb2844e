"""The files of a directory tree: one row per file, links not followed.

`walk` goes in rounds. In each, the folders that are still closed are dealt out to all tasks; a task lists folder after folder, downwards,
until it has seen its budget of entries, and hands back what it has not opened. So wide folders and deep ones spread alike, and neither
the driver nor a fixed number of splits bounds the work. Every round is written to the checkpoint folder.

`TreeSource` is the same listing as a lazy data source for trees of modest size: the driver lists the top levels until there are enough folders for
`splits`, and each task walks its own.

    spark.dataSource.register(TreeSource)
    spark.read.format("oxbow-tree").option("exclude", "*.tmp").load("/data")

Unreadable folders and files become rows with an error; with `strict` they end the read, so that a caller who deletes what is not listed
never mistakes an unreadable disk for an empty one.
"""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..checkpoint import cut
from ..functions import text as X

SCHEMA = "path string, size_bytes long, mtime_s double, is_symlink boolean, symlink_target string, symlink_ok boolean, error string"
# Folders that are never entered, and names that never count.
PRUNED = [
    "_vendor", "__pycache__", ".pytest_cache", ".git", "site-packages", "node_modules", ".venv", "venv", ".mypy_cache",
    ".ipynb_checkpoints", ".ruff_cache", ".eggs", "build", "dist", ".cache",
]
SKIPPED_PREFIXES = ["._"]
SKIPPED_NAMES = [".DS_Store"]


@dataclass
class Split(InputPartition):
    """Folders of one task, relative to the root, and whether to descend into each."""

    folders: list[tuple[str, bool]]

    def __init__(self, folders):
        super().__init__(None)
        self.folders = folders


class Rules:
    """Which entries count: skipped prefix, pruned folder, exclude globs, include globs, in this order."""

    def __init__(self, options: dict[str, str]):
        globs = lambda key: [re.compile(X.glob_to_regex(g)) for g in options.get(key, "").split(",") if g]
        self.include, self.exclude, self.out = globs("include"), globs("exclude"), options.get("out", "")
        self.pruned = {*PRUNED, *(p for p in options.get("prune", "").split(",") if p)}

    def skipped(self, name: str) -> bool:
        return name in SKIPPED_NAMES or name.startswith(tuple(SKIPPED_PREFIXES))

    def enters(self, path: str, name: str) -> bool:
        return name not in self.pruned and not self.skipped(name) and path != self.out and not self._any(self.exclude, path)

    def counts(self, path: str, name: str) -> bool:
        return not self.skipped(name) and not self._any(self.exclude, path) and (not self.include or self._any(self.include, path))

    @staticmethod
    def _any(patterns: list[re.Pattern], path: str) -> bool:
        return any(p.match(path) or p.match(path.rsplit("/", 1)[-1]) for p in patterns)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.rules = os.path.abspath(options["path"]), Rules(options)
        self.splits, self.strict = int(options.get("splits", "32")), options.get("strict", "false") == "true"

    def _list(self, folder: str) -> tuple[list[os.DirEntry], str | None]:
        try:
            with os.scandir(os.path.join(self.root, folder)) as entries:
                return sorted(entries, key=lambda e: e.name), None
        except FileNotFoundError:
            if folder == "":
                raise  # the root itself must be there
            return [], None  # gone since its parent was listed
        except OSError as e:
            if self.strict:
                raise
            return [], f"{type(e).__name__}: {e.strerror}"

    def children(self, folder: str) -> tuple[list[tuple], list[str]]:
        """(rows, folders to enter) of one folder."""
        rows, folders = [], []
        entries, error = self._list(folder)
        if error:
            rows.append((folder, None, None, False, None, None, error))
        for entry in entries:
            path = f"{folder}/{entry.name}" if folder else entry.name
            if entry.is_dir(follow_symlinks=False):
                if self.rules.enters(path, entry.name):
                    folders.append(path)
            elif self.rules.counts(path, entry.name) and not (entry.is_symlink() and entry.name in self.rules.pruned):
                rows.append(self._row(path, entry.path))
        return rows, folders

    def mark(self, path: str) -> tuple[list[tuple], list[str]]:
        """(rows, folders to enter) of one path below the root, if the rules lead to it."""
        names = path.split("/")
        above = ["/".join(names[: i + 1]) for i in range(len(names) - 1)]
        if not all(self.rules.enters(p, p.rsplit("/", 1)[-1]) and not os.path.islink(os.path.join(self.root, p)) for p in above):
            return [], []
        if self.strict and not os.path.isdir(self.root):
            raise FileNotFoundError(f"No such file or directory: {self.root}")
        whole = os.path.join(self.root, path)
        if os.path.isdir(whole) and not os.path.islink(whole):
            return self.children(path) if self.rules.enters(path, names[-1]) else ([], [])
        if not os.path.lexists(whole) or not self.rules.counts(path, names[-1]):
            return [], []
        row = self._row(path, whole)
        return ([] if row[3] and names[-1] in self.rules.pruned else [row]), []

    def _row(self, path: str, whole: str) -> tuple:
        try:
            info = os.lstat(whole)
            link = stat.S_ISLNK(info.st_mode)
            target = os.readlink(whole) if link else None
            return path, info.st_size, info.st_mtime, link, target, os.path.exists(whole) if link else None, None
        except OSError as e:
            if self.strict and not isinstance(e, FileNotFoundError):
                raise
            return path, None, None, False, None, None, f"{type(e).__name__}: {e.strerror}"

    def partitions(self) -> list[Split]:
        shallow, open_ = [], [""]
        while open_ and len(open_) < self.splits:
            deeper = [f for folder in open_ for f in self.children(folder)[1]]
            shallow += [(folder, False) for folder in open_]
            open_ = deeper
        work = [*shallow, *((f, True) for f in open_)]
        return [Split(work[i :: self.splits]) for i in range(min(self.splits, len(work)))]

    def read(self, partition: Split) -> Iterator[tuple]:
        for start, deep in partition.folders:
            stack = [start]
            while stack:
                rows, folders = self.children(stack.pop())
                yield from rows
                stack += folders if deep else []


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "oxbow-tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


#: Entries that a task lists in a round: few at first, so that the tree is soon dealt out to all.
FIRST_BUDGET, BUDGET = 256, 100_000
_FOUND = f"{SCHEMA}, closed boolean"


def _options(root: str, options: dict) -> dict[str, str]:
    text = lambda v: str(v).lower() if isinstance(v, bool) else ",".join(v) if isinstance(v, list) else str(v)
    return {"path": root} | {k: text(v) for k, v in options.items()}


def _step(reader: TreeReader, budget: int, marks: bool):
    """Lists closed folders, or looks at marks, which may be anything or nothing; rows of files, and of folders left closed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _FOUND.split(", ")]
        schema = pa.schema(zip(names, (pa.string(), pa.int64(), pa.float64(), pa.bool_(), pa.string(), pa.bool_(), pa.string(), pa.bool_())))
        seen, out = 0, []
        for batch in batches:
            open_ = batch.column(0).to_pylist()
            while open_:
                path = open_.pop()
                if seen >= budget:
                    out.append((path, None, None, None, None, None, None, True))
                else:
                    rows, folders = reader.mark(path) if marks and path else reader.children(path)
                    seen += len(rows) + len(folders) + 1
                    open_ += folders
                    out += [(*r, False) for r in rows]
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def rounds(spark: SparkSession, root: str, start: DataFrame | None = None, budget: int = BUDGET, **options) -> Iterator[DataFrame]:
    """What each round of a walk found, by SCHEMA and `closed`; `start` has paths (path) to look at, in place of the root."""
    reader = TreeReader(_options(root, options))
    tasks = spark.sparkContext.defaultParallelism * 4
    if start is None and not os.path.isdir(reader.root):
        raise FileNotFoundError(f"No such file or directory: {reader.root}")
    frontier = spark.createDataFrame([("",)], "path string") if start is None else start.select("path").distinct()
    marks, size = start is not None, min(FIRST_BUDGET, budget)
    while True:
        found = cut(frontier.mapInArrow(_step(reader, size, marks), _FOUND))
        yield found
        closed = found.where("closed").select("path")
        left = closed.count()
        if not left:
            return
        frontier, marks, size = closed.repartition(min(left, tasks)), False, min(16 * size, budget)


def walk(spark: SparkSession, root: str, start: DataFrame | None = None, **options) -> DataFrame:
    """(path, size_bytes, mtime, is_symlink, symlink_target, symlink_ok, error, ext, category) of every file below `root`.

    With `start`, of the files at or below its paths alone; these may have gone, and count only where the rules let a walk of the root
    come to them.
    """
    parts = [p.where("not closed").drop("closed") for p in rounds(spark, root, start, **options)]
    ext = X.ext_of(F.col("path"))
    rows = reduce(DataFrame.unionByName, parts).withColumn("mtime", F.timestamp_seconds(F.floor("mtime_s"))).withColumn("ext", ext)
    rows = rows.drop("mtime_s").withColumn("category", X.category_for(F.col("ext")))
    return rows.distinct() if start is not None else rows  # marks may lie below one another
