"""Changes below a folder as a streaming source: one row for each file that was created, changed or deleted.

    spark.dataSource.register(TreeEvents)
    spark.readStream.format("oxbow-events").option("state", "/shared/state").load("/data")

Offsets are numbers of listings and a batch is the difference of two. The listing of a batch is made by its tasks, each for its own share
of the folders, and kept below `state`, a folder that the driver and all executors mount, as they mount the tree. A batch that is run again finds its
listing there and gives the same rows; a finished batch removes the listings before its own. Nothing of the tree passes the driver.

Listings are in the order of the path's names, so two are compared as they are read and neither is ever held in memory. What lies below
a folder that cannot be read is taken over from the listing before: an unplugged disk deletes nothing.
"""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .tree import Rules

EVENTS = "ts timestamp, path string, change string, recursive boolean, size_bytes long"
SPLITS, DEPTH = 32, 2

#: (path, size, time of change in ns, inode), or (folder, None, None, None) for one that could not be read.
Entry = tuple[str, int | None, int | None, int | None]


def _key(path: str) -> list[str]:
    return path.split("/") if path else []


def share_of(folder: str, splits: int) -> int:
    return zlib.crc32(folder.encode("utf-8", "surrogateescape")) % splits


def list_share(root: str, rules: Rules, split: int, splits: int, depth: int, scan: Callable = os.scandir) -> Iterator[Entry]:
    """Files of one share, in the order of their names: the folders at `depth` whose hash is the share's, with all below, and the files
    of the folders above that have its hash. The root must be there; other folders may vanish while they are listed."""

    def listed(folder: str) -> list[os.DirEntry] | None:
        try:
            with scan(os.path.join(root, folder)) as found:
                return sorted(found, key=lambda e: e.name)
        except FileNotFoundError:
            if folder == "":
                raise
            return []
        except OSError:
            if folder == "":
                raise
            return None

    open_ = [("", 0, iter(listed("")))]
    while open_:
        folder, level, entries = open_[-1]
        entry = next(entries, None)
        if entry is None:
            open_.pop()
            continue
        path = f"{folder}/{entry.name}" if folder else entry.name
        if entry.is_dir(follow_symlinks=False):
            if rules.enters(path, entry.name) and (level + 1 != depth or share_of(path, splits) == split):
                below = listed(path)
                if below is None:
                    yield path, None, None, None
                else:
                    open_.append((path, level + 1, iter(below)))
        elif (level >= depth or share_of(folder, splits) == split) and rules.counts(path, entry.name):
            try:
                info = entry.stat(follow_symlinks=False)
            except OSError:
                continue  # gone since its folder was listed
            yield path, info.st_size, max(info.st_mtime_ns, info.st_ctime_ns), info.st_ino


def take_over(entries: Iterator[Entry], before: Iterator[Entry]) -> Iterator[Entry]:
    """`entries` with the earlier entries below each folder that could not be read in place of it."""
    old = next(before, None)
    for entry in entries:
        if entry[1] is not None:
            yield entry
            continue
        key = _key(entry[0])
        while old is not None and _key(old[0])[: len(key)] < key:
            old = next(before, None)
        while old is not None and _key(old[0])[: len(key)] == key:
            yield old
            old = next(before, None)


def differences(before: Iterator[Entry], after: Iterator[Entry]) -> Iterator[tuple[str, str, int | None]]:
    """(path, change, size) between two listings in order."""
    a, b = next(before, None), next(after, None)
    while a is not None or b is not None:
        if b is None or a is not None and _key(a[0]) < _key(b[0]):
            yield a[0], "deleted", None
            a = next(before, None)
        elif a is None or _key(b[0]) < _key(a[0]):
            yield b[0], "created", b[1]
            b = next(after, None)
        else:
            if tuple(a[1:]) != tuple(b[1:]):
                yield b[0], "changed", b[1]
            a, b = next(before, None), next(after, None)


class Share(InputPartition):
    def __init__(self, split: int, splits: int, depth: int, start: int, end: int):
        super().__init__(None)
        self.split, self.splits, self.depth, self.start, self.end = split, splits, depth, start, end


class TreeEventsReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.state = os.path.abspath(options["path"]), options["state"]
        self.rules, self.existing = Rules(options), options.get("existing", "true") == "true"
        self.wanted = {"splits": int(options.get("splits", SPLITS)), "depth": max(1, int(options.get("depth", DEPTH)))}

    def _shape(self) -> dict[str, int]:
        """Number of shares and their depth, as the first start of the stream set them: listings are compared share by share."""
        path = os.path.join(self.state, "shape.json")
        if not os.path.exists(path):
            os.makedirs(self.state, exist_ok=True)
            _write(path, iter([json.dumps(self.wanted)]))
        with open(path, encoding="utf-8") as file:
            return json.loads(file.read())

    def _numbers(self) -> list[int]:
        names = os.listdir(self.state) if os.path.isdir(self.state) else []
        return sorted(int(n.removeprefix("listing-")) for n in names if n.startswith("listing-"))

    def _file(self, number: int, split: int) -> str:
        return os.path.join(self.state, f"listing-{number:012d}", f"{split:05d}.jsonl")

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        """One more than the listings made so far: every trigger looks again."""
        return {"listing": max(self._numbers(), default=0) + 1}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        if start["listing"] >= end["listing"]:
            return []
        shape = self._shape()
        return [Share(k, shape["splits"], shape["depth"], start["listing"], end["listing"]) for k in range(shape["splits"])]

    def read(self, partition: Share) -> Iterator[tuple]:
        p, after = partition, self._file(partition.end, partition.split)
        if p.start and not os.path.exists(self._file(p.start, p.split)):
            raise FileNotFoundError(f"listing {p.start} is gone from {self.state}")
        earlier = lambda: self._entries(self._file(p.start, p.split)) if p.start else iter(())
        if not os.path.exists(after):
            entries = take_over(list_share(self.root, self.rules, p.split, p.splits, p.depth), earlier())
            os.makedirs(os.path.dirname(after), exist_ok=True)
            _write(after, iter([time.time()]), entries)
        if not p.start and not self.existing:
            return
        ts = datetime.fromtimestamp(_stamp(after), timezone.utc)
        for path, change, size in differences(earlier(), self._entries(after)):
            yield ts, path, change, False, size

    @staticmethod
    def _entries(path: str) -> Iterator[Entry]:
        with open(path, encoding="utf-8", errors="surrogateescape") as file:
            next(file)
            for line in file:
                yield tuple(json.loads(line))

    def commit(self, end: dict) -> None:
        for number in self._numbers():
            if number < end["listing"]:
                shutil.rmtree(os.path.join(self.state, f"listing-{number:012d}"), ignore_errors=True)


def _write(path: str, *parts: Iterator) -> None:
    """A file that is there whole or not at all."""
    made = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(made, "w", encoding="utf-8", errors="surrogateescape") as file:
        for part in parts:
            for item in part:
                file.write((item if isinstance(item, str) else json.dumps(item)) + "\n")
    os.replace(made, path)


def _stamp(path: str) -> float:
    with open(path, encoding="utf-8", errors="surrogateescape") as file:
        return float(json.loads(next(file)))


class TreeEvents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "oxbow-events"

    def schema(self) -> str:
        return EVENTS

    def streamReader(self, schema) -> TreeEventsReader:
        return TreeEventsReader(self.options)


def changes(spark: SparkSession, root: str, state: str, **options) -> DataFrame:
    """The stream of changes below `root`, beginning with all files that are there (with existing=False: without these)."""
    spark.dataSource.register(TreeEvents)
    reader = spark.readStream.format("oxbow-events").option("state", state)
    for key, value in options.items():
        reader = reader.option(key, str(value).lower() if isinstance(value, bool) else ",".join(value) if isinstance(value, list) else value)
    return reader.load(root)
