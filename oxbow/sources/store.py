"""Snapshots of a catalogue as ranges of paths.

A generation is a list of segments. Each holds the rows from its lowest path to the next segment's, sorted by path, about `segment_rows` of them,
so there are as many as the catalogue needs and what lies below a folder is a run of neighbours. An update writes the segments that it
touches, split anew by their rows, and keeps the others. Rows are written first and the list last, as one file put in place by a rename:
readers see all of a generation or none of it, and the second of two writers of a generation fails.

Each segment carries a digest of its rows and one of its broken links. They are sums of row hashes, so they add up to the digest of
the whole catalogue however it is cut, and a comparison with a fresh look reads only the segments that differ.
"""

from __future__ import annotations

import bisect
import json
import math
import time
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import delta
from ..operators.digest import FIELDS, add, lane_sums, root_digest
from .files import Folder

SEGMENT_ROWS = 250_000
KEPT_GENERATIONS = 8
#: Beyond this many touched segments the whole catalogue is written anew.
MANY_SEGMENTS = 256


@dataclass
class Segment:
    low: str  # paths from here to the next segment's; the first segment begins at the empty path
    place: str  # folder of its rows
    rows: int
    content: list[int] = field(default_factory=list)
    broken: list[int] = field(default_factory=list)


def segment_index(path: Column, lows: list[str]) -> Column:
    """Position of the last of some sorted lows that is not above a path (0 for all before the second), by two steps of a search."""
    side = max(1, math.isqrt(len(lows)))
    chunks = [lows[i : i + side] for i in range(0, len(lows), side)]
    array = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    below = lambda values: F.size(F.filter(values, lambda low: low <= path))
    chunk = F.greatest(below(array([c[0] for c in chunks])) - 1, F.lit(0))
    inside = F.greatest(below(F.get(F.array(*map(array, chunks)), chunk)) - 1, F.lit(0))
    return (chunk * side + inside).cast("int")


class Store:
    """Generations of one catalogue below one folder."""

    def __init__(self, spark: SparkSession, folder: str, segment_rows: int = SEGMENT_ROWS, kept: int = KEPT_GENERATIONS):
        self.spark, self.folder, self.segment_rows, self.kept = spark, folder.rstrip("/"), segment_rows, kept
        self.files = Folder(spark, self.folder)

    def generations(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.files.names("log")]

    def generation(self) -> int | None:
        return max(self.generations(), default=None)

    def entry(self, generation: int | None = None) -> dict:
        """The record of a generation; one file is read, whatever the length of the history."""
        number = self.generation() if generation is None else generation
        if number is None or not self.files.exists(f"log/{number:012d}.json"):
            raise ValueError(f"no generation {generation} in {self.folder}")
        found = json.loads(self.files.read(f"log/{number:012d}.json"))
        return found | {"segments": [Segment(**s) for s in found["segments"]]}

    def _rows(self, schema: T.StructType, places: Iterable[str]) -> DataFrame:
        paths = [f"{self.folder}/{p}" for p in places]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, generation: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The last generation, or a given one; with `only` the rows of the segments at those positions."""
        last = self.entry(generation)
        held = [s.place for i, s in enumerate(last["segments"]) if only is None or i in set(only)]
        return self._rows(T.StructType.fromJson(last["schema"]), held)

    def touched(self, marks: Iterable[tuple[str, bool]], generation: int | None = None) -> list[int]:
        """Positions of the segments that hold, or would hold, a path of `marks` (path, recursive) or anything below it.

        Marks are few (a batch of more becomes one mark of the root), and a segment's range is known from the log alone.
        """
        lows, found = [s.low for s in self.entry(generation)["segments"]], set()
        at = lambda path: max(0, bisect.bisect_right(lows, path) - 1)
        for path, _ in marks:  # a point may have been a folder
            found.add(at(path))
            first, end = (0, len(lows)) if path == "" else (at(f"{path}/"), bisect.bisect_left(lows, f"{path}0"))  # "0" follows "/"
            found.update(range(first, max(end, first + 1)))
        return sorted(found & set(range(len(lows))))

    def publish(self, catalog: DataFrame, generation: int | None = None, only: list[int] | None = None, **notes) -> int:
        """A new generation: all rows, or with `only` the rows of those segments, the others staying as they are. `notes` go into the record.

        `catalog` is evaluated once, into a staging table; the ranges are sampled from that.
        """
        before = self.generation()
        last = self.entry(before) if before is not None else None
        if only is not None and (last is None or len(only) > MANY_SEGMENTS or not last["segments"]):
            if last is not None and last["segments"]:
                others = [i for i in range(len(last["segments"])) if i not in set(only)]
                catalog = self.read(only=others).select(catalog.columns).unionByName(catalog)
            only = None
        number = max((before or 0) + 1, generation or 0)
        name = f"{number:012d}-{uuid.uuid4().hex[:8]}"
        staging = f"staging-{name}"
        catalog.write.parquet(f"{self.folder}/{staging}")
        rows = self._rows(catalog.schema, [staging])
        ranges = [""] if only is None else [last["segments"][i].low for i in only]
        parts = max(1, -(-rows.count() // self.segment_rows))
        keyed = rows.withColumn("__range", segment_index(F.col("path"), ranges)).repartitionByRange(parts, "path")
        keyed = keyed.withColumn("__part", F.spark_partition_id()).sortWithinPartitions("__range", "path")
        keyed.write.partitionBy("__range", "__part").parquet(f"{self.folder}/rows-{name}")
        made = self._measure(rows.schema, f"rows-{name}", ranges)
        self.files.remove(staging)
        stay = [] if only is None else [s for i, s in enumerate(last["segments"]) if i not in set(only)]
        segments = sorted(stay + made, key=lambda s: s.low)
        if segments:
            segments[0].low = ""
        entry = {
            "generation": number, "segments": [asdict(s) for s in segments], "schema": json.loads(catalog.schema.json()),
            "published_s": time.time(), "notes": (last["notes"] if last else {}) | notes,
        }
        if not self.files.write(f"log/{number:012d}.json", json.dumps(entry)):
            raise RuntimeError(f"generation {number} of {self.folder} was published by another writer")
        self.vacuum()
        return number

    def _measure(self, schema: T.StructType, table: str, ranges: list[str]) -> list[Segment]:
        """Segments of a table written by `publish`; the first of each range keeps the range's own low."""
        if not any(n.startswith("__range=") for n in self.files.names(table)):
            return []
        keyed = T.StructType([*schema.fields, T.StructField("__range", T.IntegerType()), T.StructField("__part", T.IntegerType())])
        rows = self.spark.read.schema(keyed).parquet(f"{self.folder}/{table}")
        found = summarise(rows, ["__range", "__part"]).orderBy("__range", "low").collect()  # a row a segment
        out, seen = [], set()
        for r in found:
            low = r["low"] if r["__range"] in seen else ranges[r["__range"]]
            seen.add(r["__range"])
            out.append(Segment(low, f"{table}/__range={r['__range']}/__part={r['__part']}", r["rows"], list(r["content"]), list(r["broken"])))
        return out

    def vacuum(self) -> None:
        """Remove records older than the kept generations, and tables that none of these refers to."""
        numbers = self.generations()
        for number in numbers[: -self.kept]:
            self.files.remove(f"log/{number:012d}.json")
        used = {s.place.split("/")[0] for n in numbers[-self.kept :] for s in self.entry(n)["segments"]}
        newest = f"rows-{max(numbers):012d}"
        for name in self.files.names():
            if name.startswith("rows-") and name not in used and name < newest:
                self.files.remove(name)

    def age_seconds(self) -> float | None:
        """Seconds since the last publication, or since the last look that found nothing new, to decide whether to look first."""
        if self.generation() is None:
            return None
        looked = float(self.files.read("looked")) if self.files.exists("looked") else 0.0
        return time.time() - max(self.entry()["published_s"], looked)

    def looked(self) -> None:
        self.files.write("looked", str(time.time()), replace=True)

    def digest(self, generation: int | None = None) -> str:
        """Digest of a generation's content, from its record alone."""
        segments = self.entry(generation)["segments"]
        return root_digest(sum(s.rows for s in segments), add(s.content for s in segments))

    def differing(self, current: DataFrame, only: list[int] | None = None) -> tuple[list[int], DataFrame]:
        """(positions of the segments whose content or broken links differ from a fresh look, the rows of the look that lie in these).

        With `only` the look is at the ranges of those segments. Only digests are compared: nothing of the store but its last record is read.
        """
        segments = self.entry()["segments"]
        lows = [s.low for s in segments] or [""]
        placed = current.withColumn("__at", segment_index(F.col("path"), lows))
        fresh = {r["__at"]: r for r in summarise(placed, ["__at"]).collect()}  # a row a segment
        asked = range(len(lows)) if only is None else only
        differ = [i for i in asked if _summary(segments[i] if segments else None) != _summary(fresh.get(i))]
        rows = placed.where(F.col("__at").isin(differ)) if differ else placed.limit(0)
        return differ, rows.drop("__at")

    def compare(self, current: DataFrame) -> tuple[DataFrame, list[int]]:
        """((path, change) between the last generation and a fresh look, positions of the segments that were read for it).

        Differences are those of `delta.diff` and `delta.health_flips`; equal segments are not read, so equal catalogues read nothing.
        """
        differ, new = self.differing(current)
        old = self.read(only=differ)
        changes = delta.diff(old, new)
        if {"is_symlink", "symlink_ok"} <= set(current.columns):
            changes = changes.union(delta.health_flips(old, new))
        return changes, differ

    def refresh(self, current: DataFrame, **notes) -> bool:
        """Publish a fresh look, the segments that differ alone; whether there were any. `current` is evaluated more than once."""
        if self.generation() is None:
            return bool(self.publish(current, **notes))
        differ, new = self.differing(current)
        if not differ:
            self.looked()
            return False
        return bool(self.publish(new, only=differ, **notes))


def _summary(row) -> tuple:
    """What tells a segment, or a group of `summarise`, apart from another."""
    if row is None:
        return 0, add([]), add([])
    values = asdict(row) if isinstance(row, Segment) else row.asDict()
    return values["rows"], list(values["content"]), list(values["broken"])


def summarise(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by.., low, rows, content, broken): least path, number of rows and digests of each group."""
    columns = rows.columns
    fields = [f for f in FIELDS if f in columns]
    broken = F.col("is_symlink") & ~F.col("symlink_ok") if {"is_symlink", "symlink_ok"} <= set(columns) else F.lit(False)
    return lane_sums(rows, by, {"content": (fields, F.lit(True)), "broken": (["path"], broken)}, F.min("path").alias("low"), F.count(F.lit(1)).alias("rows"))
