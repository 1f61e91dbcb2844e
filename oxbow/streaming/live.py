"""Keeping a catalogue current from file events, with Structured Streaming.

Events are hints (ts, path, recursive): what counts is what the disk says when they are handled. They come from any stream, such as that of
`sources.watch`, wait in keyed state until their burst has ended and no operation owns their path (`timers`), are reduced to the dirty
paths that no dirty folder covers, and are reconciled: present files are upserted, vanished ones deleted with everything below. Doing so
twice changes nothing, so late and repeated events do no harm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..checkpoint import cut
from ..functions.text import ancestors
from ..operators.delta import upsert
from ..sources.tree import PRUNED, SKIPPED_NAMES
from . import timers
from .timers import STORM
from .timers import defer as defer

QUIET, LONGEST = f"{timers.QUIET_MS} milliseconds", f"{timers.LONGEST_MS} milliseconds"
EXCLUDED = [*PRUNED, *SKIPPED_NAMES]  # names whose events never count, at any level


def bursts(events: DataFrame, time: str = "ts", quiet: str = QUIET, *keys: str) -> DataFrame:
    """(keys, n, first, last) of runs of events without a pause longer than `quiet`; works on streams with a watermark too."""
    window = F.session_window(time, quiet)
    grouped = events.groupBy(*keys, window.alias("__burst"))
    found = grouped.agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))
    return found.drop("__burst")


def excluded(path: Column, names: list[str] = EXCLUDED) -> Column:
    return F.exists(F.split(path, "/"), lambda p: p.isin(names) | p.startswith("._"))


def subsume(marks: DataFrame) -> DataFrame:
    """Dirty marks (path, recursive) that no recursive mark above them, or at the same path, covers. The empty path is the root."""
    distinct = marks.groupBy("path").agg(F.max("recursive").alias("recursive"))
    roots = distinct.where("recursive").select(F.col("path").alias("root"))
    above = F.array_union(F.when(F.col("path") != "", F.array(F.lit(""))).otherwise(F.array().cast("array<string>")), ancestors(F.col("path")))
    covered = distinct.select("path", F.explode(above).alias("root")).join(roots, "root").select("path").distinct()
    return distinct.join(covered, "path", "left_anti")


def storm(marks: DataFrame, most: int = STORM) -> DataFrame:
    """(n_points, rescan): whether so many paths are dirty that looking at the whole tree is better."""
    return marks.agg(F.count(F.lit(1)).alias("n_points")).withColumn("rescan", F.col("n_points") > most)


def at_or_below(path: Column, marks: list[str]) -> Column:
    """Whether a path is one of some marks or lies below one; the empty mark is the root."""
    if "" in marks:
        return F.lit(True)
    above = F.array_union(F.array(path), ancestors(path))
    return F.arrays_overlap(above, F.array(*map(F.lit, marks)).cast("array<string>"))


def gone(catalog: DataFrame, marks: list[str], found: DataFrame) -> DataFrame:
    """Paths of `catalog` at or below a mark that are not in `found`."""
    return catalog.where(at_or_below(F.col("path"), marks)).select("path").join(found.select("path"), "path", "left_anti")


def reconcile(catalog: DataFrame, marks: list[str], found: DataFrame) -> DataFrame:
    """`catalog` after looking at the dirty marks: `found` has the rows now at or below them.

    Rows at or below a mark leave unless found again; found rows replace their own. Excluded paths count as gone, even where they are
    found, and what lies outside all marks stays.
    """
    found = found.where(~excluded(F.col("path")) & at_or_below(F.col("path"), marks))
    return upsert(catalog.join(gone(catalog, marks, found), "path", "left_anti").select(*catalog.columns), found)


def look_below(spark: SparkSession, root: str, **options) -> Callable[[DataFrame], DataFrame]:
    """A `look` for `follow`: catalogue rows of the files now at or below the marks of a tree. Only the marks are walked, in tasks."""

    def look(marks: DataFrame) -> DataFrame:
        from ..sources.catalogue import derive
        from ..sources.extract import describe
        from ..sources.tree import walk

        return derive(describe(walk(spark, root, start=marks.select("path"), strict=True, **options), root))

    return look


def follow(
    events: DataFrame,
    store,
    look: Callable[[DataFrame], DataFrame],
    checkpoint: str,
    trigger: dict | None = None,
    name: str = "oxbow",
    most: int = STORM,
):
    """Start a query that reconciles `store` (see sources.store.Store) with events, batch by batch.

    events: (path, recursive), which are handled as they come; or (ts, path, recursive), which are handled when their burst has ended; or
    a whole log with operations and pauses (see `timers`). `look(marks)` returns the catalogue rows now at or below the marks, and
    must raise where something can not be read: the batch then fails and is tried again, rather than emptying the catalogue. One query
    per checkpoint is the single writer.

    A batch reads the segments that hold its marks, which the store's record tells, and writes those of them that have changed. More than `most` marks
    become one of the root, so marks can pass the driver.
    """
    spark = events.sparkSession
    if "kind" in events.columns:
        events = timers.hold(events)
    elif "ts" in events.columns:
        events = timers.hold(timers.as_log(events.where(~excluded(F.col("path")))))

    def handle(batch: DataFrame, batch_id: int) -> None:
        marks = subsume(batch.where(~excluded(F.col("path"))).select("path", "recursive"))
        dirty = [(r["path"], r["recursive"]) for r in marks.limit(most + 1).collect()]
        if not dirty:
            return
        if len(dirty) > most:
            dirty = [("", True)]
        paths = [p for p, _ in dirty]
        segments = store.touched(dirty)
        held = store.read(only=segments)
        found = look(spark.createDataFrame(dirty, "path string, recursive boolean"))
        after = cut(reconcile(held, paths, found))
        differ, rows = store.differing(after, segments or None)
        if differ:  # hints that turn out to be nothing publish nothing
            store.publish(rows, generation=batch_id, only=differ)

    writer = events.writeStream.queryName(name).foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": LONGEST})).start()


class Health(StreamingQueryListener):
    """Watches a query by name: `state` is live, unreachable (it failed) or stopped; `changed` is called on transitions alone."""

    def __init__(self, name: str, changed: Callable[[str], None] = lambda state: None):
        self.name, self.changed, self.state, self._ids = name, changed, "stopped", set()

    def _set(self, state: str) -> None:
        if state != self.state:
            self.state = state
            self.changed(state)

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self._ids.add(event.runId)
            self._set("live")

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.runId in self._ids:
            self._set("unreachable" if event.exception else "stopped")


def resume(store, look: Callable[[DataFrame], DataFrame], spark: SparkSession) -> int:
    """After a stop or a failure: look at the whole tree once, since events may have been missed. Then start `follow` again."""
    everything = spark.createDataFrame([("", True)], "path string, recursive boolean")
    return store.publish(reconcile(store.read(), [""], look(everything)))
