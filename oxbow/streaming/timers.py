"""When an event may be handled: bursts that must end, operations that own their paths, pauses. As keyed state with timers, and as a batch.

A log has one row for each thing that happened:

    ts, kind, path, recursive, op, lease_until
    kind event   something changed at `path` (with `recursive`: or below it)
    kind own     operation `op` begins to work at `path` (with `recursive`: and below it), until it retires or its lease ends
    kind retire  operation `op` is done
    kind pause   events are kept back from now on
    kind resume  ..and are let go: one look at the whole tree takes the place of everything kept back

An event at an owned path is due half a second after the last of its owners is gone. Others are due when their burst has been quiet for
QUIET_MS, or LONGEST_MS after it began. State is keyed by a hash of the top folder, so no task sees the events of the whole tree; what
concerns all of it goes to every key. Timers by the clock end bursts and leases though no further event comes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import ancestors

# The quiet time that ends a burst, its longest life, how long after an operation its events drain, and how many events
# of one key make a look at the whole tree cheaper.
QUIET_MS, LONGEST_MS, DRAIN_MS, STORM = 300, 2_000, 500, 10_000
SHARDS = 32
#: Ended operations are remembered so long, for events that come late.
REMEMBERED_MS = 60_000

LOG = "ts timestamp, kind string, path string, recursive boolean, op string, lease_until timestamp"
DUE = "path string, recursive boolean, ts timestamp, drain_at timestamp"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def as_log(events: DataFrame) -> DataFrame:
    """A log of plain events (ts, path, recursive)."""
    none = F.lit(None)
    return events.select("ts", F.lit("event").alias("kind"), "path", "recursive", none.cast("string").alias("op"), none.cast("timestamp").alias("lease_until"))


def sharded(log: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The log with `shard`; rows that concern the whole tree, and ends of operations, come once for each."""
    top = F.pmod(F.xxhash64(F.substring_index("path", "/", 1)), F.lit(shards)).cast("int")
    everywhere = F.col("kind").isin("retire", "pause", "resume") | ((F.col("kind") == "own") & (F.col("path") == ""))
    at = F.when(everywhere, F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array(top))
    return log.select("*", F.explode(at).alias("shard"))


class Hold(StatefulProcessor):
    """State of one key: the running burst, events of owned paths with their owners, operations, whether it is paused."""

    def __init__(self, most: int = STORM):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.burst = handle.getListState("burst", "ts long, path string, recursive boolean")
        self.parked = handle.getListState("parked", "ts long, path string, recursive boolean, ops string")
        self.owners = handle.getMapState("owners", "op string", "root string, subtree boolean, since long, end long")
        self.paused = handle.getValueState("paused", "paused boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        records = sorted((r for batch in rows for r in batch.itertuples(index=False)), key=lambda r: (r.ts, r.kind == "event"))
        burst, parked, owners = list(self._all(self.burst)), list(self._all(self.parked)), dict(self._owners())
        paused, out = self.paused.exists() and self.paused.get()[0], []
        for r in records:
            if r.kind == "own":
                owners[r.op] = (r.path, bool(r.recursive), _ms(r.ts), _ms(r.lease_until))
            elif r.kind == "retire" and r.op in owners:
                root, subtree, since, end = owners[r.op]
                owners[r.op] = (root, subtree, since, min(end, _ms(r.ts)))
        for r in records:
            if r.kind == "pause":
                paused = True
            elif r.kind == "resume":
                paused, burst, parked = False, [], []
                if key[0] == 0:
                    out.append(("", True, _ms(r.ts), _ms(r.ts)))
            elif r.kind == "event":
                ts, event = _ms(r.ts), (_ms(r.ts), r.path, bool(r.recursive))
                ops = [op for op, (root, subtree, since, end) in owners.items() if since <= ts <= end and _owned(r.path, root, subtree)]
                if ops:
                    parked.append((*event, json.dumps(ops)))
                    continue
                if burst and not paused and ts >= _flush(burst):
                    out += [(p, d, t, _flush(burst)) for t, p, d in burst]
                    burst = []
                burst.append(event)
                if len(burst) > self.most or burst[0][1:] == ("", True):  # too many to look at one by one: the first and last time stay
                    burst = [(burst[0][0], "", True), (ts, "", True)]
        if len(parked) > self.most:
            ops = sorted({op for *_, o in parked for op in json.loads(o)})
            parked = [(parked[0][0], "", True, json.dumps(ops))]
        self.paused.update((bool(paused),))
        yield self._settle(timerValues.getCurrentProcessingTimeInMs(), burst, parked, owners, bool(paused), out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        paused = self.paused.exists() and bool(self.paused.get()[0])
        state = list(self._all(self.burst)), list(self._all(self.parked)), dict(self._owners())
        yield self._settle(timerValues.getCurrentProcessingTimeInMs(), *state, paused, [])

    def _settle(self, now: int, burst: list, parked: list, owners: dict, paused: bool, out: list) -> pd.DataFrame:
        """Let go what is due, keep the rest, and set a timer for the next that will be."""
        waiting = []
        if not paused:
            if burst and now >= _flush(burst):
                out, burst = out + [(p, d, t, _flush(burst)) for t, p, d in burst], []
            stay = []
            for t, p, d, ops in parked:
                due = max((owners[op][3] for op in json.loads(ops) if op in owners), default=t - DRAIN_MS) + DRAIN_MS
                if now >= due:
                    out.append((p, d, t, due))
                else:
                    stay.append((t, p, d, ops))
                    waiting.append(due)
            parked = stay
            if burst:
                waiting.append(_flush(burst))
        needed = {op for *_, ops in parked for op in json.loads(ops)}
        for op, value in list(owners.items()):
            if op in needed or value[3] + REMEMBERED_MS > now:
                self.owners.updateValue((op,), value)
            else:
                self.owners.removeKey((op,))
        for state, values in ((self.burst, burst), (self.parked, parked)):
            state.put(values) if values else state.clear()
        set_ = set(self.handle.listTimers())
        due = {max(min(waiting), now + 1)} if waiting else set()
        for timer in set_ - due:
            self.handle.deleteTimer(timer)
        for timer in due - set_:
            self.handle.registerTimer(timer)
        made = pd.DataFrame(out, columns=["path", "recursive", "ts", "drain_at"])
        return made.assign(ts=pd.to_datetime(made["ts"], unit="ms"), drain_at=pd.to_datetime(made["drain_at"], unit="ms")).astype({"recursive": bool})

    @staticmethod
    def _all(state) -> Iterator[tuple]:
        return (tuple(row) for row in state.get()) if state.exists() else iter(())

    def _owners(self) -> Iterator[tuple]:
        return ((key[0], tuple(value)) for key, value in self.owners.iterator()) if self.owners.exists() else iter(())

    def close(self) -> None:
        pass


def _ms(ts) -> int:
    return int(pd.Timestamp(ts).value // 1_000_000)


def _flush(burst: list) -> int:
    times = [t for t, *_ in burst]
    return min(max(times) + QUIET_MS, min(times) + LONGEST_MS)


def _owned(path: str, root: str, subtree: bool) -> bool:
    return path == root or subtree and (root == "" or path.startswith(f"{root}/"))


def hold(log: DataFrame, shards: int = SHARDS, most: int = STORM) -> DataFrame:
    """A stream of DUE rows from a stream of a log: each event once, when it may be handled. More than `most` waiting events of one
    key become a mark of the whole tree, so state is bounded."""
    conf = log.sparkSession.conf
    if "RocksDB" not in conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    keyed = sharded(log, shards).groupBy("shard")
    return keyed.transformWithStateInPandas(Hold(most), outputStructType=DUE, outputMode="Append", timeMode="ProcessingTime")


def owners_of(log: DataFrame) -> DataFrame:
    """(root, subtree, since, lease_until, retired_at) of the operations of a log."""
    retired = log.where("kind = 'retire'").groupBy("op").agg(F.min("ts").alias("retired_at"))
    owns = log.where("kind = 'own'").select("op", F.col("path").alias("root"), F.col("recursive").alias("subtree"), F.col("ts").alias("since"), "lease_until")
    return owns.join(retired, "op", "left").drop("op")


def defer(events: DataFrame, owners: DataFrame, drain_seconds: float = DRAIN_MS / 1000) -> DataFrame:
    """Events with `drain_at`: when they may be handled, if operations in progress own their paths.

    owners: (root, subtree, lease_until, retired_at), and `since` where they began. An event at an owned path waits until its last owner
    retires (or its lease ends) and a little longer; an unowned one may be handled at once (its own ts).
    """
    owned = owned_until(events, owners, drain_seconds)
    return owned.withColumn("drain_at", F.coalesce("__until", F.col("ts"))).drop("__until")


def owned_until(events: DataFrame, owners: DataFrame, drain_seconds: float = DRAIN_MS / 1000) -> DataFrame:
    """Events with `__until`: when the last owner of their path lets them go; null where none does."""
    at = F.array_union(F.array(F.col("path"), F.lit("")), ancestors(F.col("path")))
    ends = F.least(F.coalesce("retired_at", "lease_until"), F.col("lease_until"))
    since = F.col("since") if "since" in owners.columns else F.lit(None).cast("timestamp")
    own = owners.select(F.col("root").alias("__root"), "subtree", since.alias("__since"), ends.alias("__end"))
    hit = events.select("ts", "path", F.explode(at).alias("__root")).distinct().join(own, "__root")
    hit = hit.where((F.col("subtree") | (F.col("path") == F.col("__root"))) & (F.col("ts") <= F.col("__end")))
    last = hit.where("__since is null or __since <= ts").groupBy("ts", "path").agg(F.max("__end").alias("__end"))
    wait = F.expr(f"interval {drain_seconds} seconds")
    return events.join(last, ["ts", "path"], "left").withColumn("__until", F.col("__end") + wait).drop("__end")


def capped_bursts(times: Column) -> Column:
    """Bursts (first, last) of a sorted array of times in milliseconds that lie less than QUIET_MS apart: each at most LONGEST_MS long."""

    def step(found: Column, t: Column) -> Column:
        own = F.element_at(found, -1)
        longer = F.concat(F.slice(found, 1, F.size(found) - 1), F.array(F.struct(own["first"].alias("first"), t.alias("last"))))
        return F.when(F.size(found) == 0, F.array(F.struct(t.alias("first"), t.alias("last")))).otherwise(
            F.when(t < own["first"] + LONGEST_MS, longer).otherwise(F.concat(found, F.array(F.struct(t.alias("first"), t.alias("last")))))
        )

    return F.aggregate(times, F.array().cast("array<struct<first:bigint,last:bigint>>"), step)


#: Events of one key and so long a time are looked at by one task.
BLOCK_MS = 600_000


def _runs(events: DataFrame) -> DataFrame:
    """`events` (shard, ms, ..) with `run`: when the run of events began that lie less than QUIET_MS apart.

    Only events of one block of time meet in a task; from block to block go its last event and the last beginning of a run.
    """
    within = Window.partitionBy("shard", "block").orderBy("ms")
    placed = events.withColumn("block", F.floor(F.col("ms") / BLOCK_MS))
    blocks = placed.groupBy("shard", "block").agg(F.max("ms").alias("last"))
    earlier = Window.partitionBy("shard").orderBy("block")  # a row a block
    blocks = blocks.withColumn("before", F.lag("last").over(earlier)).drop("last")
    gaps = placed.join(blocks, ["shard", "block"]).withColumn("gap", F.col("ms") - F.coalesce(F.lag("ms").over(within), F.col("before")))
    begun = gaps.withColumn("begins", F.when(F.coalesce(F.col("gap") >= QUIET_MS, F.lit(True)), F.col("ms"))).drop("gap", "before")
    carried = begun.groupBy("shard", "block").agg(F.max("begins").alias("own"))
    carried = carried.withColumn("carried", F.last("own", ignorenulls=True).over(earlier.rowsBetween(Window.unboundedPreceding, -1))).drop("own")
    own = F.max("begins").over(within.rangeBetween(Window.unboundedPreceding, 0))
    return begun.join(carried, ["shard", "block"]).withColumn("run", F.coalesce(own, F.col("carried"))).drop("begins", "carried", "block")


def drain_times(log: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(path, recursive, ts, drain_at) of every event of a log without pauses: the same times as `hold` gives, as a batch.

    Of a run without a pause the distinct milliseconds are one row, since where one burst ends decides where the next begins.
    """
    events = log.where("kind = 'event'").select("ts", "path", "recursive")
    parted = owned_until(events, owners_of(log))
    owned = parted.where("__until is not null").select("path", "recursive", "ts", F.col("__until").alias("drain_at"))
    free = sharded(as_log(parted.where("__until is null")), shards).select("shard", "path", "recursive", "ts", F.unix_millis("ts").alias("ms"))
    runs = _runs(free)
    spans = runs.groupBy("shard", "run").agg(F.array_sort(F.collect_set("ms")).alias("times"))
    spans = spans.select("shard", "run", F.inline(capped_bursts(F.col("times"))))
    timed = runs.join(spans, ["shard", "run"]).where("ms between first and last")
    due = F.timestamp_millis(F.least(F.col("last") + QUIET_MS, F.col("first") + LONGEST_MS))
    return owned.unionByName(timed.select("path", "recursive", "ts", due.alias("drain_at")))
