import json
import os
import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from oxbow.operators.delta import sweep
from oxbow.sources import catalogue, watch
from oxbow.sources.tree import Rules
from oxbow.streaming import live, timers


def test_events_keep_the_catalogue_current(spark, tmp_path):
    root, inbox, state = tmp_path / "tree", tmp_path / "events", str(tmp_path / "state")
    os.makedirs(root / "a" / "b")
    os.makedirs(inbox)
    for name in ("a/1.md", "a/b/2.md", "a/b/3.md", "top.md"):
        (root / name).write_text("# x\n")
    store = catalogue.Store(spark, str(tmp_path / "store"))
    store.publish(catalogue.build(spark, str(root)))

    def look(marks):
        found = catalogue.build(spark, str(root), strict=True)
        at = F.concat(F.array(F.lit(""), F.col("path")), live.ancestors(F.col("path")))
        named = found.select("path", F.explode(at).alias("mark")).join(marks.select(F.col("path").alias("mark")), "mark")
        return found.join(named.select("path").distinct(), "path", "left_semi").select(*found.columns)

    (root / "a" / "new.md").write_text("# new\n")
    (root / "a" / "1.md").write_text("# changed title\n")
    os.remove(root / "a" / "b" / "2.md")
    (root / "top.md").write_text("# not announced\n")
    events = [("a/new.md", False), ("a/1.md", False), ("a/b", True), ("a/b/2.md", False), (".git/x", False), ("gone/never", False)]
    (inbox / "1.json").write_text("\n".join(json.dumps({"path": p, "recursive": r}) for p, r in events))
    stream = spark.readStream.schema("path string, recursive boolean").json(str(inbox))
    live.follow(stream, store, look, state, {"availableNow": True}).awaitTermination()
    rows = {r.path: json.loads(r.meta) for r in store.read().collect()}
    assert set(rows) == {"a/1.md", "a/new.md", "a/b/3.md", "top.md"}
    assert rows["a/1.md"]["h1_title"] == "changed title" and rows["top.md"]["h1_title"] == "x"

    generation = store.generation()
    (inbox / "2.json").write_text(json.dumps({"path": ".DS_Store", "recursive": False}))
    live.follow(stream, store, look, state, {"availableNow": True}).awaitTermination()
    assert store.generation() == generation  # nothing to do, nothing published


SCHEMA = "path string, size_bytes long"


def rows_of(store):
    return {r.path: r.size_bytes for r in store.read().collect()}


def at_marks(spark, disk):
    """A look at a disk that is a dict."""

    def look(marks):
        paths = [r.path for r in marks.collect()]
        found = [(p, n) for p, n in disk.items() if any(m in ("", p) or p.startswith(f"{m}/") for m in paths)]
        return spark.createDataFrame(found, SCHEMA)

    return look


def test_only_touched_segments_are_read_and_written(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    disk = {f"d{i % 4}/{i:03d}": i for i in range(80)} | {"d1-x": 7}
    store = catalogue.Store(spark, str(tmp_path / "store"), segment_rows=10)
    store.publish(spark.createDataFrame(list(disk.items()), SCHEMA))
    first = {s.low: s.place for s in store.entry()["segments"]}
    assert len(first) >= 8 and rows_of(store) == disk
    disk["d1/001"] = 1001
    del disk["d3/003"]
    disk |= {"d1/0015": 15, "zz/new": 1}
    reads = []
    read = store.read
    store.read = lambda generation=None, only=None: reads.append(only) or read(generation, only)
    stream = spark.readStream.schema("path string, recursive boolean").json(str(inbox))
    (inbox / "1.json").write_text("\n".join(json.dumps({"path": p, "recursive": False}) for p in ("d1/001", "d3/003", "d1/0015", "zz")))
    live.follow(stream, store, at_marks(spark, disk), str(tmp_path / "cp"), {"availableNow": True}, "b").awaitTermination()
    store.read = read
    second = {s.low: s.place for s in store.entry()["segments"]}
    assert rows_of(store) == disk
    assert len([low for low in first if second.get(low) != first[low]]) <= 3 and reads and all(len(only) <= 3 for only in reads)
    for path in [p for p in disk if p.startswith("d2/")]:
        del disk[path]
    (inbox / "2.json").write_text(json.dumps({"path": "d2", "recursive": True}))
    live.follow(stream, store, at_marks(spark, disk), str(tmp_path / "cp"), {"availableNow": True}, "b").awaitTermination()
    assert rows_of(store) == disk and "d1-x" in disk
    generation = store.generation()
    (inbox / "3.json").write_text(json.dumps({"path": "d1/001", "recursive": False}))
    live.follow(stream, store, at_marks(spark, disk), str(tmp_path / "cp"), {"availableNow": True}, "b").awaitTermination()
    assert store.generation() == generation  # a hint, but nothing had changed
    marks, found = ["d1/.git"], spark.createDataFrame([("d1/.git/x", 1), ("elsewhere", 2)], SCHEMA)
    assert live.reconcile(store.read(), marks, found).where("path in ('d1/.git/x', 'elsewhere')").isEmpty()  # excluded, and not below a mark


def test_random_updates_of_a_store(spark, tmp_path):
    """Any sequence of updates leaves the rows of a plain dict, the digest of a fresh store, and few tables."""
    rng, disk = random.Random(2), {}
    store = catalogue.Store(spark, str(tmp_path / "store"), segment_rows=6, kept=2)
    store.publish(spark.createDataFrame([], SCHEMA))
    for turn in range(6):
        marks = [("/".join(rng.choice("ab-z") for _ in range(rng.randrange(1, 4))), True) for _ in range(2)]
        for path in [p for p in disk if any(p == m or p.startswith(f"{m}/") for m, _ in marks)]:
            del disk[path]
        for m, _ in marks:
            if not any(m.startswith(f"{p}/") or p.startswith(f"{m}/") for p in disk):
                disk |= {f"{m}/{rng.randrange(90)}x": turn for _ in range(8)}
        held = store.touched(marks)
        after = live.reconcile(store.read(only=held), [m for m, _ in marks], at_marks(spark, disk)(spark.createDataFrame(marks, "path string, r boolean")))
        store.publish(after, only=held)
        assert rows_of(store) == disk
    fresh = catalogue.Store(spark, str(tmp_path / "fresh"), segment_rows=1000)
    fresh.publish(spark.createDataFrame(list(disk.items()), SCHEMA))
    assert fresh.digest() == store.digest() and len(fresh.entry()["segments"]) == 1
    assert len(store.generations()) == 2 and not [n for n in store.files.names() if n.startswith("staging")]
    lows = [s.low for s in store.entry()["segments"]]
    assert lows == sorted(set(lows)) and lows[0] == ""


def test_two_writers_of_one_generation(spark, tmp_path):
    one, two = (catalogue.Store(spark, str(tmp_path / "store")) for _ in range(2))
    frame = spark.createDataFrame([("a", 1)], SCHEMA)
    one.publish(frame)
    write = two.files.write
    two.files.write = lambda *a, **k: one.publish(frame.replace(1, 5)) and write(*a, **k)  # the other is faster
    with pytest.raises(RuntimeError, match="another writer"):
        two.publish(frame)
    assert rows_of(one) == {"a": 5}


def test_health_and_resume(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "x.md").write_text("# x\n")
    store = catalogue.Store(spark, str(tmp_path / "store"))
    store.publish(catalogue.build(spark, str(tmp_path / "tree")))
    (tmp_path / "tree" / "y.md").write_text("# y\n")
    assert live.resume(store, lambda marks: catalogue.build(spark, str(tmp_path / "tree")), spark) == 2
    assert {r.path for r in store.read().collect()} == {"x.md", "y.md"}

    seen = []
    health = live.Health("watched", seen.append)
    spark.streams.addListener(health)

    def unplugged(marks):
        raise OSError("unplugged")

    (tmp_path / "in" / "1.json").write_text(json.dumps({"path": "x.md", "recursive": False}))
    stream = spark.readStream.schema("path string, recursive boolean").json(str(tmp_path / "in"))
    query = live.follow(stream, store, unplugged, str(tmp_path / "cp"), {"availableNow": True}, "watched")
    with pytest.raises(Exception, match="unplugged"):
        query.awaitTermination()
    until = time.time() + 20
    while len(seen) < 2 and time.time() < until:
        time.sleep(0.2)
    spark.streams.removeListener(health)
    assert seen == ["live", "unreachable"] and store.generation() == 2


def test_unreadable_root_leaves_the_catalogue(spark, tmp_path):
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "x.md").write_text("# x\n")
    store = catalogue.Store(spark, str(tmp_path / "store"))
    store.publish(catalogue.build(spark, str(tmp_path / "tree")))
    with pytest.raises(Exception, match="No such file"):
        store.publish(sweep(store.read(), catalogue.build(spark, str(tmp_path / "unplugged"), strict=True)))
    assert store.generation() == 1 and store.read().count() == 1


def test_bursts_on_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    times = ["00:00:00.0", "00:00:00.2", "00:00:00.4", "00:00:02.0"]
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"ts": f"2024-01-01T{t}", "path": "p"}) for t in times))
    stream = spark.readStream.schema("ts timestamp, path string").json(str(tmp_path / "in")).withWatermark("ts", "0 seconds")
    query = live.bursts(stream, "ts", "300 milliseconds", "path").writeStream.format("memory").queryName("bursts").outputMode("append")
    query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert [r.n for r in spark.table("bursts").collect()] == [3]


# Timers


def log_of(rows):
    return [dict(zip(("ts", "kind", "path", "recursive", "op", "lease_until"), r)) for r in rows]


def write_log(path, rows):
    text = lambda v: v.strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z" if isinstance(v, datetime) else v
    path.write_text("\n".join(json.dumps({k: text(v) for k, v in r.items() if v is not None}) for r in log_of(rows)))


def run_log(spark, inbox, checkpoint, name, shards=4, most=timers.STORM):
    stream = spark.readStream.schema(timers.LOG).json(str(inbox))
    held = timers.hold(stream, shards, most).withColumn("seen", timers.F.current_timestamp())
    return held.writeStream.format("memory").queryName(name).option("checkpointLocation", str(checkpoint)).trigger(processingTime="200 milliseconds").start()


def wait_for(spark, name, count, seconds=40):
    until = time.time() + seconds
    while time.time() < until and spark.table(name).count() < count:
        time.sleep(0.2)
    return spark.table(name).collect()


def test_held_events_come_without_further_events_and_at_the_times_of_the_batch_form(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    query = run_log(spark, inbox, tmp_path / "cp", "held")
    try:
        now = datetime.now(timezone.utc).replace(microsecond=0) + timedelta(seconds=4)
        at = lambda s: now + timedelta(seconds=s)
        rows = [
            (at(-1), "own", "a/moved", True, "1", at(9)),
            (at(0), "event", "a/moved/deep/x", False, None, None),  # until the lease of 1 ends, which never retires
            (at(-1), "own", "b/dst", False, "2", at(30)),
            (at(-1), "own", "b", True, "3", at(30)),
            (at(0.1), "event", "b/dst", False, None, None),  # until the last of 2 and 3 retires
            (at(2), "retire", None, None, "2", None),
            (at(3), "retire", None, None, "3", None),
            (at(3.2), "event", "b/later", False, None, None),  # after it retired
            *((at(k / 10), "event", f"c/{k}", False, None, None) for k in range(45)),  # never quiet: at most 2 s each
            (at(6), "event", "c/alone", False, None, None),
        ]
        write_log(inbox / "1.json", rows)
        found = wait_for(spark, "held", 49)
    finally:
        query.stop()
    log = spark.createDataFrame([tuple(r.values()) for r in log_of(rows)], timers.LOG)
    want = {(r.path, r.ts, r.drain_at) for r in timers.drain_times(log, 4).collect()}
    assert {(r.path, r.ts, r.drain_at) for r in found} == want and len(found) == 49
    due = {r.path: r.drain_at.replace(tzinfo=None) for r in found}
    utc = lambda s: at(s).astimezone().replace(tzinfo=None)
    assert due["a/moved/deep/x"] == utc(9.5) and due["b/dst"] == utc(3.5) and due["b/later"] == utc(3.5)
    assert due["c/0"] == utc(2) and due["c/20"] == utc(4) and due["c/44"] == utc(4.7) and due["c/alone"] == utc(6.3)
    late = [(r.seen - r.drain_at).total_seconds() for r in found if r.path in ("a/moved/deep/x", "c/alone")]
    assert all(-0.5 <= s < 8 for s in late), late


def test_pause_resume_and_storm(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    query = run_log(spark, inbox, tmp_path / "cp", "paused", most=20)
    try:
        old = datetime(2024, 1, 1, tzinfo=timezone.utc)
        at = lambda s: old + timedelta(seconds=s)
        write_log(inbox / "1.json", [(at(0), "pause", None, None, None, None), (at(1), "event", "a/1", False, None, None), (at(2), "event", "b/1", False, None, None)])
        time.sleep(6)
        assert spark.table("paused").count() == 0
        write_log(inbox / "2.json", [(at(9), "resume", None, None, None, None)])
        assert [(r.path, r.recursive) for r in wait_for(spark, "paused", 1)] == [("", True)]
        write_log(inbox / "3.json", [(at(20), "event", f"a/{k}", False, None, None) for k in range(50)])
        found = wait_for(spark, "paused", 2)
        time.sleep(1)
        assert {(r.path, r.recursive) for r in found} == {("", True)} and spark.table("paused").count() < 15
    finally:
        query.stop()


def test_batch_form_against_a_plain_loop(spark):
    rng, old = random.Random(6), datetime(2024, 1, 1)
    rows = [(old + timedelta(milliseconds=rng.randrange(30_000)), "event", f"{rng.choice('abc')}/{k}", False, None, None) for k in range(150)]
    log = spark.createDataFrame(rows, timers.LOG)
    want, burst = set(), {}
    shard = {r.path: r.shard for r in timers.sharded(log, 2).collect()}
    for ts, _, path, *_ in sorted(rows, key=lambda r: r[0]):
        own = burst.setdefault(shard[path], [])
        if own and ts >= min(own[-1][0] + timedelta(milliseconds=300), own[0][0] + timedelta(seconds=2)):
            want |= {(p, min(own[-1][0] + timedelta(milliseconds=300), own[0][0] + timedelta(seconds=2))) for _, p in own}
            own.clear()
        own.append((ts, path))
    for own in burst.values():
        want |= {(p, min(own[-1][0] + timedelta(milliseconds=300), own[0][0] + timedelta(seconds=2))) for _, p in own}
    assert {(r.path, r.drain_at) for r in timers.drain_times(log, 2).collect()} == want


# The event source


def test_listings_and_their_differences(tmp_path):
    for name in ("b/x", "b-c/y", "b/d/z", "a", "b/e/f/g", "_vendor/no"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    everything = []
    for split in range(3):
        share = list(watch.list_share(str(tmp_path), Rules({}), split, 3, 2))
        assert [watch._key(e[0]) for e in share] == sorted(watch._key(e[0]) for e in share)
        everything += share
    assert sorted(e[0] for e in everything) == ["a", "b-c/y", "b/d/z", "b/e/f/g", "b/x"]

    def scan(folder):
        if folder.endswith("b/d"):
            raise PermissionError(13, "denied")
        return os.scandir(folder)

    before = list(watch.list_share(str(tmp_path), Rules({}), 0, 1, 2))
    os.remove(tmp_path / "a")
    after = list(watch.take_over(watch.list_share(str(tmp_path), Rules({}), 0, 1, 2, scan), iter(before)))
    assert list(watch.differences(iter(before), iter(after))) == [("a", "deleted", None)]  # what is below b/d is unknown, not gone
    with pytest.raises(FileNotFoundError):
        list(watch.list_share(str(tmp_path / "unplugged"), Rules({}), 0, 1, 2))


def test_events_come_once_each_also_after_a_restart(spark, tmp_path):
    root, state = tmp_path / "tree", tmp_path / "state"
    for name in ("a/1.md", "a/b/2.md", "top.md", "._x"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x")

    def run(name):
        query = watch.changes(spark, str(root), str(state), splits=3).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        return query.option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").queryName(name).start()

    def seen(count):
        until = time.time() + 40
        rows = []
        while time.time() < until and len(rows) < count:
            time.sleep(0.3)
            if (tmp_path / "out" / "_spark_metadata").exists():
                rows = sorted((r.ts, r.change, r.path) for r in spark.read.schema(watch.EVENTS).parquet(str(tmp_path / "out")).collect())
        return [(c, p) for _, c, p in rows]

    query = run("watch1")
    try:
        assert sorted(seen(3)) == [("created", "a/1.md"), ("created", "a/b/2.md"), ("created", "top.md")]
        (root / "a" / "1.md").write_text("changed")
        os.remove(root / "top.md")
        assert sorted(seen(5)[3:]) == [("changed", "a/1.md"), ("deleted", "top.md")]
    finally:
        query.stop()
    (root / "while-away.md").write_text("x")
    os.remove(root / "a" / "b" / "2.md")
    query = run("watch2")
    try:
        assert sorted(seen(7)[5:]) == [("created", "while-away.md"), ("deleted", "a/b/2.md")]
        time.sleep(2)
        assert len(seen(7)) == 7  # nothing twice
    finally:
        query.stop()
    assert len([n for n in os.listdir(state) if n.startswith("listing-")]) <= 3


def test_follow_the_event_source(spark, tmp_path):
    root = tmp_path / "tree"
    for name in ("a/1.md", "a/b/2.md"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("# one\n")
    store = catalogue.Store(spark, str(tmp_path / "store"), segment_rows=2)
    store.publish(catalogue.build(spark, str(root)).limit(0))
    events = watch.changes(spark, str(root), str(tmp_path / "state"), splits=2)
    query = live.follow(events, store, live.look_below(spark, str(root)), str(tmp_path / "cp"), {"processingTime": "500 milliseconds"}, "followed")

    def until(want):
        end, rows = time.time() + 60, None
        while time.time() < end and rows != want:
            time.sleep(0.5)
            rows = {r.path: json.loads(r.meta)["h1_title"] for r in store.read().collect()}
        assert rows == want

    try:
        until({"a/1.md": "one", "a/b/2.md": "one"})
        (root / "a" / "1.md").write_text("# other\n")
        os.remove(root / "a" / "b" / "2.md")
        (root / "new").mkdir()
        (root / "new" / "3.md").write_text("# three\n")
        until({"a/1.md": "other", "new/3.md": "three"})
    finally:
        query.stop()
