"""op13 against a plain loop."""

import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import pytest

from oxbow.llm import filter_audit, queries

DOCS = "doc_id long, text string, lang string, source string, fails string"
LABELS = "doc_id long, quality int, toxic int"


def plain(docs: list[tuple], labels: list[tuple]) -> list[tuple]:
    texts: dict[str, list[int]] = {}
    for doc, text, *_ in docs:
        if doc is not None:
            texts.setdefault(text or "", []).append(doc)
    known: dict[tuple, list[tuple[str, int, int]]] = {}
    for doc, text, _, source, *_ in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": doc is not None and min(texts[t]) < doc,
        }
        good = any(i == doc and i is not None and q == 1 for i, q, _ in labels)
        toxic = any(i == doc and i is not None and x == 1 for i, _, x in labels)
        known.setdefault(source or "", []).append(("".join(f for f in "ABCDE" if fails[f]), int(good), int(toxic)))
    out = []
    for part, rows in known.items():
        shapley: Counter = Counter()
        for order in permutations("ABCDE"):
            for fails, *_ in rows:
                first = next((f for f in order if f in fails), None)
                shapley[first] += 1
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                gone = lambda fails: any(x in fails for x in order[: step - 1])  # noqa: E731,B023
                now = [r for r in rows if f in r[0] and not gone(r[0])]
                out.append((
                    part, "".join(order), step, sum(f not in r[0] and not gone(r[0]) for r in rows), len(now),
                    sum(f in r[0] and gone(r[0]) for r in rows), sum(r[0] == f for r in rows), sum(r[1] for r in now), sum(r[2] for r in now), shapley[f],
                ))
    return sorted(out)


def audit(spark, docs, labels):
    found = filter_audit.audit(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(labels, LABELS))
    return sorted(map(tuple, found.collect()))


def prose(rng: random.Random, words: int) -> str:
    return rng.choice([" ", "\n", "\t "]).join(rng.choice(["tree", "Salt", "über", "dry", "#5", "x" * 9, "NASA", "a", "b", "c", "d"] + [str(i) for i in range(80)]) for _ in range(words))


def random_docs(rng: random.Random, n: int) -> list[tuple]:
    texts = [prose(rng, rng.choice([0, 3, 60, 199, 200, 260])) for _ in range(n // 4)] + [None, "", " \n"]
    hot = prose(rng, 210)
    return [
        (rng.choice([None, *range(n)]) if rng.random() < 0.3 else i, hot if rng.random() < 0.35 else rng.choice(texts), "en", rng.choice([None, "", "s1", "s1", "s2"]), "ABC")
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", range(3))
def test_equals_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    docs = random_docs(rng, 160)
    labels = [(rng.choice([None, *range(160)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(90)]
    assert audit(spark, docs, labels) == plain(docs, labels)


def test_groups_of_copies_across_many_tasks(spark):
    """One text in two thirds of all rows, rows of one id repeated: every boundary lies inside a group."""
    docs = [(i % 40 if i % 3 else 7, "same words here" if i % 3 else "another text", "en", f"s{i % 2}", "") for i in range(300)]
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert audit(spark, docs, [(7, 1, 0), (7, 0, 1)]) == plain(docs, [(7, 1, 0), (7, 0, 1)])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)


def test_colliding_fingerprints(spark, monkeypatch):
    """With three fingerprints for all texts, only the comparison of full texts tells them apart."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(filter_audit, "fingerprint", lambda text: F.pmod(F.char_length(text), F.lit(3)).cast("long"))
    docs = random_docs(random.Random(9), 200)
    for partitions in ("1", "4", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            assert audit(spark, docs, [(1, 1, 1)]) == plain(docs, [(1, 1, 1)])
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_odd_tables(spark):
    assert audit(spark, [], []) == []
    assert audit(spark, [(None, None, None, None, None)] * 2, []) == plain([(None, None, None, None, None)] * 2, [])
    long = [(1, "a b " * 300_000, "", "s", ""), (2, "a b " * 300_000, "", "s", "")]
    assert audit(spark, long, [(2, 1, 1)]) == plain(long, [(2, 1, 1)])


def test_query_equals_duckdb(spark, data):
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"create view {table} as select * from '{data}/{table}.parquet'")
    found = queries.op13_audit(spark, data)
    twin = con.sql(f"select {', '.join(found.columns)} from ({queries.oracle_sql()['op13_audit']})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(twin) and len(twin) % 600 == 0 and len(twin) > 600
