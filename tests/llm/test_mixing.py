import random

import numpy as np
import pytest

from oxbow.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target string, __copies string"


def water(sizes, share=1.5, weights=(3.0, 1.0, 2.0)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    return target


def rows(count=400):
    seeded = random.Random(4)
    out = []
    for i in range(count):
        source = seeded.choice(["a", "a", "a", "b", "Z", "é", None, "tiny"] if i > 3 else ["tiny"])
        words = seeded.randrange(3) if source == "tiny" else seeded.choice([0, 7, 7, 7, 31, 200])
        out.append((i, " ".join("w" for _ in range(words)) or seeded.choice([None, "", "\t "]), source, "x", None, "y"))
    return out


def test_mix_meets_targets(spark):
    frame = spark.createDataFrame(rows(), SCHEMA)
    found = mixing.mix(frame).collect()
    assert len(found) == 400
    sizes, taken, target = {}, {}, {}
    by_id = {r[0]: r for r in rows()}
    for r in found:
        text, source = by_id[r.doc_id][1:3]
        assert r["size"] == len((text or "").split())
        assert r.taken <= 2 * r["size"] and (not r["size"] or r.taken % r["size"] == 0)
        sizes[source] = sizes.get(source, 0) + r["size"]
        taken[source] = taken.get(source, 0) + r.taken
        target[source] = r.target
    assert all(r.source_size == sizes[by_id[r.doc_id][2]] for r in found)
    want = water(sizes)
    for source in sizes:
        assert target[source] == pytest.approx(want[source])
        assert abs(taken[source] - want[source]) <= 7
    again = mixing.mix(frame.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in found) == sorted((r.doc_id, r.taken) for r in again)


def test_apply_mix_repeats_rows(spark):
    frame = spark.createDataFrame(rows(), SCHEMA)
    copies = {r.doc_id: r.copies for r in mixing.mix(frame).collect()}
    out = mixing.apply_mix(frame)
    assert out.columns == frame.columns
    seen = {}
    for r in out.collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert seen == {k: v for k, v in copies.items() if v}


def test_repeated_ids_are_rows_of_their_own(spark):
    """Rows of one id with other texts, and a row that makes up a third of the table: the words emitted are the words taken."""
    made = rows() + [(1, "one " * 10, "a", "", "", ""), (1, "one " * 500, "a", "", "", ""), (2, "two " * 30, "a", "", "", "")]
    made += [(7, "again and again and again and again", "b", "", "", "")] * 200
    frame = spark.createDataFrame(made, SCHEMA).repartition(6)
    taken, emitted = {}, {}
    for r in mixing.mix(frame.select("*")).collect():
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
        assert r.taken <= 2 * r["size"]
        assert r.source_size and r.target >= 0
    for r in mixing.apply_mix(frame).collect():
        emitted[r.source] = emitted.get(r.source, 0) + len((r.text or "").split())
    assert sorted(taken.values()) == sorted(emitted.get(s, 0) for s in {r[2] for r in made})
    targets = {r.source_size: r.target for r in mixing.mix(frame).collect()}
    assert all(abs(taken[size] - target) <= 7 for size, target in targets.items())


def test_bulk_is_spread_over_lengths():
    """Where each length is that of one document, the mix takes short, middle and long ones alike."""
    lengths = np.arange(100, 20_100)
    taken = mixing.fit_budget(lengths, np.ones(20_000, int), int(lengths.sum()) // 2)
    assert int((taken * lengths).sum()) == int(lengths.sum()) // 2
    assert all(0.4 < part.mean() < 0.6 for part in np.split(taken, 4))


def test_fit_budget_is_exact_where_it_can_be():
    seeded = np.random.default_rng(2)
    for _ in range(40):
        lengths = np.unique(seeded.integers(1, 60, seeded.integers(1, 6)))
        counts = seeded.integers(1, 5, len(lengths))
        sums = {0}
        for length, count in zip(lengths.tolist(), counts.tolist()):
            sums = {s + k * length for s in sums for k in range(count + 1)}
        budget = int(seeded.integers(0, int((lengths * counts).sum()) + 1))
        taken = mixing.fit_budget(lengths, counts, budget)
        assert (taken >= 0).all() and (taken <= counts).all()
        assert abs(int((taken * lengths).sum()) - budget) == min(abs(s - budget) for s in sums)
    big = mixing.fit_budget(np.arange(1, 3000), np.full(2999, 50), 100_000_001)
    assert int((big * np.arange(1, 3000)).sum()) == 100_000_001


def test_small_tables(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    only = spark.createDataFrame([(1, None, None, "", "", ""), (1, None, None, "", "", "")], SCHEMA)
    assert [(r["size"], r.target, r.taken) for r in mixing.mix(only).collect()] == [(0, 0.0, 0)] * 2
    twice = spark.createDataFrame([(1, "a b", "s", "", "", "")] * 4, SCHEMA)
    assert sum(r.taken for r in mixing.mix(twice).collect()) == 12
