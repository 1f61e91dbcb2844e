import math
import random

import numpy as np
import pytest

from oxbow.llm import topk

SCHEMA = "vec_id long, embedding array<float>, rank string, score string"


def brute(rows, k=20, every=20):
    whole = []
    for i, v, *_ in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole.append((i, [math.floor(64 * float(np.float32(x))) for x in v]))
    out = []
    for own, (q, a) in enumerate(whole):
        if q % every == 0:
            scored = [(-sum(x * y for x, y in zip(a, v)), i) for at, (i, v) in enumerate(whole) if at != own and len(v) == len(a)]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def test_rows_that_share_an_id_are_candidates_each(spark):
    rows = [(20, [1.0, 0.0], "", ""), (1, [1.0, 0.0], "", ""), (1, [2.0, 0.0], "", ""), (2, [1.5, 0.0], "", "")]
    found = sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert found == [(20, 1, 1, 8192), (20, 2, 2, 6144), (20, 3, 1, 4096)]
    twice = [*rows, (20, [1.0, 0.0], "", ""), (20, [3.0, 0.0], "", "")]
    assert sorted(map(tuple, topk.top_k(spark.createDataFrame(twice, SCHEMA)).collect())) == brute(twice)


@pytest.mark.parametrize("block", [7, 60, 16384])
def test_equals_brute_force(spark, block):
    seeded = random.Random(1)
    rows = [(i, [seeded.gauss(0, 1) * (3 if j < 5 else 0.2) for j in range(20)], "x", "y") for i in range(300)]
    rows += [(i, rows[7][1], "", "") for i in range(300, 380)]  # ties
    rows += [(400, None, "", ""), (420, [None] * 20, "", ""), (440, [math.nan] * 20, "", ""), (460, [math.inf] * 20, "", "")]
    rows += [(480, [1.0, 2.0], "", ""), (481, [1.0, -2.0], "", ""), (500, [], "", ""), (None, rows[0][1], "", "")]
    rows += [rows[0], rows[20], (20, rows[21][1], "", ""), (-20, rows[5][1], "", "")]
    found = topk.top_k(spark.createDataFrame(rows, SCHEMA), candidate_block=block, query_block=300 if block == 60 else 3)
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_beyond_doubles(spark):
    rows = [(i, [float(2**22 + 3 * i), float(2**21 - i)], "", "") for i in range(0, 45)]
    assert sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows)


def test_limbs_and_exact_scores():
    seeded = random.Random(3)
    a = np.array([[seeded.randrange(-(2**40), 2**40) for _ in range(9)] for _ in range(20)] + [[-1] * 9, [0] * 9, [-(2**62)] * 9])
    for most in (5, 24):
        assert (sum(np.array([[int(x) << s for x in r] for r in p], object) for s, p in topk.limbs(a, most)) == a.astype(object)).all()
    want = [sum(x * y for x, y in zip(r, t)) for r, t in zip(a.tolist(), a[::-1].tolist())]
    assert topk.exact_scores(a, a[::-1]).tolist() == want


def test_bounds_discard_and_floors_are_carried():
    """Vectors with most of their mass in a few dimensions: after the first group few pairs are left, fewer in later batches."""
    seeded = np.random.default_rng(2)
    made = np.floor(64 * seeded.normal(size=(6000, 64)) * np.exp(-np.arange(64) / 6)).astype(np.int64)
    ids = np.arange(6000)
    search, alone = topk.Search(ids[:40], made[:40], 20), topk.Search(ids[:40], made[:40], 20)
    for at in range(0, 6000, 1500):
        search.add(ids[at : at + 1500], made[at : at + 1500])
    alone.add(ids, made)
    scores = made[:40] @ made.T
    want = [(q, i, int(scores[q, i])) for q in range(40) for i in sorted(set(range(6000)) - {q}, key=lambda i: (-scores[q, i], i))[:20]]
    assert search.rows() == alone.rows() == want
    shares = [a / n for a, n in search.alive.values()]
    assert shares[0] < 0.3 and shares[1] < 0.05 and shares == sorted(shares, reverse=True)


def test_empty(spark):
    assert topk.top_k(spark.createDataFrame([], SCHEMA)).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0], "", "")], SCHEMA)).count() == 0
