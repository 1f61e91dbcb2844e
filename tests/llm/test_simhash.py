import random

import pytest
import xxhash
from pyspark.sql import functions as F

from oxbow.llm import simhash

SCHEMA = "doc_id long, text string, fp string, key string"


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [brute_print(r[1]) for r in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                group[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted(((r[0], f"{p:016x}", least.get(find(i))) for i, (r, p) in enumerate(zip(rows, prints))), key=str)


def test_components_equal_brute_force(spark):
    seeded = random.Random(3)
    base = [f"w{seeded.randrange(900)}" for _ in range(400)]
    rows = []
    for i in range(160):
        words = list(base)
        for _ in range(seeded.randrange(3)):
            words[seeded.randrange(400)] = "X%d" % seeded.randrange(50)
        rows.append((i * 7 % 160, " ".join(words), "clash", None))
    rows += [(1000 + i, t, None, "k") for i, t in enumerate([None, "", " \n", "one", "ONE", "one two", "a\x0bb c", "É é", "é É"])]
    rows += [(None, "one", None, None), (2000, "one", None, None), (2000, "one", None, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = sorted((tuple(r) for r in simhash.components(frame).collect()), key=str)
    assert found == brute(rows)


def test_dense_keys_link_like_pairs(spark):
    seeded = random.Random(5)
    centre = seeded.getrandbits(64)
    prints = {centre}
    for _ in range(60):
        prints.add(centre ^ sum(1 << b for b in seeded.sample(range(12), seeded.randrange(1, 5))))
    prints |= {seeded.getrandbits(64) for _ in range(50)}
    frame = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    found = []
    for dense in (2, 1000):
        from oxbow.llm.common import connected_components

        found.append(sorted(map(tuple, connected_components(simhash.links(frame, dense=dense)).collect())))
    assert found[0] == found[1] and found[0]


@pytest.mark.parametrize("dense", [4, 1000])
def test_pivots_discard_before_bits_are_compared(spark, dense):
    """Pairs that meet, that the coordinate bound leaves, and that are linked, counted in turn; the bound never discards a link."""
    seeded = random.Random(7)
    half = seeded.getrandbits(32)
    prints = {half << 32 | seeded.getrandbits(32) for _ in range(300)} | {seeded.getrandbits(64) for _ in range(300)}
    prints |= {p ^ 1 << seeded.randrange(64) ^ 1 << seeded.randrange(64) for p in list(prints)[:100]}
    frame = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    met = simhash.candidates(frame, dense=dense).selectExpr("l", "r", "bit_count(l.fp ^ r.fp) as bits")
    passed = met.where(simhash.within_bound("l", "r"))
    n_met, n_passed = met.count(), passed.count()
    n_linked = met.where("bits <= 2").count()
    assert passed.where("bits <= 2").count() == n_linked and n_linked >= 90
    assert n_passed <= n_linked + n_met // 1000
    if dense == 1000:
        assert n_met > 30_000  # every pair that shares the half, of which next to none is linked
    table = simhash.pivot_table(F.lit(5))
    packed = spark.range(1).select(*table).first()
    pivots = random.Random(simhash.SEED)
    want = [bin(pivots.getrandbits(64) ^ 5).count("1") for _ in range(simhash.SCATTERED)]
    assert [packed[i // 7] >> 8 * (i % 7) & 255 for i in range(simhash.SCATTERED)] == want


def test_bound_equals_coordinate_differences(spark):
    seeded = random.Random(8)
    rows = [(seeded.getrandbits(63), 0) for _ in range(500)]
    rows = [(a, a ^ sum(1 << b for b in seeded.sample(range(63), seeded.randrange(1, 8)))) for a, _ in rows]
    struct = lambda c: F.struct(F.col(c).alias("fp"), *simhash.pivot_table(F.col(c))).alias(c)
    frame = spark.createDataFrame(rows, "l long, r long").select(struct("l"), struct("r"))
    for bits in (1, 2, 3):
        for r in frame.select("l", "r", simhash.within_bound("l", "r", max_bits=bits).alias("ok")).collect():
            unpack = lambda row: [row[1 + i // 7] >> 8 * (i % 7) & 255 for i in range(simhash.SCATTERED)]
            assert r.ok == all(abs(a - b) <= bits for a, b in zip(unpack(r.l), unpack(r.r)))


@pytest.mark.parametrize("repeat", [1, 3])
def test_empty_and_representatives(spark, repeat):
    assert simhash.components(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(2, "same words here now", "a", "b"), (1, "same words here now", "c", "d"), (3, "other things in this text", "", "")]
    kept = simhash.representatives(spark.createDataFrame(rows * repeat, SCHEMA))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3] and kept.columns == ["doc_id", "text", "fp", "key"]


def test_long_texts_in_slabs(monkeypatch):
    seeded = random.Random(1)
    from oxbow.llm import common

    for count in (0, 1, 2, 3, 4, 50, 700):
        text = "".join(seeded.choice(["a", "Bé", "ccc"]) + seeded.choice([" ", "\n", "  \t"]) for _ in range(count))
        whole = simhash.fingerprint(text.encode())
        assert whole % 2**64 == brute_print(text)
        monkeypatch.setattr(simhash, "slabs", lambda t: common.slabs(t, 7))
        assert simhash.fingerprint(text.encode()) == whole
        monkeypatch.undo()


def test_representatives_by_component(spark):
    a, b, c = "one set of words here now", "quite another text about other things", "third kind of text that stands alone"
    rows = [(None, a, "x", None), (None, a, None, "x"), (None, b, "", ""), (5, c, "", ""), (None, c, "", ""), (7, a + " z", "", ""), (7, b + " y", "", "")]
    want = {(r[2], r[1]) for r in rows}
    frame = spark.createDataFrame(rows, SCHEMA)
    groups = {r.fingerprint for r in simhash.components(frame).collect()}
    kept = sorted((tuple(r) for r in simhash.representatives(frame).collect()), key=str)
    again = sorted((tuple(r) for r in simhash.representatives(frame.repartition(3)).collect()), key=str)
    assert kept == again and len(kept) == len(groups) == 5 and {(r[2], r[1]) for r in kept} <= want
    assert [r[0] for r in kept if r[1] == c] == [5]
