import random
import sys
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest
import test_linededup
import test_mixing
import test_packing
import test_quality_zstd
import test_simhash

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as pipeline  # noqa: E402
from oxbow.llm import linededup, mixing, packing, quality_zstd, queries, simhash  # noqa: E402
from oxbow.llm.common import learning_share, load  # noqa: E402


def test_stages_follow_the_operators(spark, data, tmp_path):
    docs = load(spark, data, "documents")
    names = [name for name, _ in pipeline.STAGES]
    assert len(names) == 5 and [f for _, f in pipeline.STAGES] == [pipeline.quality, pipeline.lines, pipeline.near_duplicates, pipeline.mix, pipeline.pack]
    seen = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, data)
        path = str(tmp_path / name.replace(" ", "_"))
        out.write.parquet(path)
        seen[name] = (docs, spark.read.parquet(path))
        docs = seen[name][1]
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before, after = seen["quality classifier"]
    model = quality_zstd.fit(before.where(~learning_share("doc_id", 5, 0)), load(spark, data, "labels"))
    good = {r.doc_id for r in quality_zstd.score(before, model).where("predicted = 1").collect()}
    assert {r.doc_id for r in after.collect()} == good and 0 < len(good) < before.count()
    before, after = seen["line dedup"]
    assert {(r.doc_id, r.text) for r in after.collect()} == {(r.doc_id, r.text) for r in linededup.dedup_lines(before).collect()}
    assert all(r.n_chars == len(r.text) for r in after.collect())
    before, after = seen["simhash near-dedup"]
    components = simhash.components(before).collect()
    assert sorted(r.doc_id for r in after.collect()) == sorted({r.component_id for r in components})
    before, after = seen["source mixing"]
    copies = {r.doc_id: r.copies for r in mixing.mix(before).collect() if r.copies}
    found = [r.doc_id for r in after.collect()]
    assert {d: found.count(d) for d in set(found)} == copies
    before, after = seen["packing"]
    assert after.where("start = 0").count() == before.count()
    assert after.columns == [c.split()[0] for c in packing.SCHEMA.split(", ")]


def test_run(spark, data):
    assert pipeline.run(spark, data).count() > 0 and pipeline.ORACLE_SQL is None


def test_registered_queries_equal_duckdb(spark, data):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, data).toPandas(), con.sql(sql).df()
        columns = sorted(want.columns)
        assert sorted(map(repr, got[columns].itertuples(index=False, name=None))) == sorted(map(repr, want[columns].itertuples(index=False, name=None)))


ODD = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, fp string, kept string, copies string"


def test_stages_take_odd_rows(spark, data):
    words = "plain words that make up a line of text which is long enough to be compared with others in this test"
    rows = [
        (1, words, "en", "a", 10), (2, words, None, None, None), (3, None, None, "a", None), (4, "", "en", "b", 0), (5, " \n\n ", "en", "b", 4),
        (None, words + " and more", "en", None, 5), (6, "x " * 60_000, "en", "a", 120_000), (7, words.replace("plain", "plein"), "en", "a", 1),
        (1, words, "en", "a", 10), (8, "é🙂 \x00 " + words[::-1], "fr", "c", 3),
    ]
    docs = spark.createDataFrame([(*r, "s", "t", "u", "v", "w") for r in rows], ODD)
    outs = {name: stage(spark, docs, data) for name, stage in pipeline.STAGES}
    for name, out in outs.items():
        if name != "packing":
            assert out.columns == docs.columns
    assert outs["line dedup"].count() == len(rows)
    assert {r.doc_id for r in outs["simhash near-dedup"].collect()} >= {1, 3, 6, 8}
    assert outs["quality classifier"].count() <= len(rows) and outs["source mixing"].count() > 0
    assert outs["packing"].where("start = 0").count() == len(rows)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), data).count() == 0


def small_corpus(seeded):
    """Sixty documents of three sources: good and bad ones, lines and whole texts that repeat exactly and nearly, an empty and a null text."""
    word = lambda: "".join(seeded.choice("etaoinshr") for _ in range(seeded.randrange(2, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    shared, docs, labels = [line(14) for _ in range(3)], [], []
    for i in range(60):
        lines = [line(seeded.randrange(12, 18)) for _ in range(seeded.randrange(2, 7))]
        if i % 4 == 0:
            lines.insert(1, seeded.choice(shared))
        if i % 6 == 1:
            lines.append(seeded.choice(shared)[:-1] + "z")
        if i % 9 == 2 and docs:
            lines = docs[-1][1].split("\n") if seeded.random() < 0.5 else [x + " more" for x in docs[-1][1].split("\n")]
        bad = i % 5 == 3
        docs.append((i * 7, "\n".join(x.upper() + "!!" if bad else x for x in lines), "en", seeded.choice(["a", "b", None]), 0))
        labels.append((i * 7, int(not bad)))
    docs[17], docs[31] = (17 * 7, "", "en", "a", 0), (31 * 7, None, None, "b", None)
    return docs, labels


def test_the_whole_pipeline_against_plain_loops(spark, tmp_path):
    docs, labels = small_corpus(random.Random(14))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    pieces = pipeline.run(spark, str(tmp_path)).collect()

    table = load(spark, str(tmp_path), "documents")
    model = quality_zstd.fit(table.where(~learning_share("doc_id", 5, 0)), load(spark, str(tmp_path), "labels"))
    kept = [d for d in docs if test_quality_zstd.plain_score(model, d[1]) >= 0.3]
    assert 30 < len(kept) < 60
    lines = dict(test_linededup.brute(kept))
    assert sum(len(t or "") for t in lines.values()) < sum(len(d[1] or "") for d in kept)
    near = {doc: least for doc, _, least in test_simhash.brute([(d[0], lines[d[0]]) for d in kept])}
    left = [d for d in kept if near[d[0]] == d[0]]
    assert len(left) < len(kept)
    size = {d[0]: len((lines[d[0]] or "").split()) for d in left}
    sizes = defaultdict(int)
    for d in left:
        sizes[d[3]] += size[d[0]]
    target = test_mixing.water(sizes)

    copies = Counter(p.doc_id for p in pieces if p.start == 0)
    taken = defaultdict(int)
    for d in left:
        taken[d[3]] += copies[d[0]] * size[d[0]]
    assert set(copies) <= set(size) and all(n <= 2 for d, n in copies.items() if size[d])
    for source in sizes:
        assert taken[source] == pytest.approx(target[source], abs=max(size.values()))
    ids = {doc: len(test_packing.reference(lines[doc])) for doc in copies}
    held = Counter()
    for p in pieces:
        assert p.doc_tokens == ids[p.doc_id]
        held[p.doc_id] += p.length
    assert held == {doc: copies[doc] * n for doc, n in ids.items()}
    sequences = defaultdict(int)
    for p in pieces:
        sequences[p.sequence_id] += p.length
    assert all(n == 2048 or n & (n - 1) == 0 for n in sequences.values())
