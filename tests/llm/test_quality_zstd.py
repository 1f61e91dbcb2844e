import math
import random
import zlib

import zstandard

from oxbow.llm import quality_zstd
from oxbow.llm.common import learning_share
from oxbow.llm.queries import op2_quality

SCHEMA = "doc_id long, text string, score string, predicted string, __row string"


def corpus(count=300):
    seeded = random.Random(6)
    docs, labels = [], []
    for i in range(count):
        good = i % 3 != 0
        words = ["".join(seeded.choice("etaoinshr") for _ in range(seeded.randrange(2, 8))) for _ in range(80)]
        docs.append((i, " ".join(words if good else [w.upper() + "!!" for w in words]), "x", None, "y"))
        labels.append((i, int(good)))
    return docs, labels


def test_learns_and_scores_everything(spark):
    docs, labels = corpus()
    docs += [(1000, None, "", "", ""), (1001, "", "", "", ""), (1002, "aether notions " * 20000, "", "", ""), (None, "x", "", "", "")]
    docs += docs[:3]
    frame = spark.createDataFrame(docs, SCHEMA)
    marks = spark.createDataFrame([*labels, (5, None), (7777, 1), (None, 0)], "doc_id long, quality int")
    model = quality_zstd.fit(frame.where(~learning_share("doc_id", 5, 0)), marks)
    assert model == quality_zstd.fit(frame.where(~learning_share("doc_id", 5, 0)).repartition(5), marks)
    found = quality_zstd.score(frame, model).collect()
    assert len(found) == len(docs) and all(0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.doc_id is not None and r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    wrong = [r for r in held if r.predicted != int(r.doc_id % 3 != 0)]
    assert len(held) > 40 and len(wrong) <= 2
    kept = quality_zstd.keep_good(frame, model)
    assert kept.columns == frame.columns and kept.count() == sum(r.predicted for r in found)


def plain_score(model, text):
    """Both dictionaries on every chunk of one text, and the curve read off."""
    raw, saved = (text or "").encode(), 0
    for at in range(0, len(raw), 1024):
        sizes = []
        for dictionary in (model.bad, model.good):
            made = zstandard.ZstdCompressor(
                level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_dict_id=False
            )
            sizes.append(len(made.compress(raw[at : at + 1024])))
        saved += sizes[0] - sizes[1]
    m = saved / (len(raw) + 1)
    smooth = 1 / (1 + math.exp(-min(30, max(-30, model.slope * m + model.intercept))))
    if not model.steps:
        return smooth
    steps = [(-math.inf, model.steps[0][1]), *model.steps, (math.inf, model.steps[-1][1])]
    (x0, y0), (x1, y1) = next((a, b) for a, b in zip(steps, steps[1:]) if a[0] <= m <= b[0])
    level = y0 if y0 == y1 or math.isinf(x0) or math.isinf(x1) or x0 == x1 else y0 + (y1 - y0) * (m - x0) / (x1 - x0)
    return 0.95 * level + 0.05 * smooth


def test_scores_equal_a_plain_loop(spark, monkeypatch):
    """Both dictionaries on every chunk, sizes added up and the curve read off one text at a time."""
    monkeypatch.setattr(quality_zstd, "LEAST_FOR_STEPS", 20)
    docs, labels = corpus()
    docs += [(1000, None, "", "", ""), (1001, "", "", "", ""), (1002, "é" * 3000, "", "", "")]
    frame = spark.createDataFrame(docs, SCHEMA)
    model = quality_zstd.fit(frame, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert model.steps
    for row in quality_zstd.score(frame, model).collect():
        assert abs(row.score - plain_score(model, row.text)) < 1e-9 and row.predicted == int(row.score >= 0.3)


def test_repeated_ids_count_once(spark):
    docs, labels = corpus(60)
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    frame = spark.createDataFrame(docs, SCHEMA)
    again = spark.createDataFrame(docs + docs[:20] * 30, SCHEMA)
    assert quality_zstd.fit(frame, marks) == quality_zstd.fit(again, marks)
    other = spark.createDataFrame(docs + [(i, f"another text {i}", "", "", "") for i in range(20)] * 3, SCHEMA)
    assert quality_zstd.fit(other, marks) == quality_zstd.fit(other.repartition(3), marks)


def test_without_labels(spark):
    frame = spark.createDataFrame([(1, "some text", "", "", "")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_zstd.fit(frame, none)
    assert [r.score for r in quality_zstd.score(frame, model).collect()] == [0.5]
    assert quality_zstd.score(frame.limit(0), model).count() == 0
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality_zstd.score(frame, quality_zstd.fit(frame, one)).first().score > 0.5


def test_held_out_accuracy(spark, data):
    data = data.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    found = [r for r in op2_quality(spark, data).collect() if r.held_out and r.doc_id in labels]
    right = sum(r.predicted == labels[r.doc_id] for r in found)
    assert len(found) > 50 and right / len(found) > 0.93


def test_dictionaries_learn_from_whole_texts(spark):
    seeded = random.Random(9)
    text = bytes(seeded.randrange(97, 123) for _ in range(100_000))
    places = [text.index(c) for c in quality_zstd.sample(text)]
    assert [p // 25_000 for p in places] == [0, 1, 2, 3] and quality_zstd.sample(text) == quality_zstd.sample(text)
    assert b"".join(quality_zstd.sample(text[:2000])) == text[:2000] and quality_zstd.sample(b"") == []
    head = lambda n: " ".join("".join(seeded.choice("etaoinshr") for _ in range(5)) for _ in range(n))
    docs = [(i, head(500) + " " + ("JUNK$$ " * 4000 if i % 2 else head(4600)), "", "", "") for i in range(60)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id long, quality int")
    model = quality_zstd.fit(spark.createDataFrame(docs, SCHEMA), labels)
    assert b"JUNK$$" in model.bad and b"JUNK$$" not in model.good
