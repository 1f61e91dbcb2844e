import random
import zlib

from oxbow.llm import langid
from oxbow.llm.queries import op10_langid

SCHEMA = "doc_id long, text string, lang string, lang_pred string, score string"
SOUNDS = {"en": "th ing and er wh", "de": "sch ung und ein ch", "fr": "eau que ment oi ou", "es": "ción ado que ll ñ", "xx": "kk zz jj vv"}


def corpus(count=400):
    seeded = random.Random(2)
    rows = []
    for i in range(count):
        lang = seeded.choice(list(SOUNDS))
        words = ["".join(seeded.choice(SOUNDS[lang].split()) for _ in range(seeded.randrange(1, 4))) for _ in range(30)]
        text = " ".join(words)
        rows.append((i, text.upper() if i % 7 == 0 else text, lang if i % 4 else None if i % 8 else lang, None, "x"))
    return rows


def test_learns_families_and_languages(spark):
    rows = corpus()
    frame = spark.createDataFrame(rows, SCHEMA)
    model = langid.fit(frame.where("doc_id < 300"))
    assert model.languages == {"germanic": ["de", "en"], "romance": ["es", "fr"], "xx": ["xx"]}
    assert set(model.pairs) == {("de", "en"), ("es", "fr")}
    odd = [(1000, None, "en", "", ""), (1001, "", None, "", ""), (1002, "12 ²½ !_", None, "", ""), (None, "the and wh", None, "", "")]
    odd += [(1003, "eau que " * 300_000, None, "", ""), rows[0]]
    found = {r.doc_id: r for r in langid.predict(frame.unionByName(spark.createDataFrame(odd, SCHEMA)), model).collect()}
    truth = {r[0]: r[2] for r in rows}
    assert all(found[i].lang_pred == truth[i] for i in range(300, 400) if truth[i])
    assert [found[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and found[1003].lang_pred == "fr"
    assert all(0 <= r.score <= 1 for r in found.values())
    again = langid.fit(frame.where("doc_id < 300").repartition(5))
    assert all((again.pairs[p] == model.pairs[p]).all() for p in model.pairs)


def test_predictions_equal_a_plain_loop(spark):
    """Every machine on every text alone, votes counted one by one."""
    frame = spark.createDataFrame(corpus(120), SCHEMA)
    model = langid.fit(frame)
    texts = [r[1] for r in corpus(120)] + [None, "12", "é", "the eau"]
    for text, (lang, score) in zip(texts, langid.predict_texts(texts, model)):
        x = langid.features(text)
        if x is None:
            assert (lang, score) == ("und", 0.0)
            continue
        family = max(model.languages, key=lambda f: sum(a * b for a, b in zip(x, model.families[f])))
        votes = {one: 0 for one in model.languages[family]}
        for (a, b), w in model.pairs.items():
            if a in votes:
                votes[a if sum(p * q for p, q in zip(x, w)) >= 0 else b] += 1
        assert votes[lang] == max(votes.values()) and 0 <= score <= 1


def test_dirty_languages_are_bounded(spark):
    rows = [(i, f"words of {i}", "en" if i % 3 else f"odd{i}", "", "") for i in range(120)] + [(1, "words of 1", "en", "", "")] * 5
    model = langid.fit(spark.createDataFrame(rows, SCHEMA), languages=5, sample=60)
    assert sum(map(len, model.languages.values())) == 5 and model.languages["germanic"] == ["en"]
    again = langid.fit(spark.createDataFrame(rows, SCHEMA).repartition(3), languages=5, sample=60)
    assert all((again.families[f] == model.families[f]).all() for f in model.families)


def test_nothing_to_learn(spark):
    frame = spark.createDataFrame([(1, "words", None, "", "")], SCHEMA)
    model = langid.fit(frame)
    assert [tuple(r) for r in langid.predict(frame, model).collect()] == [(1, "und", 0.0)]
    assert langid.predict(frame.limit(0), model).count() == 0
    one = langid.fit(spark.createDataFrame([(1, "words", "en", "", "")], SCHEMA))
    assert langid.predict(frame, one).first().lang_pred == "en"


def test_held_out_accuracy(spark, data):
    data = data.replace("0.001", "0.01")
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang").collect()}
    found = op10_langid(spark, data).collect()
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found) and len(found) == 1000
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97
