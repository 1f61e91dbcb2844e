import random
import re
from collections import Counter

import pytest

from oxbow.llm import quality_rules as R

SCHEMA = "doc_id long, text string, n_words string, kept string, __base string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def texts():
    seeded = random.Random(4)
    out = [None, "", " \n\t", "\x0b\x0c", "a\n\na\n a\na ", "x " * 30, "é🙂 #*$%&|<> \x85\xa0 z", "word " * 50_000]
    for _ in range(60):
        words = [seeded.choice("abcd") for _ in range(seeded.randrange(40))]
        out.append("".join(w + seeded.choice([" ", "\n", "  ", "\t"]) for w in words))
    return out


def test_statistics_equal_brute_force(spark):
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(texts())]
    found = R.judge(R.measure(spark.createDataFrame(rows, SCHEMA)), []).collect()
    for r in found:
        want = brute(rows[r.doc_id][1])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r.kept == (not r.base_failed)


def corpus(count=400):
    seeded = random.Random(7)
    docs, labels = [], []
    for i in range(count):
        kind = i % 5
        words = ["".join(seeded.choice("etaoinshr") for _ in range(seeded.randrange(2, 8))) for _ in range(60)]
        if kind == 0:
            words = [w.upper() for w in words]
        elif kind == 1:
            words = [w + seeded.choice(["###", "$$$"]) for w in words]
        docs.append((i, " ".join(words), None, None, None))
        labels.append((i, int(kind > 1)))
    return docs, labels


def test_learns_ordered_rules(spark):
    docs, labels = corpus()
    frame = spark.createDataFrame(docs, SCHEMA)
    marks = spark.createDataFrame([*labels, (5000, 0), (3, None), (None, 1)], "doc_id long, quality int")
    measured = R.measure(frame)
    rules = R.fit(measured, marks)
    assert 2 <= len(rules) <= R.MAX_RULES and rules == R.fit(R.measure(frame.repartition(3)), marks)
    assert {c.statistic for r in rules for c in r.conditions} & {"upper_share"} and all("THEN bad" in str(r) for r in rules)
    found = R.judge(measured, rules).collect()
    assert sum(r.kept == (r.doc_id % 5 > 1) for r in found) >= 0.98 * len(found)


def test_nothing_to_learn(spark):
    docs, labels = corpus(30)
    frame = R.measure(spark.createDataFrame(docs, SCHEMA))
    assert R.fit(frame, spark.createDataFrame([], "doc_id long, quality int")) == []
    assert R.fit(frame, spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")) == []
    assert R.fit(frame.limit(0), spark.createDataFrame(labels, "doc_id long, quality int")) == []
    assert R.judge(frame.limit(0), []).count() == 0


def test_accuracy_on_the_table(spark, data):
    data = data.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    rules = R.fit(R.measure(docs.where("doc_id % 2 = 0")), labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    found = [r for r in R.judge(R.measure(docs.where("doc_id % 2 = 1")), rules).collect() if r.doc_id in truth and not r.base_failed]
    good = [r for r in found if truth[r.doc_id]]
    assert sum(r.kept for r in good) >= 0.97 * len(good)
    assert sum(r.kept == bool(truth[r.doc_id]) for r in found) >= 0.93 * len(found)
    print(*rules, sep="\n")
