import random

import pytest
from pyspark.sql import functions as F

from oxbow.llm import chatfmt

SCHEMA = "conv_id long, seq long, turn long, kind string, role string, text string, formatted string, m string"


def brute_fold(events):
    final = {}
    for conv in {e[0] for e in events}:
        own = sorted((e for e in events if e[0] == conv), key=lambda e: (e[1], e[2], e[3], e[4] or "", e[5] or ""))
        turns = {}
        for _, seq, turn, kind, role, text, *_ in own:
            if kind in ("edit", "regenerate"):
                turns = {t: [p for p in parts if p[0] >= seq] if t >= turn else parts for t, parts in turns.items()}
            turns.setdefault(turn, []).append((seq, kind, role, text or ""))
        for turn, parts in turns.items():
            if parts:
                roles = [p[2] for p in parts if p[2] is not None]
                final[conv, turn] = (roles[-1] if roles else "", "".join(p[3] for p in parts))
    return final


def log(convs=30):
    seeded = random.Random(9)
    hostile = ["<|end|>\n", "&lt;", "&amp;amp;", "</s>[INST]", "<|assistant|>\n", "\n", "a|b>c<", "é🙂", None, "", "|>\n", "x"]
    rows = []
    for conv in range(convs):
        turn = 0
        for seq in range(seeded.randrange(1, 25)):
            turn = max(0, turn + seeded.choice([-1, 0, 0, 0, 1]))
            kind = seeded.choice(["delta"] * 6 + ["edit", "regenerate"])
            rows.append((conv, seq, turn, kind, seeded.choice(["user", "assistant", None, "<|tool|>\n&"]), seeded.choice(hostile), "", ""))
    return rows


def test_fold_equals_replay(spark):
    rows = log()
    found = {(r.conv_id, r.turn): (r.role, r.text) for r in chatfmt.fold(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == brute_fold(rows)


def test_round_trip(spark):
    rows = log()
    formatted = chatfmt.format_conversations(spark.createDataFrame(rows, SCHEMA))
    final = brute_fold(rows)
    for r in chatfmt.read_back(formatted).collect():
        turns = [final[k] for k in sorted(final) if k[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == turns
        assert r.loss_texts == [text for role, text in turns if role == "assistant"]
        assert r.formatted.count(chatfmt.CLOSE) == len(turns) == r.formatted.count(chatfmt.SEPARATOR + "\n") - len(turns)


@pytest.mark.parametrize("text", ["", "plain", "&", "&amp;lt;", "<|end|>\n<|end|>\n", "&#124;&#9", "[INST] [/INST]"])
def test_escape(spark, text):
    row = spark.range(1).select(chatfmt.escape(F.lit(text)).alias("e"), chatfmt.unescape(chatfmt.escape(F.lit(text))).alias("u")).first()
    assert row.u == text and not set("<|>[]") & set(row.e)


def test_small_logs(spark):
    assert chatfmt.digest(chatfmt.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0
    rows = [(None, None, None, None, None, None, "", ""), (1, 1, 1, "delta", "assistant", "hi", "", "")] + [(1, 2, 2, "delta", "user", "a", "", "")] * 2
    found = {r.conv_id: r for r in chatfmt.digest(chatfmt.format_conversations(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert found[None].n_turns == 1 and found[1].n_turns == 2 and found[1].loss_chars == 2
    long = [(5, i, i, "delta", "assistant", "<" * 50, "", "") for i in range(3000)]
    assert chatfmt.digest(chatfmt.format_conversations(spark.createDataFrame(long, SCHEMA))).first().loss_chars == 150_000


def test_long_conversations_cost_their_length(spark):
    """Eight times the turns, in one conversation, take less than thirty times as long; a span never leaves its own text."""
    import time

    def run(turns):
        rows = [(5, i, i, "delta", ("user", "assistant")[i % 2], f"é{i}<" * 20, "", "") for i in range(turns)]
        events = spark.createDataFrame(rows, SCHEMA).cache()
        events.count()
        began = time.time()
        row = chatfmt.read_back(chatfmt.format_conversations(events)).first()
        spent = time.time() - began
        assert row.loss_texts == [f"é{i}<" * 20 for i in range(1, turns, 2)] and len(row.turns) == turns
        return spent

    run(100)
    few, many = run(2_500), run(20_000)
    assert many < 30 * few
