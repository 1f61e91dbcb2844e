import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from oxbow.llm import packing

SCHEMA = "doc_id long, text string, start string, length string"
TEXTS = [
    None, "", " ", "It's A test, isn't it?", "one\x0btwo\tthree four five", "\x1cgs \x85 nel", "été ́x ß ẞ İi Σς ΟΣ x",
    "<|endoftext|> and <|startoftext|>x", "日本語 123 ４５ ²", "a" * 3000, "\x00 nul\x00 x\x00", "'S 'LL don'T", "wörd " * 900, "🙂🙂 ok",
]


def reference(text):
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("window", [50, 5000, 10**6])
def test_pieces_hold_every_id_once(spark, window):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS * 2)]
    frame = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    pieces = packing.pack(frame, max_tokens=256, window_tokens=window).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(range(len(rows)))
    for doc, own in by_doc.items():
        ids, at = reference(rows[doc][1]), 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 256 or at & (at - 1) == 0


def test_encoder_equals_tokenizer_on_the_table(spark, data):
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").limit(60).collect()]
    import pyarrow as pa

    encoder = packing.WordEncoder(packing.default_tokenizer(), limit=500)
    for at in range(0, len(texts), 20):
        found = encoder.encode(pa.array(texts[at : at + 20]))
        assert [x.tolist() for x in found] == [reference(t)[:-1] for t in texts[at : at + 20]]


def test_costs_are_balanced():
    lengths = [int(x) for x in np.random.default_rng(1).integers(1, 900, 400)]
    cost = defaultdict(float)
    for _, _, length, sequence, _ in packing.assign(lengths, 2048, 1.0, 1 / 2048):
        cost[sequence] += length + length * length / 2048
    full = list(cost.values())[:80]
    assert max(full) < 1.6 * min(full)


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_texts_in_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "PART_BYTES", 9)
    words = packing.WordEncoder(packing.default_tokenizer())
    found = packing.encode_part(words, pa.array(TEXTS))
    assert [x.tolist() for x in found] == [reference(t)[:-1] for t in TEXTS]
