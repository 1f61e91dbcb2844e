"""op11 against the tokenizers library."""

import random
import time

import numpy as np
import pyarrow.parquet as pq
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from oxbow.llm import bpe, queries

PATH = bpe.default_tokenizer()
LIBRARY = Tokenizer.from_file(PATH)
OWN = bpe.Codec(PATH)
PIECES = ["a", "b", " ", "  ", "\n", "'s", "'", "é", "ş", "語", "՘", "　", "\x85", "\xa0", "1", "²", "<|endoftext|>", "😀", "\U0001fae9", "​", "\x1c", "!", "--", "the", "\x00"]


def ids(coded: bytes) -> list[int]:
    return np.frombuffer(coded, "<u4").tolist()


def check(text: str) -> None:
    coded = next(OWN.encode([text]))
    assert ids(coded) == LIBRARY.encode(text, add_special_tokens=False).ids
    assert OWN.decode(coded) == LIBRARY.decode(ids(coded), skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(PIECES), max_size=50).map("".join)))
def test_any_text_like_the_library(text):
    check(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50_300), max_size=30))
def test_any_ids_decode_like_the_library(numbers):
    assert OWN.decode(np.array(numbers, "<u4").tobytes()) == LIBRARY.decode(numbers, skip_special_tokens=False)


def test_classes_below_latin_are_the_tokenizers():
    for code in range(bpe.LATIN):
        text = f"a{chr(code)}1{chr(code)}!{chr(code)}"
        spans = [s for _, s in LIBRARY.pre_tokenizer.pre_tokenize_str(text)]
        assert [m.span() for m in OWN.splitter.latin.finditer(text)] == spans, hex(code)


def test_characters_of_later_unicode():
    later = [chr(c) for c in range(0x250, 0x32000) if not 0xD800 <= c < 0xE000 and regex.match(r"\p{L}", chr(c))][::97]
    for char in ["՘", "࢏", "\U000107bb", *later]:
        check(f"x{char}1{char} {char}'s{char}! {char}{char}")


@pytest.mark.parametrize("letters, length", [("abcdefghijklmnopqrstuvwxyz", 30_000), ("a", 5_001), ("ab", 9_000), ("-=", 4_000), ("éñ", 3_000), (" ", 2_000)])
def test_very_long_words(letters, length):
    rng = random.Random(length)
    check("".join(rng.choice(letters) for _ in range(length)))


def test_rounds_do_not_grow_with_a_words_length():
    rng, spent = random.Random(3), []
    for length in (50_000, 200_000):
        text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(length))
        began = time.time()
        list(OWN.encode([text]))
        spent.append(time.time() - began)
    assert spent[1] < 12 * spent[0]


def test_slabs_change_nothing(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(400))) for _ in range(60)]
    monkeypatch.setattr(bpe, "GROUP_CHARS", 37)
    small = bpe.Codec(PATH, cached=50)
    assert [ids(c) for c in small.encode(texts)] == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_other_tokenizer_files_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="byte-level"):
        bpe.Codec(public_tokenizers.path("word_bpe_49k.json"))


def test_rows_of_every_kind(spark):
    rows = [(1, "Hello world", "x"), (1, "Hello world", "y"), (2, None, "x"), (3, "", None), (None, "x" * 3000, "x"), (4, "<|endoftext|>", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = bpe.decode(bpe.encode(docs)).collect()
    expected = [(i, LIBRARY.encode(t or "", add_special_tokens=False).ids, t or "") for i, t, _ in rows]
    key = lambda r: (r[0] or -1, r[2])
    assert sorted(((r.doc_id, ids(r.ids), r.decoded) for r in found), key=key) == sorted(expected, key=key)
    assert all(r.n_tokens == len(ids(r.ids)) for r in found)
    assert bpe.decode(bpe.encode(docs.where("doc_id > 9"))).collect() == []


def test_query_over_whole_table(spark, data):
    import hashlib

    table = pq.read_table(f"{data}/documents.parquet").to_pylist()
    coded = [e.ids for e in LIBRARY.encode_batch([r["text"] or "" for r in table], add_special_tokens=False)]
    digest = lambda b: hashlib.sha256(b).hexdigest()
    expected = [
        (r["doc_id"], len(c), digest(np.array(c, "<u4").tobytes()), digest(LIBRARY.decode(c, skip_special_tokens=False).encode()))
        for r, c in zip(table, coded)
    ]
    assert sorted(map(tuple, queries.op11_bpe(spark, data).collect())) == sorted(expected)
