"""Byte-pair encoding and decoding by batched numpy merge rounds.

The words of a batch that are not known yet lie one after the other in one flat array of symbols. In a round, the rank of every pair of
neighbours is found by binary search over the sorted keys of the vocabulary's pairs; each word then merges all places of its own
lowest rank, overlapping ones from the left, and words without a pair leave the array. Since a product's pairs always rank behind
the merge that made it, this is the order of merging one pair at a time.

In a word of more than LONG_WORD symbols a pair is merged once no lower rank lies within the length of the longest token: whatever could
change one of its two symbols first would have to begin within that distance. So rounds do not grow with the length of a word.

Everything runs inside Arrow batches of a scan: no shuffle, and a lost task repeats its own rows alone.
"""

from __future__ import annotations

import json
import re
from collections import ChainMap
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

LONG_WORD = 256
CACHED_WORDS = 300_000
CACHED_LENGTH = 64
#: Characters whose words are merged together, and the longest slab of a text.
GROUP_CHARS = 2_000_000
NO_RANK = np.iinfo(np.int64).max

# How the byte-level pre-tokenizer splits, with its classes of letters, numbers and blanks.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?[^{blanks}{letters}{numbers}]+|{blank}+(?!{other})|{blank}+"
#: Up to here the classes below are the tokenizer's (a test compares them).
LATIN = 0x250

ENCODED = "doc_id long, n_tokens long, ids binary"
DECODED = "doc_id long, n_tokens long, ids binary, decoded string"


def default_tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def latin_pattern() -> re.Pattern:
    """SPLIT for texts of characters below LATIN, with classes spelled out for the faster engine."""
    every = [chr(c) for c in range(LATIN)]
    letters, numbers, blanks = ("".join(re.escape(c) for c in every if regex.match(p, c)) for p in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(
        SPLIT.format(
            letter=f"[{letters}]", number=f"[{numbers}]", blank=f"[{blanks}]", other=f"[^{blanks}]", letters=letters, numbers=numbers, blanks=blanks
        )
    )


class Splitter:
    """Words of a text as the tokenizer's byte-level pre-tokenizer finds them.

    The library and the `regex` module follow different versions of Unicode. A character beyond LATIN is shown to the library once; if it
    sees another class there, the split is made on a copy of the text that has a plain character of that class in its place.
    """

    UNUSUAL = re.compile(f"[^\0-{chr(LATIN - 1)}]")
    #: Class, a character before which one of this class joins, its stand-in, the class as `regex` has it.
    CLASSES = (("letter", "a", "a", r"\p{L}"), ("number", "1", "0", r"\p{N}"), ("other", "!", "!", r"[^\s\p{L}\p{N}]"))

    def __init__(self, tokenizer: Tokenizer):
        self.pre = tokenizer.pre_tokenizer
        self.latin = latin_pattern()
        self.any = regex.compile(
            SPLIT.format(letter=r"\p{L}", number=r"\p{N}", blank=r"\s", other=r"\S", letters=r"\p{L}", numbers=r"\p{N}", blanks=r"\s")
        )
        self.seen: set[str] = set()
        self.stand_ins: dict[int, str] = {}

    def _look(self, char: str) -> None:
        for _, before, stand_in, own in self.CLASSES:
            if len(self.pre.pre_tokenize_str(before + char)) == 1:
                if not regex.match(own, char):
                    self.stand_ins[ord(char)] = stand_in
                return
        if not char.isspace():
            self.stand_ins[ord(char)] = "\t"

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return self.latin.findall(text)
        unusual = set(self.UNUSUAL.findall(text))
        if not unusual:
            return self.latin.findall(text)
        for char in unusual - self.seen:
            self._look(char)
        self.seen |= unusual
        if not any(ord(c) in self.stand_ins for c in unusual):
            return self.any.findall(text)
        return [text[slice(*m.span())] for m in self.any.finditer(text.translate(self.stand_ins))]


#: A word always ends where a blank follows something that is none; so a text can be cut there.
_EDGE = re.compile(r"(?<=[^\s])(?=[\t\n\x0b\x0c\r\x20])")


def slabs(text: str, size: int) -> Iterator[str]:
    """A text in order, in pieces of about `size` characters that are split alone as they are in the whole."""
    at = 0
    while len(text) - at > size:
        edge = _EDGE.search(text, at + size)
        if edge is None:
            break
        yield text[at : edge.start()]
        at = edge.start()
    yield text[at:]


class Codec:
    """Encoder and decoder of a byte-level BPE vocabulary file. Other kinds of tokenizer files are refused."""

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre, added = spec["model"], spec["pre_tokenizer"] or {}, spec["added_tokens"]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        stripped = any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or stripped or not plain:
            raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
        vocab = model["vocab"]
        shown = {b: chr(b) for b in (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))}  # bytes that show as themselves
        shown |= {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
        byte_of = {c: b for b, c in shown.items()}
        self.byte_ids = np.array([vocab[shown[b]] for b in range(256)], np.int64)
        names = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in added}
        self.pieces = {i: bytes(map(byte_of.get, t)) if set(t) <= byte_of.keys() else t.encode() for i, t in names.items()}
        self.longest = max(map(len, self.pieces.values()))
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.span = max(names) + 1
        keys = np.array([vocab[a] * self.span + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.products = keys[order], order, np.array([vocab[a + b] for a, b in merges], np.int64)
        self.special = {t["content"]: int(t["id"]).to_bytes(4, "little") for t in added}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.path, self.cached, self.known = path, cached, {}

    @cached_property
    def splitter(self) -> Splitter:
        """Only encoding needs it."""
        return Splitter(Tokenizer.from_file(self.path))

    def _ranks(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the symbols at some places with the next ones, NO_RANK where no merge joins them."""
        pairs = symbols[at] * self.span + symbols[at + 1]
        found = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return np.where(self.keys[found] == pairs, self.ranks[found], NO_RANK)

    def _near(self, ranks: np.ndarray) -> np.ndarray:
        """Least rank within the longest token's length on both sides."""
        ahead, reach = ranks.copy(), 1
        while reach < self.longest:
            ahead[:-reach] = np.minimum(ahead[:-reach], ahead[reach:].copy())
            reach *= 2
        behind = np.concatenate([np.minimum.accumulate(ranks[: reach - 1]), ahead])[: len(ranks)]
        return np.minimum(ahead, behind)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers. Words of more than LONG_WORD bytes are best given alone."""
        out = [b""] * len(words)
        index = np.array([i for i, w in enumerate(words) if w], np.int64)
        sizes = np.array([len(words[i]) for i in index], np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.zeros(len(symbols), bool)  # the last symbol of a word has no pair
        ends[np.cumsum(sizes) - 1] = True
        ranks, changed = np.full(len(symbols), NO_RANK), np.flatnonzero(~ends)
        while len(index):
            ranks[changed] = self._ranks(symbols, changed)
            stops = np.cumsum(sizes)
            starts = stops - sizes
            least = np.minimum.reduceat(ranks, starts)
            done = least == NO_RANK
            if done.any():
                coded = symbols.astype("<u4")
                for i, a, b in zip(index[done].tolist(), starts[done].tolist(), stops[done].tolist()):
                    out[i] = coded[a:b].tobytes()
                stay = np.repeat(~done, sizes)
                symbols, ranks, ends = symbols[stay], ranks[stay], ends[stay]
                index, sizes, least = index[~done], sizes[~done], least[~done]
                if not len(index):
                    break
                starts = np.cumsum(sizes) - sizes
            lowest = np.repeat(least, sizes) if len(index) > 1 or sizes[0] <= LONG_WORD else self._near(ranks)
            chosen = (ranks == lowest) & (ranks != NO_RANK)
            # Overlapping places of one pair (a run of one symbol) are taken from the left, every other one, as far as all are chosen.
            begins = np.ones(len(ranks), bool)
            begins[1:] = (ranks[1:] != ranks[:-1]) | (ranks[1:] == NO_RANK)
            if not begins[chosen].all():
                place = np.arange(len(ranks))
                run, refused = np.maximum.accumulate(np.where(begins, place, 0)), np.cumsum(~chosen)
                chosen &= ((place - run) % 2 == 0) & (refused == refused[run])
            left = np.flatnonzero(chosen)
            symbols[left] = self.products[ranks[left]]
            ranks[left], ends[left] = NO_RANK, ends[left + 1]
            sizes = sizes - np.add.reduceat(chosen.astype(np.int64), starts)
            kept = np.ones(len(symbols), bool)
            kept[left + 1] = False
            symbols, ranks, ends = symbols[kept], ranks[kept], ends[kept]
            left -= np.arange(len(left))
            before = left - 1
            changed = np.concatenate([left, before[before >= 0]])
            changed = changed[~ends[changed]]
        return out

    def _learn(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of words not known yet; short ones are kept, the others are returned."""
        short, long = [], []
        for word in words:
            (short if len(word) <= CACHED_LENGTH else long).append(word)
        self.known |= zip(short, self.merge([w.encode() for w in short]))
        return {w: self.merge([w.encode()])[0] for w in long}

    def _group(self, slabs_: list[str]) -> list[bytes]:
        if len(self.known) > self.cached:
            self.known = {}
        words = [self.splitter.words(s) for s in slabs_]
        missing = set(chain.from_iterable(words)).difference(self.known)
        table = self.known
        if long := self._learn(missing):
            table = ChainMap(long, table)
        return [b"".join(map(table.__getitem__, w)) for w in words]

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text; the contents of special tokens are these tokens, a null text has none."""
        held, size = [], 0  # (last of its text, slab or ids)
        ahead: list[bytes] = []

        def flush() -> Iterator[bytes]:
            coded = iter(self._group([x for _, x in held if isinstance(x, str)]))
            for last, x in held:
                ahead.append(next(coded) if isinstance(x, str) else x)
                if last:
                    yield b"".join(ahead)
                    ahead.clear()

        for text in texts:
            for part in self._parts(text or ""):
                held.append((False, part))
                size += len(part)
                if size >= GROUP_CHARS:
                    yield from flush()
                    held, size = [], 0
            held.append((True, b""))
        yield from flush()

    def _parts(self, text: str) -> Iterator[str | bytes]:
        at = 0
        for match in self.cut.finditer(text):
            yield from slabs(text[at : match.start()], GROUP_CHARS)
            yield self.special[match[0]]
            at = match.end()
        yield from slabs(text[at:], GROUP_CHARS)

    def decode(self, ids: bytes) -> str:
        """Text of ids; ids that the vocabulary lacks are left out, bytes that are no UTF-8 become U+FFFD."""
        pieces = self.pieces
        return b"".join([pieces.get(i, b"") for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _batches(batch: pa.RecordBatch, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about `size` bytes."""
    step = max(1, batch.num_rows * size // max(size, batch.nbytes))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row: its token ids as little-endian unsigned 32-bit integers.

    Null and empty texts have no ids; repeated rows and null ids give a row each; an empty table gives none; other columns are ignored.
    Long texts go slab by slab.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in _batches(batch):
                coded = list(own.encode(part.column(1).to_pylist()))
                counts = pa.array([len(c) // 4 for c in coded], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), counts, pa.array(coded, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """`encoded` (see `encode`) with `decoded`: the text of its ids; null ids give an empty text."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in _batches(batch):
                texts = pa.array([own.decode(ids or b"") for ids in part.column(2).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, DECODED)
