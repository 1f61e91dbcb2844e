"""Cost-balanced packing of tokenised documents into fixed-length training sequences.

A document's cost is linear in its tokens plus quadratic for attention inside the document. Each Spark task takes the documents of
its own input partition, window by window, and assigns them in descending cost to the sequence of lowest cost that still has room.
No rows are shuffled: packing needs no neighbours, only enough documents at a time, so a window is bounded by tokens.

The capacities of a window add up to its tokens exactly: as many full sequences as fit, and the rest as sequences whose lengths are
powers of two, which need no padding. A document that no sequence has room for is cut.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from .common import slabs

MAX_TOKENS = 2048
END_ID = 1
WINDOW_TOKENS = 2_000_000
CACHED_WORDS = 600_000
PART_BYTES = 4_000_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Token ids of whole texts, each distinct word encoded once.

    The tokenizer lower-cases, splits a text into pre-tokens and merges inside each by itself, so the ids of a text are those of its
    pre-tokens in order. For texts of plain Latin characters (SAFE) Arrow makes the same split over a whole batch: blanks around
    every mark, digit and contraction, then words between blanks. Only words not seen yet go through the tokenizer's model. A text
    with any other character goes through the tokenizer as it is. The cache starts again when it holds `limit` words.
    """

    #: Where NFC and the splits below do what the tokenizer does: no combining marks, odd blanks or special tokens.
    UNSAFE = r"[^\t\n\x0b\f\r\x20-\x7E\x{A1}-\x{12F}\x{131}-\x{24F}]|<\|"
    MARK = r"('s|'t|'re|'ve|'m|'ll|'d|[^\p{L}\p{N}\t\n\x0b\f\r\x20]+|\p{N})"

    def __init__(self, path: str, limit: int = CACHED_WORDS):
        self.tokenizer = Tokenizer.from_file(path)
        self.limit, self.words = limit, {"": b""}
        to_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelled = {c: to_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0x21, 0x250)}

    def _learn(self, words: list[str]) -> None:
        if len(self.words) > self.limit:
            self.words = {"": b""}
        merge, spelled = self.tokenizer.model.tokenize, self.spelled
        for word in words:
            if word not in self.words:
                ids = [token.id for token in merge(word.translate(spelled))]
                self.words[word] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """One array of ids for each text; a null text has none."""
        texts = pc.fill_null(texts, "")
        unsafe = pc.match_substring_regex(texts, self.UNSAFE)
        plain = pc.utf8_lower(pc.if_else(unsafe, "", texts))
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(plain, self.MARK, r" \1 "))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        try:
            ids = list(map(self.words.__getitem__, words))
        except KeyError:
            self._learn(words)
            ids = list(map(self.words.__getitem__, words))
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, starts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(lengths) - lengths
        index = coded.indices.to_numpy()
        own = lengths[index]
        stops = np.concatenate([[0], np.cumsum(own)])
        joined = flat[np.repeat(starts[index] - stops[:-1], own) + np.arange(stops[-1])]
        bounds = stops[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])]
        out = [joined[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        for i in np.flatnonzero(unsafe.to_numpy(zero_copy_only=False)).tolist():
            out[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4")
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode_part(words: WordEncoder, texts: pa.Array) -> list[np.ndarray]:
    """Ids of a few texts; a very long one goes piece by piece, cut at blanks."""
    if texts.nbytes <= 2 * PART_BYTES:
        return words.encode(texts)
    out = []
    for text in texts.to_pylist():
        pieces = slabs((text or "").encode(), PART_BYTES)
        out.append(np.concatenate([words.encode(pa.array([p.decode()]))[0] for p in pieces]))
    return out


def assign(lengths: list[int], max_tokens: int, linear: float, quadratic: float) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths; all sequences come out full.

    Documents longer than a sequence are first cut into whole sequences and a rest. Pieces go in descending order of cost (longer
    first, ties by position) to the lowest-cost sequence with room (ties: the first). A piece without room anywhere fills up the
    lowest-cost sequences one after the other.
    """
    total = sum(lengths)
    rest = total % max_tokens
    capacities = [max_tokens] * (total // max_tokens) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    pieces = [(i, s, min(max_tokens, n - s)) for i, n in enumerate(lengths) for s in range(0, n, max_tokens)]
    pieces.sort(key=lambda p: (-p[2], p[0], p[1]))
    whole = 0
    while whole < len(pieces) and pieces[whole][2] == max_tokens:  # each has the first empty sequence to itself
        yield (*pieces[whole], whole, 0)
        whole += 1
    room = np.array(capacities[whole:], np.int64)
    used, cost = np.zeros(len(room), np.int64), np.zeros(len(room))

    def put(piece: tuple[int, int, int], at: int, length: int) -> tuple[int, int, int, int, int]:
        row = (piece[0], piece[1], length, whole + at, int(used[at]))
        used[at] += length
        room[at] -= length
        cost[at] += linear * length + quadratic * length * length
        return row

    for piece in pieces[whole:]:
        fits = room >= piece[2]
        if fits.any():
            yield put(piece, int(np.argmin(np.where(fits, cost, np.inf))), piece[2])
            continue
        document, start, left = piece
        while left:
            at = int(np.argmin(np.where(room > 0, cost, np.inf)))
            length = min(left, int(room[at]))
            yield put((document, start, length), at, length)
            start, left = start + length, left - length


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    max_tokens: int = MAX_TOKENS,
    end_id: int = END_ID,
    linear: float = 1.0,
    quadratic: float = 1.0 / MAX_TOKENS,
    window_tokens: int = WINDOW_TOKENS,
) -> DataFrame:
    """Pieces of all documents, by SCHEMA; every id lies in exactly one piece.

    Null and empty texts hold only the end id. Repeated rows are packed once each. Extra columns are ignored, an empty table gives
    no pieces. `sequence_id` is unique over the table: the partition's number and a count within it.
    """
    path = tokenizer or default_tokenizer()

    def rows(window: list[tuple[int, np.ndarray]], base: int) -> tuple[pa.RecordBatch, int]:
        out, top = [], -1
        for i, start, length, sequence, offset in assign([len(x) for _, x in window], max_tokens, linear, quadratic):
            doc, ids = window[i]
            crc = zlib.crc32(ids[start : start + length].astype("<u4").tobytes())
            out.append((doc, start, length, crc, len(ids), base + sequence, offset))
            top = max(top, sequence)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        columns = [pa.array(list(c), pa.int64()) for c in zip(*out)]
        return pa.RecordBatch.from_arrays(columns, names=names), base + top + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        base, window, held = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            step = max(1, batch.num_rows * PART_BYTES // max(PART_BYTES, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                for doc, ids in zip(part.column(0).to_pylist(), encode_part(words, part.column(1))):
                    window.append((doc, np.append(ids, np.uint32(end_id))))
                    held += len(ids) + 1
                    if held >= window_tokens:
                        done, base = rows(window, base)
                        window, held = [], 0
                        yield done
        if window:
            yield rows(window, base)[0]

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, SCHEMA)
