"""Quality scores from compression: how much better a good dictionary explains a text than a bad one.

One zstandard dictionary is built from well labelled texts and one from badly labelled texts. A text is compressed chunk by chunk
with both (chunks keep the dictionaries relevant however long the text is); the difference of the compressed sizes, divided by the
text's bytes, is the margin. A curve fitted on other labelled texts turns margins into probabilities: isotonic steps, joined by lines,
with a little of a logistic curve so that equal steps still rank (with few labels, the logistic curve alone).

Learning uses bounded samples, drawn by a hash of the id: DICTIONARY_DOCS texts a class for the dictionaries and CALIBRATION_DOCS
texts for the curve. A dictionary learns SAMPLES_PER_TEXT chunks of SAMPLE_BYTES bytes of each of its texts, however long: the text is
cut into so many even stretches, and each gives one chunk at a place seeded by the text (a text no longer than all chunks is learnt
whole). Scoring covers every whole text, in one pass that shuffles nothing.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DICTIONARY_DOCS = 800
CALIBRATION_DOCS = 4_000
DICTIONARY_BYTES = 32_768
SAMPLES_PER_TEXT = 4
SAMPLE_BYTES = 512
CHUNK_BYTES = 1024
LEVEL = 3
THRESHOLD = 0.3
SMOOTH = 0.05
LEAST_BLOCK = 20
LEAST_FOR_STEPS = 50  # calibration texts of either class


@dataclass(frozen=True)
class Model:
    """Both dictionaries, the logistic curve 1 / (1 + exp(-(slope * margin + intercept))), and the steps (margin, probability)."""

    good: bytes
    bad: bytes
    slope: float
    intercept: float
    steps: tuple[tuple[float, float], ...] = ()

    def calibrate(self, margins: np.ndarray) -> np.ndarray:
        smooth = 1 / (1 + np.exp(-np.clip(self.slope * margins + self.intercept, -30, 30)))
        if not self.steps:
            return smooth
        at, value = zip(*self.steps)
        return (1 - SMOOTH) * np.interp(margins, at, value) + SMOOTH * smooth


def sample(text: bytes) -> list[bytes]:
    """Chunks to learn from, spread over the whole text by a seed taken from it; a short text in whole, in order."""
    if len(text) <= SAMPLE_BYTES * SAMPLES_PER_TEXT:
        return [text[i : i + SAMPLE_BYTES] for i in range(0, len(text), SAMPLE_BYTES)]
    seeded = random.Random(zlib.crc32(text))
    ends = [len(text) * i // SAMPLES_PER_TEXT for i in range(SAMPLES_PER_TEXT + 1)]
    places = [seeded.randint(a, b - SAMPLE_BYTES) for a, b in zip(ends, ends[1:])]
    return [text[at : at + SAMPLE_BYTES] for at in places]


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def sample_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: sample(t or b""))


def build_dictionary(chunks: list[bytes], size: int) -> bytes:
    """A dictionary trained on chunks, or where these are too few to train one, their end as raw content."""
    try:
        return zstandard.train_dictionary(size, chunks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(chunks)[-size:]


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor | None:
    if not dictionary:
        return None
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False, write_checksum=False
    )


def margin(text: bytes | None, good: zstandard.ZstdCompressor | None, bad: zstandard.ZstdCompressor | None) -> float:
    """(compressed with bad - compressed with good) / bytes; 0 for null and empty texts, or without both dictionaries."""
    if not text or good is None or bad is None:
        return 0.0
    saved = 0
    for at in range(0, len(text), CHUNK_BYTES):
        chunk = text[at : at + CHUNK_BYTES]
        saved += len(bad.compress(chunk)) - len(good.compress(chunk))
    return saved / (len(text) + 1)


def _margins(texts: F.Column, good: bytes, bad: bytes, calibrate=None) -> F.Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with_good, with_bad = compressor(good), compressor(bad)
        for batch in batches:
            found = np.array([margin(t, with_good, with_bad) for t in batch], dtype="float64")
            yield pd.Series(calibrate(found) if calibrate else found)

    # The annotations must be real types for the UDF to be recognised as one over iterators.
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.DoubleType())(texts.cast("binary"))


def _scores(texts: F.Column, model: Model) -> F.Column:
    return _margins(texts, model.good, model.bad, model.calibrate)


def fit_steps(margins: np.ndarray, labels: np.ndarray) -> tuple[tuple[float, float], ...]:
    """Isotonic regression by pooling adjacent violators, then neighbours until a block has LEAST_BLOCK rows; each block is drawn to
    the overall rate by one row's weight."""
    blocks: list[list[float]] = []  # rows, sum of labels, sum of margins
    for m, y in sorted(zip(margins.tolist(), labels.tolist())):
        blocks.append([1, y, m])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n, total, place = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n, blocks[-1][1] + total, blocks[-1][2] + place]
    pooled: list[list[float]] = []
    for block in blocks:
        if pooled and (pooled[-1][0] < LEAST_BLOCK or block is blocks[-1] and block[0] < LEAST_BLOCK):
            pooled[-1] = [a + b for a, b in zip(pooled[-1], block)]
        else:
            pooled.append(block)
    blocks, rate = pooled, float(labels.mean())
    values = np.maximum.accumulate([(total + rate) / (n + 1) for n, total, _ in blocks])
    return tuple((place / n, float(v)) for (n, _, place), v in zip(blocks, values))


def fit_curve(margins: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Logistic regression on one input by Newton steps, lightly held towards no slope so that it stays finite."""
    if len(labels) == 0:
        return 0.0, 0.0
    rate = (labels.sum() + 1) / (len(labels) + 2)
    scale = float(margins.std()) or 1.0
    x = np.column_stack([margins / scale, np.ones(len(margins))])
    w = np.array([0.0, np.log(rate / (1 - rate))])
    hold = np.diag([0.01, 1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (labels - p) - hold @ w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, slope)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from the rows of `labels` (id, 0 or 1) whose documents are in `docs`.

    Labels other than 0 and 1 are ignored; an id labelled more than once counts with its smallest label, and an id with several rows
    with one of them (that of the least chunks, or of the least margin), so what the driver takes in is bounded. With one class or none
    the curve is flat at the share of good labels (one half if there are none).
    """
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__id"))
    known = known.agg(F.min(label_col).cast("int").alias("__label")).withColumn("__at", F.xxhash64("__id", F.lit(7)))
    wanted = None
    for label in (0, 1):  # two bounded samples, each a top-k by hash
        part = known.where(F.col("__label") == label).orderBy("__at", "__id").limit(2 * DICTIONARY_DOCS)
        part = part.withColumn("__use", F.when(F.col("__at") % 2 == 0, "dictionary"))
        wanted = part if wanted is None else wanted.unionByName(part)
    rest = known.orderBy(F.xxhash64("__at"), "__id").limit(2 * CALIBRATION_DOCS)
    rest = rest.where("__at % 2 <> 0").withColumn("__use", F.lit("curve"))
    wanted = wanted.where("__use is not null").unionByName(rest).drop("__at")
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    found = texts.join(F.broadcast(wanted), "__id")  # at most 4 * DICTIONARY_DOCS + 2 * CALIBRATION_DOCS rows

    # One row an id, that of the least sample, so that the driver never sees more rows than ids.
    rows = found.where("__use = 'dictionary' and __text <> ''")
    rows = rows.select("__label", "__id", sample_udf(F.col("__text").cast("binary")).alias("__chunks"))
    rows = rows.groupBy("__label", "__id").agg(F.min("__chunks").alias("__chunks"))
    by_label: dict[int, list[tuple[int, list[bytes]]]] = {0: [], 1: []}
    for row in rows.collect():
        by_label[row["__label"]].append((row["__id"], [bytes(c) for c in row["__chunks"]]))
    sets = [[c for _, chunks in sorted(by_label[k]) for c in chunks] for k in (1, 0)]
    size = min(DICTIONARY_BYTES, max(512, min(sum(map(len, s)) for s in sets) // 4))
    good, bad = (build_dictionary(s, size) for s in sets)

    curve = found.where("__use = 'curve'").select("__id", "__label", _margins(F.col("__text"), good, bad).alias("m"))
    curve = curve.groupBy("__id", "__label").agg(F.min("m").alias("m"))
    points = sorted((r["__id"], r["__label"], r["m"]) for r in curve.collect())
    values, marks = np.array([p[2] for p in points]), np.array([p[1] for p in points], float)
    if len(set(marks)) < 2:
        rate = min(max(marks.mean() if len(marks) else 0.5, 0.01), 0.99)
        return Model(good, bad, 0.0, float(np.log(rate / (1 - rate))))
    enough = min(marks.sum(), (1 - marks).sum()) >= LEAST_FOR_STEPS
    return Model(good, bad, *fit_curve(values, marks), fit_steps(values, marks) if enough else ())


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with columns score and predicted (1 if score >= threshold, else 0), replacing columns of those names.

    Null and empty texts get the curve's value at margin 0; every row is kept, repeated ones too; an empty table stays empty.
    """
    scored = docs.withColumn("score", _scores(F.col(text_col), model))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` predicted good, with their own columns."""
    marked = docs.select(F.struct(*docs.columns).alias("__row"), _scores(F.col(text_col), model).alias("__score"))
    return marked.where(F.col("__score") >= threshold).select("__row.*")
