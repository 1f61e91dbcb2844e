"""Language identification in two steps: the language family first, then one-versus-one linear support vector machines inside it.

Features are hashed byte n-grams of the lower-cased letters of the whole text. A one-versus-rest machine picks the family; every pair
of languages of that family has a machine of its own, and the language that wins most of its pairs is the answer. The machines
are trained on a bounded sample by dual coordinate descent; predicting reads each text once, multiplies all machines with a batch of
texts at once, and shuffles nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Texts to learn from, over all languages together; each language gets an equal share.
SAMPLE_DOCS = 2_400
#: Languages to learn, the most frequent ones: a bound for columns that hold anything else than language codes.
MOST_LANGUAGES = 256
BINS = 4096
UNKNOWN = "und"

# Families of languages by ISO 639-1 code. Any other language is a family of its own.
FAMILIES = {
    "germanic": ["da", "de", "en", "is", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
    "semitic": ["ar", "he", "mt"],
    "iranian": ["fa", "ku", "ps", "tg"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
_NO_LETTER = re.compile(r"[\W\d_]+")
_SLAB = 1 << 20
_ROWS = 256


@dataclass
class Model:
    """languages by family; weights (BINS + 1, last for the bias) by family and by pair of languages."""

    languages: dict[str, list[str]] = field(default_factory=dict)
    families: dict[str, np.ndarray] = field(default_factory=dict)
    pairs: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)


def features(text: str | None) -> np.ndarray | None:
    """Unit vector of square roots of hashed byte 1- to 3-gram counts, with a last 1 for the bias; None without a letter."""
    words = _NO_LETTER.sub(" ", (text or "").lower())
    if not any(map(str.isalpha, words)):
        return None
    raw = np.frombuffer(f" {words} ".encode("utf-8", "replace"), np.uint8)
    counts = np.zeros(BINS)
    for at in range(0, len(raw), _SLAB):  # bounded memory, however long the text is
        part = raw[at : at + _SLAB + 2].astype(np.uint32)
        own = min(_SLAB, len(part))
        for n in (1, 2, 3):
            code = part[: len(part) - n + 1].copy()
            for j in range(1, n):
                code = code * np.uint32(257) + part[j : len(part) - n + 1 + j]
            code = (code * np.uint32(2654435761) + np.uint32(n)) >> np.uint32(32 - 12)
            counts += np.bincount(code[:own], minlength=BINS)[:BINS]
    root = np.sqrt(counts)
    return np.append(root / np.linalg.norm(root), 1.0)


def train_svm(x: np.ndarray, at: np.ndarray, y: np.ndarray, c: float = 20.0, epochs: int = 40) -> np.ndarray:
    """Linear L2-loss support vector machine by dual coordinate descent on the rows `at` of x; y is +1 or -1 for each of them."""
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(y))
    diagonal = np.array([x[i].astype(float) @ x[i] for i in at]) + 0.5 / c
    order = np.random.default_rng(42)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(y)):
            row = x[at[i]]
            slope = y[i] * (row @ w) - 1 + alpha[i] * 0.5 / c
            new = max(alpha[i] - slope / diagonal[i], 0.0)
            if new != alpha[i]:
                moved = max(moved, abs(new - alpha[i]))
                w += (new - alpha[i]) * y[i] * row
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample: int = SAMPLE_DOCS,
    languages: int = MOST_LANGUAGES,
) -> Model:
    """Learn the `languages` most frequent non-null languages of `docs` from at most `sample` texts (8 a language at least), drawn by
    a hash of id and text, equally by language. Texts that are equal and share an id count once.

    Counts and hashes find out which texts are drawn; only these are turned into vectors, where they lie, and only vectors reach the
    driver: 16 KB each, `sample` of them.
    """
    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("__lang"), F.col(text_col).alias("__text"),
        F.xxhash64(F.lit(5), F.col(id_col).cast("string"), F.col(text_col)).alias("__at"))
    counts = known.groupBy("__lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "__lang").limit(languages).collect()
    if not counts:
        return Model()
    each = max(8, sample // len(counts))
    share = F.create_map(*(F.lit(v) for r in counts for v in (r["__lang"], min(1.0, 1.5 * each / r["n"] + 10 / r["n"]))))
    chance = F.pmod(F.xxhash64("__at"), F.lit(1 << 30)) < F.try_element_at(share, F.col("__lang")) * (1 << 30)
    # The `each` least hashes of a language, of those that the chance above lets through: about 1.5 times as many.
    place = F.row_number().over(Window.partitionBy("__lang").orderBy("__at"))
    least = known.where(chance).select("__lang", "__at").distinct().withColumn("place", place).where(F.col("place") <= each)
    drawn = F.broadcast(least.select("__lang", "__at"))  # at most `each` rows a language
    rows = known.where(chance).join(drawn, ["__lang", "__at"], "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = [(lang, at, features(t)) for lang, at, t in zip(batch["__lang"], batch["__at"], batch["__text"])]
            found = [(lang, at, v.astype("<f4").tobytes()) for lang, at, v in vectors if v is not None]
            yield pd.DataFrame(found, columns=["lang", "at", "v"])

    vectors = rows.mapInPandas(run, "lang string, at long, v binary").groupBy("lang", "at").agg(F.min("v").alias("v"))
    taken = sorted(vectors.collect(), key=lambda r: (r["lang"], r["at"]))
    x = np.stack([np.frombuffer(r["v"], "<f4") for r in taken]) if taken else np.zeros((0, BINS + 1), "<f4")
    own: dict[str, list[int]] = {}
    for i, row in enumerate(taken):
        own.setdefault(row["lang"], []).append(i)
    model, families = Model(), {}
    for lang in sorted(own):
        family = _FAMILY_OF.get(lang, lang)
        model.languages.setdefault(family, []).append(lang)
        families.setdefault(family, []).extend(own[lang])

    def separate(positive: list[int], negative: list[int]) -> np.ndarray:
        return train_svm(x, np.array(positive + negative), np.repeat([1.0, -1.0], [len(positive), len(negative)]))

    for family in families if len(families) > 1 else []:
        model.families[family] = separate(families[family], [i for f, at in families.items() if f != family for i in at])
    for langs in model.languages.values():
        for a, b in combinations(langs, 2):
            model.pairs[a, b] = separate(own[a], own[b])
    return model


def _chance(margin: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(3 * margin, -30, 30))))


def decide(margins: dict[str, float], duels: dict[tuple[str, str], float], model: Model) -> tuple[str, float]:
    """(language, score): the family of the largest margin, then the language that wins most duels in it, ties to the larger sum of
    margins; `margins` by family (empty with one family), `duels` by pair, positive where the first language wins."""
    family = max(margins, key=lambda f: (margins[f], f)) if margins else next(iter(model.languages))
    score = _chance(margins[family]) if margins else 1.0
    wins = {lang: [0, 0.0] for lang in model.languages[family]}
    for a, b in combinations(model.languages[family], 2):
        margin = duels[a, b]
        wins[a if margin >= 0 else b][0] += 1
        wins[a][1], wins[b][1] = wins[a][1] + margin, wins[b][1] - margin
    lang = max(wins, key=lambda x: (*wins[x], x))
    if len(wins) > 1:
        score *= _chance(wins[lang][1] / (len(wins) - 1))
    return lang, score


def predict_texts(texts: list[str | None], model: Model) -> list[tuple[str, float]]:
    """(language, score from 0 to 1) of each text, or (und, 0) for one that is null or has no letter, or without any language
    learned. All machines are multiplied with the vectors of the texts at once."""
    found: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    machines = [*model.families.values(), *model.pairs.values()]
    weights = np.stack(machines).T if machines else np.zeros((BINS + 1, 0))
    for begin in range(0, len(texts) if model.languages else 0, _ROWS):
        vectors = [(begin + i, features(t)) for i, t in enumerate(texts[begin : begin + _ROWS])]
        vectors = [(i, v) for i, v in vectors if v is not None]
        for (i, _), row in zip(vectors, (np.stack([v for _, v in vectors]) @ weights).tolist() if vectors else []):
            margins, duels = row[: len(model.families)], row[len(model.families) :]
            found[i] = decide(dict(zip(model.families, margins)), dict(zip(model.pairs, duels)), model)
    return found


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row of `docs`, whole texts; repeated rows stay, an empty table stays empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = predict_texts(batch["__text"].tolist(), model)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": [x for x, _ in found], "score": [s for _, s in found]})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("__text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {id_type}, lang_pred string, score double")
