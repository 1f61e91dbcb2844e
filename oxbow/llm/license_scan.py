"""License scans: winnowed template fingerprints in an inverted index, then alignment in the bands that their hits leave open.

Templates are cut into word k-grams; of every `window` consecutive k-grams the one with the least hash becomes a fingerprint
(winnowing), so any run of window + k - 1 words shared with a template holds a fingerprint. A template so short that the words it may
lack can leave only shorter runs has all its grams indexed, of the length of the run that is sure to be left. The inverted index maps fingerprints to
template positions. Each text is read once: its k-grams probe the index, and each hit names a template and a place in it. Hits grow to runs of
equal words, and runs that ascend in both texts are chained, as long as the words put in between two of them stay below `room`. Only the bands
between the runs of a chain, and at its two ends, are aligned, word against word; so a block of other words costs no more than its own
length, and a copy of thousands of words no more than a short one for each word.

The index is as large as the templates, which are a parameter of at most MAX_TEMPLATE_WORDS words in all; it travels with the task.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import TEXTS

MAX_TEMPLATE_WORDS = 1_000_000
K = 3
WINDOW = 2
#: Words that may be put in between two runs: BAND in a short template, half its length in one of SHORT words and more, at most ROOM.
BAND, SHORT, ROOM = 4, 40, 200
LEAST_COVERAGE = 0.8
LONG_TEXT = 4_000_000
_WORD = re.compile(r"\w+(?:[.-]\w+)*")

# Short notices, standard headers and full texts of common licenses, by SPDX identifier.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files, to deal in the Software without restriction",
    **TEXTS,
}

SCHEMA = "license string, coverage double, matched int, start int, end int"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def fingerprints(words: list[str], k: int = K, window: int = WINDOW) -> set[int]:
    """Positions of the winnowed k-grams of a template; a template shorter than k is one fingerprint."""
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [(xxhash.xxh64_intdigest(g), -i) for i, g in enumerate(grams)]
    return {-min(hashes[i : i + window])[1] for i in range(max(1, len(hashes) - window + 1))}


def sure_run(count: int, least: float) -> int:
    """Words in a row that are left of a template of `count` words, whichever words a match of coverage `least` replaces."""
    lacking = count - math.ceil(least * count - 1e-9)
    return -(-(count - lacking) // (lacking + 1))


class Index:
    """Inverted index of fingerprints: first word -> lengths of grams, gram -> [(template, position)]."""

    def __init__(self, templates: dict[str, str], k: int = K, window: int = WINDOW, least: float = LEAST_COVERAGE):
        self.k, self.words = k, {name: words_of(text) for name, text in templates.items()}
        if sum(map(len, self.words.values())) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words")
        self.known = {word: word for words in self.words.values() for word in words}
        self.window = window
        self.sizes: dict[str, set[int]] = {}
        self.grams: dict[tuple[str, ...], list[tuple[str, int]]] = {}
        for name, words in self.words.items():
            if not words:
                continue
            run = sure_run(len(words), least)
            if run >= k + window - 1:
                size, places = k, fingerprints(words, k, window)
            else:
                size = max(1, min(k, run))
                places = set(range(len(words) - size + 1))
            for at in places:
                gram = tuple(words[at : at + size])
                self.sizes.setdefault(gram[0], set()).add(len(gram))
                self.grams.setdefault(gram, []).append((name, at))

    def reduce(self, text: str) -> list[str | None]:
        """The words of a text, those that no template has as None, so that a long text takes a pointer a word."""
        low = text.lower()
        words = _WORD.findall(low) if len(low) < LONG_TEXT else (m.group() for m in _WORD.finditer(low))
        return [self.known.get(w) for w in words]

    def hits(self, words: list[str | None]) -> dict[str, list[tuple[int, int, int]]]:
        """(text position, template position, length) of the grams that meet, by template, in the order of the text."""
        found: dict[str, list[tuple[int, int, int]]] = {}
        for i, word in enumerate(words):
            for size in self.sizes.get(word, ()):
                if i + size > len(words):
                    continue
                for name, at in self.grams.get(tuple(words[i : i + size]), ()):
                    found.setdefault(name, []).append((i, at, size))
        return found

    def least_exact(self, name: str, least: float) -> float:
        """Words that runs must have for a match: what lies outside them shares only runs too short for a fingerprint."""
        count = len(self.words[name])
        run = min(self.k + self.window - 1, sure_run(count, least))
        outside = (run - 1) / run
        return max(0.0, (least - outside) / (1 - outside)) * count


def room(count: int) -> int:
    return BAND if count < SHORT else max(BAND, min(ROOM, count // 2))


def common(template: list[str], words: list[str | None], stop: bool = False) -> tuple[int, int]:
    """(how many words the two have in common in order, how many of `words` that takes), by one addition a word over the bits of `template`.

    The second is counted only with `stop`.
    """
    masks: dict[str, int] = {}
    for at, word in enumerate(template):
        masks[word] = masks.get(word, 0) | 1 << at
    full = row = (1 << len(template)) - 1
    best, used = 0, 0
    for at, word in enumerate(words):
        met = row & masks.get(word, 0)
        if met:
            row = ((row + met) | (row - met)) & full
            if stop and (count := len(template) - row.bit_count()) > best:
                best, used = count, at + 1
    return (best, used) if stop else (len(template) - row.bit_count(), len(words))


def exact_runs(template: list[str], words: list[str | None], hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(text position, template position, words) of the longest runs of equal words around the hits, in the order of the text."""
    ends: dict[int, int] = {}
    runs = []
    for i, at, size in hits:
        if ends.get(i - at, -1) >= i + size:
            continue
        a, b = i + size, at + size
        while a < len(words) and b < len(template) and words[a] == template[b]:
            a, b = a + 1, b + 1
        ends[i - at] = a
        while i and at and words[i - 1] == template[at - 1]:
            i, at = i - 1, at - 1
        runs.append((i, at, a - i))
    return sorted(runs)


def chains(runs: list[tuple[int, int, int]], most: int) -> list[list[tuple[int, int, int]]]:
    """Runs put together to chains that ascend in both texts, with at most `most` words of the text between two, the longest chains
    first; each run in one chain, cut where it overlaps the one before it."""
    starts, places, sizes = np.array(runs, np.int64).T
    ends = starts + sizes
    reach = np.maximum.accumulate(ends)
    score, before, low = np.zeros(len(runs), np.int64), np.full(len(runs), -1), 0
    for h in range(len(runs)):
        while low < h and reach[low] < starts[h] - most:
            low += 1
        score[h] = sizes[h]
        if low < h:
            g = slice(low, h)
            over = np.maximum(np.maximum(ends[g] - starts[h], places[g] + sizes[g] - places[h]), 0)
            fits = (starts[g] < starts[h]) & (places[g] < places[h]) & (ends[g] >= starts[h] - most) & (over < sizes[h])
            total = np.where(fits, score[g] - over, -1)
            best = int(total.argmax())
            if total[best] > 0:
                score[h], before[h] = sizes[h] + total[best], low + best
    used, out = np.zeros(len(runs), bool), []
    for h in np.lexsort((ends, -score)).tolist():
        chain = []
        while h >= 0 and not used[h]:
            used[h] = True
            chain.append(runs[h])
            h = int(before[h])
        if chain:
            out.append(_apart(chain[::-1]))
    return out


def _apart(chain: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out = chain[:1]
    for i, at, n in chain[1:]:
        over = max(out[-1][0] + out[-1][2] - i, out[-1][1] + out[-1][2] - at, 0)
        out.append((i + over, at + over, n - over))
    return out


def align(template: list[str], words: list[str | None], chain: list[tuple[int, int, int]], most: int) -> tuple[int, int, int]:
    """(matched, first, last): the template's words met in order along a chain, and the text positions that they span."""
    matched = sum(n for *_, n in chain)
    for (i, at, n), (j, to, _) in zip(chain, chain[1:]):
        if i + n < j and at + n < to:
            matched += common(template[at + n : to], words[i + n : j])[0]
    (i, at, _), (j, to, n) = chain[0], chain[-1]
    ahead = words[max(0, i - at - most) : i][::-1]
    more, used = common(template[:at][::-1], ahead, stop=True)
    behind = words[j + n : j + n + len(template) - to - n + most]
    rest, further = common(template[to + n :], behind, stop=True)
    return matched + more + rest, i - used, j + n - 1 + further


def scan_text(text: str | None, index: Index, least: float = LEAST_COVERAGE) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, matched, start, end) of a text; start and end are code points. Overlaps go to the match of
    more words, so a license's text is not lost to a notice that it quotes."""
    words = index.reduce(text or "")
    found = []
    for name, hits in index.hits(words).items():
        template, enough = index.words[name], index.least_exact(name, least)
        most, runs = room(len(template)), exact_runs(template, words, hits)
        if len(set().union(*(range(at, at + n) for at, n in {(at, n) for _, at, n in runs}))) < enough:
            continue  # all runs together hold too little of the template
        for chain in chains(runs, most):
            if sum(n for *_, n in chain) < enough:
                continue
            matched, a, b = align(template, words, chain, most)
            if matched >= least * len(template):
                found.append((-matched, -matched / len(template), a, b, name))
    taken: list[tuple[int, int]] = []  # apart from each other, in order
    chosen = []
    for matched, share, a, b, name in sorted(set(found)):
        at = bisect.bisect(taken, (a, b))
        if (at == 0 or taken[at - 1][1] < a) and (at == len(taken) or b < taken[at][0]):
            taken.insert(at, (a, b))
            chosen.append((a, b, name, -share, -matched))
    if not chosen:
        return []
    needed = {i for a, b, *_ in chosen for i in (a, b)}
    places, count = {}, 0
    # Lower-casing can change lengths, so places are taken from the text itself, if it has the same words.
    for source in (text, text.lower()):
        for count, word in enumerate(_WORD.finditer(source), 1):
            if count - 1 in needed:
                places[count - 1] = word.span()
        if count == len(words):
            break
    return [(name, share, matched, places[a][0], places[b][1]) for a, b, name, share, matched in sorted(chosen)]


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, str] | None = None,
    k: int = K,
    window: int = WINDOW,
    least: float = LEAST_COVERAGE,
) -> DataFrame:
    """(doc_id, license, coverage, matched, start, end): a row for each notice found in a whole text.

    coverage is the share of the template's words matched in order (at least `least`); start and end are its place in code points.
    Null and empty texts have none, repeated rows repeat theirs, other columns are ignored, an empty table gives none. A match
    must share a run of window + k - 1 words with its template (a template too short for that: as many as `sure_run` says, at most k).
    """
    index = Index(TEMPLATES if templates is None else templates, k, window, least)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *f) for i, t in zip(batch["doc_id"], batch["__text"]) for f in scan_text(t, index, least)]
            yield pd.DataFrame(rows, columns=["doc_id", "license", "coverage", "matched", "start", "end"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("__text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {id_type}, {SCHEMA}")
