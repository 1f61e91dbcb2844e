"""Audit of how filters interact: what each removes, would have removed, and costs, in every order of application.

Duplicates are found by sorting. Rows are dealt into ranges of (text fingerprint, doc_id, a number of the row), so that copies of one
text, however many, spread over tasks, and are sorted within their task by fingerprint, full text and doc_id. A task then only
compares each row with its predecessor. A text that lies on both sides of a boundary is settled afterwards: each task reports the texts of its
first and its last fingerprint with their smallest id, and these few reports, not the rows, are grouped by text.

What fails is one short string a document, such as "ACE". From there on only counts by part and such strings move: they are additive,
so they are merged before each shuffle, and all orders are worked out from at most 32 counts a part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, cut

FILTERS = "ABCDE"
# The bounds and characters of the filters.
LEAST_WORDS = 200
LEAST_VARIETY = 50
MOST_CAPITALS = 2
MARKS = "[#$%&*|]"
BLANKS = r"[\x20\x09-\x0D]+"

_NO_ID = np.iinfo(np.int64).max
SORTED = "doc_id long, part string, fails string, task long, place long, first_id long, fingerprint long, edge string"


def fingerprint(text: Column) -> Column:
    return F.xxhash64(text)


def text_failures(text: Column) -> Column:
    """Letters of the filters A to D that a text fails, in order."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    checks = F.transform(
        F.array(words),
        lambda w: F.concat(
            F.when(F.size(w) < LEAST_WORDS, "A").otherwise(""),
            F.when(100 * F.size(F.array_distinct(w)) < LEAST_VARIETY * F.size(w), "B").otherwise(""),
        ),
    )
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return F.concat(
        F.get(checks, 0),
        F.when(100 * capitals > MOST_CAPITALS * F.char_length(text), "C").otherwise(""),
        F.when(text.rlike(MARKS), "D").otherwise(""),
    )


class Runs:
    """Runs of equal texts in rows that arrive sorted by fingerprint, text and id, batch by batch.

    `begin` is the smallest id of a row's run so far in this task, _NO_ID while there is none. `place` numbers the texts of the first fingerprint, -1 after
    it. `edges` has (place, fingerprint, text, smallest id) of the texts of the first and of the last fingerprint.
    """

    def __init__(self):
        self.last: tuple[int, str] | None = None
        self.least, self.first, self.place = _NO_ID, None, 0
        self.heads: list[tuple[int, int, str, int]] = []
        self.tails: dict[str, int] = {}

    def add(self, prints: np.ndarray, texts: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, place) of each row."""
        n = len(prints)
        same = np.zeros(n, bool)  # as its predecessor
        alike = np.flatnonzero(prints[1:] == prints[:-1])
        if len(alike):
            same[alike + 1] = pc.equal(texts.take(pa.array(alike + 1)), texts.take(pa.array(alike))).to_numpy(zero_copy_only=False)
        same[0] = self.last is not None and self.last[0] == prints[0] and self.last[1] == texts[0].as_py()
        if self.first is None:
            self.first = int(prints[0])
        starts = np.unique(np.concatenate([[0], np.flatnonzero(~same)]))
        least = np.minimum.reduceat(ids, starts)
        if same[0]:
            least[0] = min(least[0], self.least)
        begin = np.repeat(least, np.diff(np.append(starts, n)))
        place = np.full(n, -1)
        for k in np.flatnonzero(prints[starts] == self.first).tolist():  # one run, but for texts whose fingerprints collide
            if k or not same[0]:
                self.heads.append((len(self.heads), self.first, texts[int(starts[k])].as_py(), int(least[k])))
            else:
                self.heads[-1] = (*self.heads[-1][:3], int(least[k]))
            place[starts[k] : n if k + 1 == len(starts) else starts[k + 1]] = len(self.heads) - 1
        final = int(prints[-1])
        if self.last is None or self.last[0] != final:
            self.tails = {}
        for k in np.flatnonzero(prints[starts] == final).tolist():
            self.tails[texts[int(starts[k])].as_py()] = int(least[k])
        self.last, self.least = (final, texts[n - 1].as_py()), int(least[-1])
        return begin, place

    def edges(self) -> list[tuple[int, int, str, int]]:
        if self.last is None:
            return []
        tails = [] if self.last[0] == self.first else [(-1, self.last[0], t, i) for t, i in self.tails.items()]
        return self.heads + tails


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SORTED rows: one for each document, and one with an `edge` text for each text at the task's ends."""
    task, runs = TaskContext.get().partitionId(), Runs()
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    names = [c.split()[0] for c in SORTED.split(", ")]
    for batch in batches:
        if not batch.num_rows:
            continue
        doc, part, fails, text, prints = (batch.column(i) for i in range(5))
        ids = pc.fill_null(doc, _NO_ID).to_numpy(zero_copy_only=False)
        begin, place = runs.add(prints.to_numpy(zero_copy_only=False), text, ids)
        n = len(ids)
        repeated = pa.array((ids > begin) & ~doc.is_null().to_numpy(zero_copy_only=False))
        place = pa.array(np.where(ids > begin, -1, place))  # a copy of an earlier row is one for certain
        fails = pc.binary_join_element_wise(fails, pc.if_else(repeated, "E", ""), "")
        none = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())]
        yield pa.RecordBatch.from_arrays([doc, part, fails, pa.array([task] * n, pa.int64()), place, *none], names=names)
    for place, fingerprint, text, least in runs.edges():
        row = [None, None, None, task, place, None if least == _NO_ID else least, fingerprint, text]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, fails, n): counts of documents by id, part and the letters of the filters that they fail.

    Null texts and parts are empty. A text is a duplicate (E) where a row with the same text has a smaller id; rows of one id are not
    duplicates of each other, and a row without an id neither is one nor makes one. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        text.alias("text"),
        fingerprint(text).alias("fingerprint"),
        F.monotonically_increasing_id().alias("row"),  # splits even rows that are equal in everything
    )
    dealt = rows.repartitionByRange("fingerprint", "doc_id", "row").sortWithinPartitions("fingerprint", "text", "doc_id")
    # The filters of the text come after the exchange, whose sampling runs what lies before it twice.
    judged = dealt.select("doc_id", "part", text_failures(F.col("text")).alias("fails"), "text", "fingerprint")
    found = cut(judged.mapInArrow(_sorted_runs, SORTED))
    edges = found.where("edge is not null")
    firsts = edges.groupBy("fingerprint", "edge").agg(F.min("first_id").alias("first_id"))
    heads = edges.where("place >= 0").select("task", "place", "fingerprint", "edge").join(firsts, ["fingerprint", "edge"])
    rows, columns = found.where("edge is null"), ["doc_id", "part", "fails"]
    count = F.count(F.lit(1)).alias("n")
    closed = rows.where("place < 0").groupBy(*columns).agg(count)
    open_ = rows.where("place >= 0").groupBy(*columns, "task", "place").agg(count)
    settled = F.when(F.col("doc_id") > F.col("first_id"), F.concat("fails", F.lit("E"))).otherwise(F.col("fails"))
    at_ends = open_.join(heads.select("task", "place", "first_id"), ["task", "place"], "left")
    return closed.unionByName(at_ends.select("doc_id", "part", settled.alias("fails"), "n"))


def counters(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, fails, n, good, toxic): additive counts of documents, and of those labelled good (quality 1) and toxic.

    Several labels of one id count once each way: good if any says so, and toxic if any does.
    """
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id"))
    said = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    known = failed.join(marks.agg(said("quality"), said("toxic")), "doc_id", "left")
    times = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0)))
    return known.groupBy("part", "fails").agg(F.sum("n").alias("n"), times("quality").alias("good"), times("toxic").alias("toxic"))


def orders(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every order of the filters, step by step, from `counters`; a row for each part, order and step."""
    every = F.array(*(F.lit("".join(p)) for p in permutations(filters)))
    steps = counted.select("*", F.explode(every).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    own = F.substr("filter_order", F.col("step"), F.lit(1))
    before = F.substring(F.col("filter_order"), F.lit(1), F.col("step") - 1)
    fails_own = F.contains("fails", own)
    earlier = F.exists(F.split("fails", ""), lambda c: (c != "") & F.contains(before, c))
    removed = fails_own & ~earlier
    total = lambda where, what="n": F.sum(F.when(where, F.col(what)).otherwise(0)).cast("long")
    share = F.col("n") * len(list(permutations(filters))) / F.char_length("fails")
    return steps.groupBy("part", "filter_order", "step").agg(
        total(~fails_own & ~earlier).alias("kept"),
        total(removed).alias("removed"),
        total(fails_own & earlier).alias("redundant"),
        total(F.col("fails") == own).alias("unique_fails"),
        total(removed, "good").alias("good_lost"),
        total(removed, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails_own, share).otherwise(0)).cast("long").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters A to E and step in it; see the functions above for nulls, ties and repeated rows.

    An empty table has no parts and so no rows. `shapley` is what a step's filter removes, summed up over all orders: of k failed filters
    each comes first in a k-th of them.
    """
    return orders(counters(failures(docs), labels))
