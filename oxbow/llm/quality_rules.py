"""Quality rules learned as a decision list, on DataFrame functions alone.

Statistics of each whole text are columns. Sequential covering learns rules from labelled statistics: a rule is a conjunction of
thresholds that grows, condition by condition, towards bad documents, is pruned on rows kept aside, and then takes the rows it
covers away before the next rule grows. Rules come out in order, as Spark conditional expressions: the first that holds decides.

Learning never gathers rows: each step is one aggregate of label counts by statistic and bin over all labelled rows, and the driver
sees those counts alone (statistics times BINS rows).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "[#*$%&|<>]"
MARKS = r"[!?#*$%&|<>{}\[\]=~^_\\/+@]"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
BINS = 32
MAX_RULES = 12
MAX_CONDITIONS = 3
LEAST_COVERED = 6
LEAST_PRECISION = 0.8
STATISTICS = ["n_words", "word_length", "symbol_share", "duplicate_lines", "repeat_share", "upper_share", "mark_share", "variety"]


def _bind(value: Column, use) -> Column:
    """use(value) with the value computed once, also inside lambdas."""
    return F.transform(F.array(value), use)[0]


def _repeated(words: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more in the text."""

    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def count(pairs: Column) -> Column:
            n = F.size(pairs)
            twin = lambda p, j: (
                ((j > 0) & (F.get(pairs, j - 1)["h"] == p["h"])) | ((j + 1 < n) & (F.get(pairs, j + 1)["h"] == p["h"]))
            )
            at = F.array_sort(F.transform(F.filter(pairs, twin), lambda p: p["i"]))
            start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
            step = lambda s, i: F.struct(
                (i + WINDOW).alias("end"), (s["n"] + WINDOW - F.greatest(F.lit(0), s["end"] - i)).alias("n")
            )
            return F.aggregate(at, start, step, lambda s: s["n"])

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_bind(ordered, count))

    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, F.lit(WINDOW))))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(_bind(_bind(hashed, windows), covered))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, __base) for each row of `docs`, materialised, since learning reads it several times.

    __base has n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and further counts of the whole text. Words are runs of characters other than 0x20 and 0x09 to 0x0D; null texts have none. Windows are compared by 64-bit hashes.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(BLANK_CHARS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANKS))

    def counts(d: Column) -> Column:
        lines = F.filter(F.split(d["text"], "\n"), lambda line: F.btrim(line, F.lit(BLANK_CHARS)) != "")
        letters = F.aggregate(d["words"], F.lit(0).cast("long"), lambda s, x: s + F.char_length(x))
        total = F.char_length(d["text"])
        number = lambda pattern: (total - F.char_length(F.regexp_replace(d["text"], pattern, ""))).cast("long")
        return F.struct(
            F.size(d["words"]).cast("long").alias("n_words"),
            letters.alias("word_chars"),
            number(SYMBOLS).alias("n_symbols"),
            _bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            _repeated(d["words"]).cast("long").alias("n_repeat_words"),
            F.size(F.array_distinct(d["words"])).cast("long").alias("n_distinct"),
            F.size(lines).cast("long").alias("n_lines"),
            number(r"\p{Lu}").alias("n_upper"),
            number(MARKS).alias("n_marks"),
        )

    base = _bind(F.struct(text.alias("text"), words.alias("words")), counts)
    return cut(docs.select(F.col(id_col).alias("doc_id"), base.alias("__base")))


def statistics() -> dict[str, Column]:
    """The statistics that rules are made of, from __base; 0 where a denominator is 0."""
    b = lambda name: F.col(f"__base.{name}").cast("double")
    share = lambda a, n: F.when(b(n) > 0, b(a) / b(n)).otherwise(F.lit(0.0))
    return {
        "n_words": b("n_words"),
        "word_length": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "duplicate_lines": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "mark_share": share("n_marks", "word_chars"),
        "variety": share("n_distinct", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool  # holds for values >= threshold, else for values < threshold
    threshold: float

    def holds(self) -> Column:
        column = F.col(self.statistic)
        return column >= self.threshold if self.above else column < self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.above else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """Documents that meet all conditions are bad."""

    conditions: tuple[Condition, ...]

    def holds(self) -> Column:
        return reduce(lambda a, b: a & b, (c.holds() for c in self.conditions))

    def __str__(self) -> str:
        return " AND ".join(map(str, self.conditions)) + " THEN bad"


def decide(rules: list[Rule]) -> Column:
    """The decision list as one conditional expression over the statistics: true for documents to keep."""
    decision = F.lit(None)
    for rule in reversed(rules):
        decision = F.when(rule.holds(), F.lit(False)).otherwise(decision)
    return F.coalesce(decision, F.lit(True))


def _gain(bad: int, good: int, bad_before: int, good_before: int) -> float:
    """Information gain of narrowing a rule, weighted by the bad rows it still covers."""
    if not bad:
        return -math.inf
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad_before / (bad_before + good_before)))


def learn(
    labelled: DataFrame, least_precision: float = LEAST_PRECISION, max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS
) -> list[Rule]:
    """Rules from rows (the statistics, bad boolean, prune boolean): prune rows judge, the others grow.

    Thresholds are quantiles of each statistic over the bad and over the good rows. A rule ends growing when it covers no good
    row or no condition gains; pruning keeps the leading conditions with the best precision on the prune rows, and learning stops
    with the first rule whose precision there is under `least_precision`, or which covers fewer than LEAST_COVERED bad rows.
    Without rows of both kinds there are no rules.
    """
    quantiles = [F.percentile_approx(s, [i / (BINS // 2) for i in range(1, BINS // 2)], 10_000).alias(s) for s in STATISTICS]
    edges: dict[str, list[float]] = {s: [] for s in STATISTICS}
    for row in labelled.groupBy("bad").agg(*quantiles).collect():
        for s in STATISTICS:
            edges[s] = sorted({*edges[s], *(row[s] or [])})

    def binned(s: str) -> Column:
        """How many of a statistic's thresholds its value reaches."""
        below = F.filter(F.array(*map(F.lit, edges[s])), lambda e: e <= F.col(s)) if edges[s] else F.array()
        return F.struct(F.lit(s).alias("s"), F.size(below).alias("bin"))

    entries = [binned(s) for s in STATISTICS]
    table = cut(labelled.select(*STATISTICS, "bad", "prune", F.array(*entries).alias("bins")))
    rules: list[Rule] = []
    while len(rules) < max_rules:
        free = reduce(lambda a, r: a & ~r.holds(), rules, F.lit(True))
        chosen: list[Condition] = []
        while len(chosen) < max_conditions:
            inside = reduce(lambda a, c: a & c.holds(), chosen, free & ~F.col("prune"))
            counted = table.where(inside).select("bad", F.inline("bins")).groupBy("s", "bin")
            counts: dict[str, dict[int, tuple[int, int]]] = {s: {} for s in STATISTICS}
            for row in counted.agg(F.count_if("bad").alias("b"), F.count_if(~F.col("bad")).alias("g")).collect():
                counts[row["s"]][row["bin"]] = (row["b"], row["g"])
            bad = sum(b for b, _ in counts[STATISTICS[0]].values())
            good = sum(g for _, g in counts[STATISTICS[0]].values())
            if bad < LEAST_COVERED or (chosen and not good):
                break
            best, found = 1e-9, None
            for s in STATISTICS:
                under_bad = under_good = 0
                for i, edge in enumerate(edges[s]):
                    b, g = counts[s].get(i, (0, 0))
                    under_bad, under_good = under_bad + b, under_good + g
                    for above, x, y in ((False, under_bad, under_good), (True, bad - under_bad, good - under_good)):
                        gain = _gain(x, y, bad, good)
                        if x >= LEAST_COVERED and gain > best:
                            best, found = gain, Condition(s, above, edge)
            if found is None:
                break
            chosen.append(found)
        if not chosen:
            break
        heads = [Rule(tuple(chosen[: i + 1])) for i in range(len(chosen))]
        sums = [
            F.count_if(free & F.col("prune") & head.holds() & (F.col("bad") == F.lit(kind))).alias(f"{'b' if kind else 'g'}{i}")
            for i, head in enumerate(heads)
            for kind in (True, False)
        ]
        row = table.agg(*sums).first()
        precision = [(row[f"b{i}"] + 1) / (row[f"b{i}"] + row[f"g{i}"] + 2) for i in range(len(heads))]
        at = max(range(len(heads)), key=lambda i: (precision[i], row[f"b{i}"], -i))
        if precision[at] < least_precision:
            break
        rules.append(heads[at])
    return rules


def fit(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> list[Rule]:
    """Learn from all rows of `labels` (id, 0 or 1) whose documents are in `measured` (see `measure`); other labels are ignored.

    An id labelled more than once counts with its smallest label. Half of the rows, by a hash of the id, judge the rules.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__label"))
    rows = measured.select("doc_id", *(c.alias(s) for s, c in statistics().items()))
    rows = rows.join(known, rows["doc_id"] == known["__id"])
    return learn(rows.select(*STATISTICS, (F.col("__label") == 0).alias("bad"), (F.xxhash64("__id") % 2 == 0).alias("prune")))


def base_failed() -> Column:
    b = lambda name: F.col(f"__base.{name}")
    return (b("n_words") < LEAST_WORDS) | (100 * b("n_repeat_words") > MOST_REPEATED * b("n_words"))


def judge(measured: DataFrame, rules: list[Rule]) -> DataFrame:
    """A row for each row of `measured` (see `measure`): doc_id, base statistics, base_failed, kept.

    kept is false if the base rule fails, else the decision list's verdict. Null and empty texts have no words and fail;
    repeated rows stay; an empty table stays empty.
    """
    named = measured.select("doc_id", "__base", base_failed().alias("base_failed"), *(c.alias(s) for s, c in statistics().items()))
    return named.select(
        "doc_id",
        *(F.col(f"__base.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        "base_failed",
        (~F.col("base_failed") & decide(rules)).alias("kept"),
    )
