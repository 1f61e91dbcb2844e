"""SimHash near-duplicates by pivot distance tables.

Every fingerprint gets a table row of Hamming distances to reference fingerprints (pivots). The triangle inequality bounds how far
two linked fingerprints may lie apart in any coordinate, so pairs whose largest coordinate difference exceeds the threshold are
discarded without being compared. Two kinds of pivots serve that bound:

* axis pivots, the zero fingerprint and its 64 single-bit neighbours. A coordinate minus the zero coordinate is +1 or -1, and a
  flipped bit changes one such difference. With the axes dealt into `groups` groups, a pair within `max_bits` leaves all but
  `max_bits` groups unchanged, so it agrees exactly on the coordinates of some choice of the others: an equi-join, not a scan
  of all pairs;
* SCATTERED seeded random fingerprints, whose distances are packed seven to a long, so that five subtractions compare all
  coordinates of a pair at once. Two random fingerprints that agree on half of their bits lie within two of each other in one
  coordinate of two, about; within two in all 35 of them next to never. Pairs four bits apart pass in one case of a hundred.

A join key that more than `dense` distinct fingerprints share is not paired up. Its members are joined through meeting points: two
fingerprints are within two bits exactly if some fingerprint is within one bit of both. Each member emits its 65 such points, and
a point joins at most 65 members, so the work stays linear and no link is lost. The pairs of either way pass the pivots' bound and
are then verified on their bits.
"""

from __future__ import annotations

import random
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, cut, slabs

SEED = 42
MAX_BITS = 2
GROUPS = 4
DENSE = 64
SCATTERED = 35
_PACKED = 7  # distances a long; its top byte stays free, so that no subtraction overflows
_SLAB = 1 << 16


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), _SLAB):
        part = hashes[start : start + _SLAB].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return ones


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """Signed 64-bit SimHash of lower-cased word shingles, repeats included; null or no word: 0."""
    ones, total, last = np.zeros(64, np.int64), 0, []
    for part in slabs(text or b""):
        tokens = last + part.lower().split()
        last = tokens[len(tokens) - words + 1 :] if len(tokens) >= words else tokens
        shingles = max(0, len(tokens) - words + 1)
        found = map(b" ".join, zip(*(tokens[i:] for i in range(words))))
        hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), found), np.uint64, shingles)
        ones, total = ones + _bit_counts(hashes), total + shingles
    if not total and last:  # fewer words than a shingle: the whole sequence
        whole = np.array([xxhash.xxh64_intdigest(b" ".join(last), seed=SEED)], np.uint64)
        ones, total = _bit_counts(whole), 1
    if not total:
        return 0
    bits = np.packbits(ones * 2 > total, bitorder="little")
    return int(bits.view("<i8")[0])


@F.pandas_udf(T.LongType())
def fingerprint_udf(texts: pd.Series) -> pd.Series:
    return texts.map(fingerprint).astype("int64") if len(texts) else pd.Series([], dtype="int64")


def axis_keys(prints: DataFrame, groups: int = GROUPS, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, key), a row for each choice of groups of axis pivots that a pair within `max_bits` may agree on."""
    zero = F.bit_count("fp").cast("int")
    axes = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(1 << j)))).cast("int") - zero for j in range(64)]
    dealt = [axes[64 * g // groups : 64 * (g + 1) // groups] for g in range(groups)]
    keys = [
        F.xxhash64(F.lit(i), *(c for g in chosen for c in dealt[g]))
        for i, chosen in enumerate(combinations(range(groups), groups - max_bits))
    ]
    return prints.select("fp", F.explode(F.array(*keys)).alias("key"))


def pivot_table(fp: Column, scattered: int = SCATTERED) -> list[Column]:
    """The distances of a fingerprint to the scattered pivots, packed into columns p0, p1 and so on, a byte each."""
    seeded = random.Random(SEED)
    pivots = [_signed(seeded.getrandbits(64)) for _ in range(scattered)]
    packed = []
    for at in range(0, scattered, _PACKED):
        whole = F.lit(0).cast("long")
        for i, pivot in enumerate(pivots[at : at + _PACKED]):
            distance = F.bit_count(fp.bitwiseXOR(F.lit(pivot))).cast("long")
            whole = whole.bitwiseOR(F.shiftleft(distance, 8 * i))
        packed.append(whole.alias(f"p{at // _PACKED}"))
    return packed


def within_bound(left: str, right: str, scattered: int = SCATTERED, max_bits: int = MAX_BITS) -> Column:
    """True where no coordinate of two rows of the table differs by more than `max_bits`.

    All bytes of a long at once: with 128 added to each, the difference of two bytes stays in its own byte (64 to 192), and adding or
    taking away the bound moves it over 128 exactly if it lies outside.
    """
    ones, tops = (sum(x << (8 * i) for i in range(_PACKED)) for x in (1, 128))
    outside = F.lit(0).cast("long")
    for i in range(-(-scattered // _PACKED)):
        apart = F.col(f"{left}.p{i}").bitwiseOR(F.lit(tops)) - F.col(f"{right}.p{i}")
        above, enough = apart - F.lit((max_bits + 1) * ones), apart + F.lit(max_bits * ones)
        outside = outside.bitwiseOR(above).bitwiseOR(F.bitwise_not(enough))
    return outside.bitwiseAND(F.lit(tops)) == 0


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >= 1 << 63 else bits


def candidates(prints: DataFrame, scattered: int = SCATTERED, dense: int = DENSE) -> DataFrame:
    """Pairs (l, r) of table rows (fp, p0..) that meet on a key of up to `dense` fingerprints, or at a point of a denser one."""
    keys = cut(axis_keys(prints.select("fp").distinct()))
    shared = cut(keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    row = F.struct(F.col("fp"), *pivot_table(F.col("fp"), scattered)).alias("row")
    few = keys.join(shared.where(F.col("members") <= dense), "key").select("key", row)
    left, right = few.alias("a"), few.alias("b")
    pairs = left.join(right, (F.col("a.key") == F.col("b.key")) & (F.col("a.row.fp") < F.col("b.row.fp")))

    many = keys.join(shared.where(F.col("members") > dense), "key").select("fp").distinct()
    around = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << j))) for j in range(64)))
    points = many.select(row, F.explode(around).alias("point"))
    met = points.groupBy("point").agg(F.array_sort(F.collect_set("row")).alias("rows")).where(F.size("rows") > 1)
    others = F.slice("rows", F.lit(2), F.size("rows") - 1)
    stars = met.select(F.col("rows")[0].alias("l"), F.explode(others).alias("r"))
    return pairs.select(F.col("a.row").alias("l"), F.col("b.row").alias("r")).unionByName(stars)


def links(prints: DataFrame, scattered: int = SCATTERED, dense: int = DENSE) -> DataFrame:
    """Links (a, b) that connect the same distinct fingerprints as all pairs within two bits do.

    Keys of up to `dense` fingerprints give every such pair; denser keys give stars through meeting points (see above), which
    link the same members without listing all their pairs.
    """
    left = candidates(prints, scattered, dense).where(within_bound("l", "r", scattered))
    near = F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= MAX_BITS
    return left.where(near).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b")).distinct()


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs`.

    component_id is the smallest doc_id that links of at most two bits reach, the row itself included. Null and wordless texts
    have the zero fingerprint and link like any other. Rows with a null doc_id take part in links but never name a component
    unless all of its rows lack an id (then null). Repeated rows stay repeated; other columns are ignored; an empty table gives
    an empty result.
    """
    marked = cut(docs.select(F.col(id_col).alias("doc_id"), fingerprint_udf(F.col(text_col).cast("binary")).alias("fp")))
    prints = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = connected_components(links(prints))
    named = (
        prints.join(roots, prints.fp == roots.node)
        .groupBy("root")
        .agg(F.min("least_id").alias("component_id"))
        .join(roots, "root")
        .select(F.col("node").alias("fp"), "component_id")
    )
    classes = prints.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id"))
    classes = cut(classes)  # so that the last join stands alone, and Spark may split a fingerprint with many copies
    return marked.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row for each component: that of the smallest id, null ids last; of rows with that id, the one whose text and
    then whose columns have the least hash, so that a rerun keeps the same row."""
    columns = docs.columns
    filled = [F.col(f"`{c}`") for c in columns]
    mark = F.struct(
        F.col(id_col).isNull().alias("no_id"),
        F.col(id_col).alias("id"),
        F.xxhash64(text_col).alias("t"),
        F.xxhash64(*filled, *(c.isNull() for c in filled)).alias("r"),
    )
    marked = cut(docs.select(mark.alias("mark"), fingerprint_udf(F.col(text_col).cast("binary")).alias("fp")))
    prints = cut(marked.groupBy("fp").agg(F.min("mark").alias("mark")))
    roots = connected_components(links(prints))
    chosen = prints.join(roots, prints.fp == roots.node, "left").groupBy(F.coalesce("root", "fp").alias("root"))
    chosen = cut(chosen.agg(F.min("mark").alias("__mark")).select("__mark.*"))
    rows = docs.select(F.struct(*filled).alias("__row"), mark.alias("__mark")).select("__row", "__mark.*")
    same = rows["id"].eqNullSafe(chosen["id"]) & (rows["t"] == chosen["t"]) & (rows["r"] == chosen["r"])
    kept = rows.join(chosen, same, "left_semi").dropDuplicates(["id", "t", "r"])
    return kept.select("__row.*")
