"""Mixing sources to target weights by subset-sum budget fitting.

Sources get word budgets by weight; a source that cannot fill its budget passes the excess on. Within a source every document is
taken as often as it fits whole, and the remaining budget is met by a subset of documents, found on counts by exact length: the
bulk in proportion to the counts, the last words by a bounded-knapsack dynamic programme. Which documents of a length are taken
follows a seeded hash of id and text: those below a cut-off that counts by hash give, so that no row is moved to be ranked. Only
where equal rows straddle a cut-off are they counted off, by partition. Per-source work sees lengths and counts, never documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, cut

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2
SEED = 42
RESERVE = 4096
#: Plans of up to so many (source, length) pairs, about 60 bytes each, are broadcast to the documents.
BROADCAST_ROWS = 200_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, rank, source_size, target) from (source, size) rows.

    Weights repeat over the sources by code point, null last. The targets share `share` times all sizes; none exceeds `most` times
    its source's size, and what one cannot take is shared again by weight. Each round of that is one aggregate over the sources.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Ranks by ranges of sources, each range ranked on its own: a column of host names is no single task.
    ranged = totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ranged = cut(ranged)
    before = F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("held")).select("part", before.alias("first"))  # a row a range
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    ranks = ranged.join(F.broadcast(starts), "part").select("source", "source_size", (rank + F.col("first")).alias("rank"))
    table = cut(
        ranks.withColumn(
            "weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
        )
    )
    cap = F.col("source_size") * F.lit(float(most))
    first = table.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    budget, full = share * (first["s"] or 0), 0
    level = budget / first["w"] if first["w"] else 0.0
    while True:
        stopped = F.col("weight") * F.lit(level) >= cap
        row = table.agg(
            F.count_if(stopped).alias("n"),
            F.sum(F.when(stopped, cap)).alias("taken"),
            F.sum(F.when(~stopped, F.col("weight"))).alias("open"),
        ).first()
        if row["n"] <= full or not row["open"]:
            break
        full, level = row["n"], (budget - row["taken"]) / row["open"]
    return table.select("source", "rank", "source_size", F.least(F.col("weight") * F.lit(level), cap).alias("target"))


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, reserve: int = RESERVE) -> np.ndarray:
    """How many documents of each length to take so that their words come as near to `budget` as the lengths allow."""
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total <= budget:
        return counts * (budget > 0)
    bulk = max(0, budget - reserve)
    # Systematic sampling along the lengths, from a seeded start: every stretch of lengths gives its share of the bulk.
    seeded = np.random.default_rng(SEED)
    taken, open_ = np.zeros_like(counts), int(seeded.random() * 2**32) * total >> 32
    for i in np.argsort(lengths, kind="stable").tolist():
        taken[i], open_ = divmod(open_ + int(counts[i]) * bulk, total)
    left = budget - int((taken * lengths).sum())
    order = seeded.permutation(len(lengths)).tolist()
    for i in order:  # what the sample is too long by, at most about one document
        if left >= 0:
            break
        less = min(int(taken[i]), -(left // int(lengths[i])))
        taken[i] -= less
        left += less * int(lengths[i])
    for i in order:
        if left <= reserve:
            break
        more = min(int(counts[i] - taken[i]), (left - reserve) // int(lengths[i]))
        taken[i] += more
        left -= more * int(lengths[i])
    # Bounded knapsack over what is left: piece[s] is the bundle by which the sum s was first reached.
    most = 2 * left
    piece = np.full(most + 1, -1, np.int32)
    reached = np.zeros(most + 1, bool)
    reached[0] = True
    bundles: list[tuple[int, int]] = []
    for i in np.argsort(lengths, kind="stable"):
        length, spare, size = int(lengths[i]), int(counts[i] - taken[i]), 1
        if length > most or reached[left]:
            break
        spare = min(spare, most // length)
        while spare > 0 and size * length <= most:
            size = min(size, spare)
            step = size * length
            fresh = np.zeros(most + 1, bool)
            fresh[step:] = reached[: most + 1 - step]
            fresh &= ~reached
            piece[fresh] = len(bundles)
            reached |= fresh
            bundles.append((int(i), size))
            spare, size = spare - size, size * 2
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - left))])
    while at:
        i, size = bundles[piece[at]]
        taken[i] += size
        at -= size * int(lengths[i])
    return taken


def _plan(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("size")
    target, total = float(group["target"].iloc[0]), int(group["source_size"].iloc[0])
    whole = min(int(target // total), MOST) if total else 0
    some = (group["size"] > 0).to_numpy()
    extra = np.zeros(len(group), np.int64)
    left = round(target) - whole * total if whole < MOST else 0
    extra[some] = fit_budget(group["size"].to_numpy()[some], group["n"].to_numpy()[some], left)
    return pd.DataFrame({"rank": group["rank"], "size": group["size"], "n": group["n"], "whole": whole, "extra": extra})


def _cutoffs(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """(of, plan_size, least, part_of, held): for each source and size of which some rows are taken beyond whole copies, the hash
    `least` up to which they are; of the `held` rows with that very hash, the first `part_of`."""
    key = ["source", "size"]
    some = plan.where("extra > 0 and extra < n").select("of", F.col("plan_size").alias("of_size"), "extra")
    same = F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("of_size"))
    counts = sized.groupBy(*key, "at").agg(F.count(F.lit(1)).alias("m"))  # equal rows are one from here on
    counts = counts.join(some, same).drop("of", "of_size").withColumn("bucket", F.shiftright("at", 56))
    counts = cut(counts)
    earlier = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # 256 buckets
    buckets = counts.groupBy(*key, "extra", "bucket").agg(F.sum("m").alias("m"))
    buckets = buckets.withColumn("first", F.coalesce(F.sum("m").over(earlier), F.lit(0)))
    buckets = buckets.where("first < extra and extra <= first + m").select(
        F.col("source").alias("of"), F.col("size").alias("of_size"), F.col("bucket").alias("of_bucket"), "first"
    )
    inside = counts.join(buckets, same & (F.col("bucket") == F.col("of_bucket")))
    up_to = F.sum("m").over(Window.partitionBy(*key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)) + F.col("first")
    found = inside.withColumn("up_to", up_to).where("up_to - m < extra and extra <= up_to")
    return found.select(
        F.col("source").alias("of"), F.col("size").alias("plan_size"), F.col("at").alias("least"),
        (F.col("extra") - F.col("up_to") + F.col("m")).alias("part_of"), F.col("m").alias("held"),
    )


def _draw(rows: DataFrame, id_col: str, text_col: str, source_col: str, weights, share: float, seed: int, carry: Column) -> DataFrame:
    """(row, size, source_size, target, copies) for each row; `carry` is what is kept of it."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_PATTERN)).cast("long"), F.lit(0))
    at = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(text_col))
    sized = cut(rows.select(carry.alias("row"), F.col(source_col).cast("string").alias("source"), size.alias("size"), at.alias("at")))
    targets = cut(source_targets(sized.select("source", "size"), weights, share))
    counts = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    joined = counts.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    plan = (
        joined.groupBy("rank")
        .applyInPandas(
            lambda g: _plan(g[["rank", "size", "n", "target", "source_size"]]),
            "rank long, size long, n long, whole int, extra long",
        )
        .withColumnRenamed("rank", "plan_rank")
        .withColumnRenamed("size", "plan_size")
    )
    plan = cut(
        targets.join(plan, F.col("rank") == F.col("plan_rank")).select(
            F.col("source").alias("of"), "plan_size", "source_size", "target", "n", "whole", "extra"
        )
    )
    cutoffs = _cutoffs(sized, plan).withColumnsRenamed({"of": "its", "plan_size": "its_size"})
    plan = plan.join(cutoffs, F.col("of").eqNullSafe(F.col("its")) & (F.col("plan_size") == F.col("its_size")), "left").drop("its", "its_size")
    plan = cut(plan)
    # Lengths and sources are few beside documents; where they are not, the join shuffles.
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_ROWS else plan
    drawn = sized.withColumn("part", F.spark_partition_id())
    drawn = drawn.join(plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("plan_size"))).drop("of")
    equal = F.coalesce((F.col("at") == F.col("least")) & (F.col("part_of") < F.col("held")), F.lit(False))
    picked = F.when(F.col("extra") == 0, 0).when(F.col("extra") == F.col("n"), 1).otherwise((F.col("at") <= F.col("least")).cast("int"))
    settled = drawn.where(~equal).withColumn("picked", picked)

    # Equal rows of which some are taken: as many of each partition as are left after the partitions before it.
    tied, key = drawn.where(equal), ["source", "size"]
    earlier = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = tied.groupBy(*key, "part").agg(F.count(F.lit(1)).alias("n_part"))
    held = held.withColumn("before", F.coalesce(F.sum("n_part").over(earlier), F.lit(0)))
    held = held.select(F.col("source").alias("of"), F.col("size").alias("of_size"), F.col("part").alias("of_part"), "before")
    same = F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("of_size")) & (F.col("part") == F.col("of_part"))
    number = F.row_number().over(Window.partitionBy(*key, "part").orderBy("at"))
    counted = tied.join(held, same).withColumn("picked", (number + F.col("before") <= F.col("part_of")).cast("int"))
    columns = ["row", "size", "source_size", "target", "whole", "picked"]
    out = settled.select(columns).unionByName(counted.select(columns))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("picked")).otherwise(F.lit(0))
    return out.select("row", "size", "source_size", "target", copies.alias("copies"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies), a row for each row of `docs`.

    size: words of the text (null: 0). copies: how often the mix takes the row, 0 to 2; taken = copies * size. Null sources form
    a source of their own; documents without words are never taken beyond whole copies; repeated rows are rows of their own;
    extra columns are ignored; an empty table gives no rows. The same rows give the same mix, however they are partitioned.
    """
    out = _draw(docs, id_col, text_col, source_col, weights, share, seed, F.col(id_col))
    taken = (F.col("copies") * F.col("size")).cast("long").alias("taken")
    return out.select(F.col("row").alias("doc_id"), "size", "source_size", "target", taken, "copies")


def apply_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    seed: int = SEED,
) -> DataFrame:
    """The mix itself: each row of `docs` as often as `mix` takes that very row, with its own columns. Rows of one id are rows of
    their own; which of the rows equal in id and text are taken follows their place where only some are."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    out = _draw(docs, id_col, text_col, source_col, weights, share, seed, whole)
    return out.where("copies > 0").select(F.inline(F.array_repeat("row", F.col("copies"))))
