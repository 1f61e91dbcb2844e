"""Aggregates of a catalogue that follow its changes, instead of being counted anew.

Changes become signed rows: what leaves counts -1, what comes +1. Counts and sums take them as they are. A least or greatest value takes new rows
as they are too, and is looked for again only where a row that left may have been it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ancestors

def signed(current: DataFrame, upserts: DataFrame, removed: DataFrame, key: str = "path") -> DataFrame:
    """Rows of `current` that a delta removes or replaces, with sign -1, and the upserts with sign 1.

    `removed` has keys, which need not be there; repeated keys count once. Only changed keys are joined with the catalogue.
    """
    keys = removed.select(key).unionByName(upserts.select(key)).distinct()
    leaves = current.join(keys, key, "left_semi").select(*current.columns, F.lit(-1).alias("sign"))
    return leaves.unionByName(upserts.select(*current.columns, F.lit(1).alias("sign")))


def counts_after(counts: DataFrame, changes: DataFrame) -> DataFrame:
    """`facets.facets` counts (facet, value, n) after signed rows; values that nothing has any more leave."""
    pairs = F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in ("category", "ext")))
    moved = changes.select(F.col("sign").cast("long").alias("n"), F.inline(pairs)).where("value is not null and value <> ''")
    return counts.select("n", "facet", "value").unionByName(moved).groupBy("facet", "value").agg(F.sum("n").alias("n")).where("n <> 0")


def summary_after(summary: DataFrame, changes: DataFrame) -> DataFrame:
    """The row of `facets.summary` after signed rows."""
    broken = F.coalesce(F.col("is_symlink") & ~F.col("symlink_ok"), F.lit(False))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    adds = {
        "n_files": F.lit(1), "total_bytes": F.coalesce("size_bytes", F.lit(0)), "n_symlinks": flag(F.col("is_symlink")),
        "n_broken_symlinks": flag(broken), "n_errors": flag(F.col("error").isNotNull()),
    }
    moved = changes.select(*((F.col("sign") * v).cast("long").alias(c) for c, v in adds.items()))
    return summary.select(*adds).unionByName(moved).agg(*(F.sum(c).alias(c) for c in adds))


def _per_directory(rows: DataFrame, sign: Column) -> DataFrame:
    """A row for each directory above each row, with what the row adds to its state."""
    above = F.concat(F.array(F.lit("")), ancestors(F.col("path")))
    known = F.when(F.col("mtime") > F.timestamp_seconds(F.lit(0)), F.col("mtime"))
    times = lambda c: F.when(c.isNotNull(), sign).otherwise(0)
    return rows.select(
        F.explode(above).alias("dir"), sign.alias("n_files"), times(F.col("size_bytes")).alias("n_sized"),
        F.coalesce(sign * F.col("size_bytes"), F.lit(0)).alias("total_bytes"), times(F.col("mtime")).alias("n_timed"), times(known).alias("n_known"),
        F.col("mtime").alias("at"), known.alias("known"), sign.alias("sign"),
    )


_SUMS = ("n_files", "n_sized", "total_bytes", "n_timed", "n_known")


def rollup_state(catalog: DataFrame) -> DataFrame:
    """What `tree.rollup` needs to be kept up: its values, and how many rows each rests on."""
    rows = _per_directory(catalog, F.lit(1).cast("long"))
    return rows.groupBy("dir").agg(*(F.sum(c).alias(c) for c in _SUMS), F.max("at").alias("newest"), F.min("known").alias("oldest"))


def rollup_of(state: DataFrame) -> DataFrame:
    """(dir, n_files, total_bytes, newest, oldest), as `tree.rollup` counts them."""
    return state.select("dir", "n_files", F.when(F.col("n_sized") > 0, F.col("total_bytes")).alias("total_bytes"), "newest", "oldest")


def rollup_after(state: DataFrame, changes: DataFrame, after: DataFrame) -> DataFrame:
    """The state after signed rows; `after` is the catalogue after them.

    Of `after` only rows below directories that may have lost their newest or oldest row are looked at; directories without rows leave.
    """
    moved = _per_directory(changes, F.col("sign").cast("long"))
    came, left = F.col("sign") > 0, F.col("sign") < 0
    moved = moved.groupBy("dir").agg(
        *(F.sum(c).alias(f"d_{c}") for c in _SUMS),
        F.max(F.when(came, F.col("at"))).alias("new_newest"), F.min(F.when(came, F.col("known"))).alias("new_oldest"),
        F.max(F.when(left, F.col("at"))).alias("left_newest"), F.min(F.when(left, F.col("known"))).alias("left_oldest"),
    )
    both = state.join(moved, "dir", "full_outer")
    sums = [(F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"d_{c}"), F.lit(0))).alias(c) for c in _SUMS]
    # A row that left at the newest time matters unless one came that is as new.
    lost = lambda old, gone, new, beats: F.coalesce(F.col(gone) == F.col(old), F.lit(False)) & ~F.coalesce(beats(F.col(new), F.col(old)), F.lit(False))
    both = both.select(
        "dir", *sums, F.greatest("newest", "new_newest").alias("newest"), F.least("oldest", "new_oldest").alias("oldest"),
        (lost("newest", "left_newest", "new_newest", Column.__ge__) | lost("oldest", "left_oldest", "new_oldest", Column.__le__)).alias("lost"),
    ).where("n_files > 0")
    again = both.where("lost").select("dir")
    found = _per_directory(after, F.lit(1).cast("long")).select("dir", "at", "known").join(again, "dir", "left_semi")
    found = found.groupBy("dir").agg(F.max("at").alias("newest"), F.min("known").alias("oldest"))
    kept = both.where("not lost").drop("lost")
    return kept.unionByName(both.where("lost").drop("lost", "newest", "oldest").join(found, "dir"))
