"""Differences between two states of a catalogue, and merging one into the other. All by equi-joins on the path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.meta import canonical_json
from ..functions.text import is_under

_JSON_START = r"^\s*[\[{\"\-0-9tfnIN]"
DRIFT_FIELDS = ["size_bytes", "extractor", "meta"]
VIEW_FIELDS = ["size_bytes", "mtime", "extractor", "meta", "is_symlink", "symlink_target", "symlink_ok"]


def diff(old: DataFrame, new: DataFrame, fields: list[str] = DRIFT_FIELDS, key: str = "path") -> DataFrame:
    """(key, change): added, removed or changed in one of `fields` (null equals null). Unchanged rows are left out.

    Metadata are compared as JSON values: texts that differ only in blanks or in the order of keys are equal. Only rows whose texts
    differ, and which nothing else tells apart, are sent to be parsed.
    """
    a = old.select(F.col(key), F.struct(*fields).alias("a"))
    b = new.select(F.col(key), F.struct(*fields).alias("b"))
    both = a.join(b, key, "full_outer")
    plain = [f for f in fields if f != "meta"]
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed")
    for f in plain:
        change = change.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), "changed")
    if "meta" not in fields:
        return both.select(key, change.alias("change")).where("change is not null")
    marked = both.select(key, change.alias("change"), F.col("a.meta").alias("x"), F.col("b.meta").alias("y"))
    # Only two texts that may both be JSON can be equal values without being equal texts.
    json_like = F.coalesce(F.col("x").rlike(_JSON_START) & F.col("y").rlike(_JSON_START), F.lit(False))
    differ = F.when(~F.col("x").eqNullSafe(F.col("y")) & ~json_like, "changed")
    sure = marked.select(key, F.coalesce("change", differ).alias("change")).where("change is not null")
    unsure = marked.where(F.col("change").isNull() & ~F.col("x").eqNullSafe(F.col("y")) & json_like)
    changed = unsure.where(~canonical_json(F.col("x")).eqNullSafe(canonical_json(F.col("y"))))
    return sure.unionByName(changed.select(key, F.lit("changed").alias("change")))


def apply_delta(current: DataFrame, upserts: DataFrame, removed: DataFrame, key: str = "path") -> DataFrame:
    """`current` without removed and replaced rows, plus the upserts."""
    gone = removed.select(key).unionByName(upserts.select(key))
    return current.join(gone, key, "left_anti").select(*current.columns).unionByName(upserts.select(*current.columns))


def health_flips(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, flip): links that are newly broken or newly repaired; links that are gone count as repaired."""
    broken = lambda df: df.where("is_symlink and not symlink_ok").select("path").distinct()
    was, now = broken(old), broken(new)
    return now.subtract(was).withColumn("flip", F.lit("broken")).unionByName(was.subtract(now).withColumn("flip", F.lit("repaired")))


def is_racy(mtime: Column, reference: Column, window: float = 2.0) -> Column:
    """Whether a file changed so close to the last look that an equal time proves nothing; no reference, no race."""
    return F.coalesce(mtime > reference - window, F.lit(False))


def reusable(current: DataFrame, prior: DataFrame, reference: Column | None = None, key: str = "path") -> DataFrame:
    """`current` with `reuse`: same size and time as in `prior`, extracted there without an error, and not racy."""
    old = prior.select(
        key, F.col("size_bytes").alias("__size"), F.col("mtime").alias("__mtime"), F.col("extractor").alias("__by"), F.col("error").alias("__error")
    )
    same = (F.col("size_bytes") == F.col("__size")) & (F.col("mtime") == F.col("__mtime"))
    good = F.col("__by").isNotNull() & F.col("__error").isNull()
    racy = F.lit(False) if reference is None else is_racy(F.unix_micros("mtime") / 1e6, reference)
    joined = current.join(old, key, "left").withColumn("reuse", F.coalesce(same & good & ~racy, F.lit(False)))
    return joined.select(*current.columns, "reuse")


def latest(rows: DataFrame, keys: list[str], *newest_first: Column) -> DataFrame:
    """One row for each key, the first by `newest_first`."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*newest_first))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def upsert(current: DataFrame, changes: DataFrame, key: str = "path") -> DataFrame:
    """Changed rows in place of those with their key; a merge as one outer join of the key and a coalesce."""
    a = current.select(key, F.struct(*current.columns).alias("a"))
    b = changes.select(key, F.struct(*current.columns).alias("b"))
    return a.join(b, key, "full_outer").select(F.coalesce("b", "a").alias("row")).select("row.*")


def sweep(current: DataFrame, seen: DataFrame, root: str = "", key: str = "path") -> DataFrame:
    """`current` without the rows at or below `root` that are not in `seen`."""
    marks = seen.select(F.col(key).alias("__seen")).distinct()
    inside = F.coalesce(is_under(F.col(key), root), F.lit(False))
    joined = current.join(marks, inside & (F.col(key) == F.col("__seen")), "left")
    return joined.where(~inside | F.col("__seen").isNotNull()).select(*current.columns)


def known(current: DataFrame, keys: DataFrame, key: str = "path") -> DataFrame:
    return current.join(keys.select(key).distinct(), key, "left_semi")
