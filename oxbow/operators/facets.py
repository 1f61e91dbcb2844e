"""Counts over a catalogue: facets, health, groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ancestors, basename, parent_of


def facets(catalog: DataFrame) -> DataFrame:
    """(facet, value, n): files by category and by extension in one pass, nulls and empty values left out."""
    pairs = F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in ("category", "ext")))
    rows = catalog.select(F.inline(pairs)).where("value is not null and value <> ''")
    return rows.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def summary(catalog: DataFrame) -> DataFrame:
    """One row: files, bytes, links, broken links, errors."""
    broken = F.coalesce(F.col("is_symlink") & ~F.col("symlink_ok"), F.lit(False))
    return catalog.agg(
        F.count(F.lit(1)).alias("n_files"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"),
        F.count_if("is_symlink").alias("n_symlinks"),
        F.count_if(broken).alias("n_broken_symlinks"),
        F.count_if(F.col("error").isNotNull()).alias("n_errors"),
    )


def summary_maps(catalog: DataFrame) -> DataFrame:
    """One row: by_category and by_ext, files by each value in the values' order; nulls count as other and as the empty extension."""
    named = {"by_category": F.coalesce("category", F.lit("other")), "by_ext": F.coalesce("ext", F.lit(""))}
    pairs = F.array(*(F.struct(F.lit(name).alias("map"), value.alias("value")) for name, value in named.items()))
    counts = catalog.select(F.inline(pairs)).groupBy("map", "value").agg(F.count(F.lit(1)).alias("n"))  # a row a value from here on
    whole = lambda name: F.map_from_entries(
        F.array_sort(F.collect_list(F.when(F.col("map") == name, F.struct("value", "n"))))
    ).alias(name)
    return counts.agg(*(whole(name) for name in named))


def ext_categories(catalog: DataFrame) -> DataFrame:
    """(ext, category): the first non-empty category in path order."""
    rows = catalog.where("ext <> '' and category <> ''")
    return rows.groupBy("ext").agg(F.min_by("category", "path").alias("category"))


def category_groups(hits: DataFrame, priority: list[str]) -> DataFrame:
    """(category, n, newest, position): hits by category; listed categories first, in that order, then by name."""
    groups = hits.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.max("mtime").alias("newest"))
    position = F.array_position(F.array(*map(F.lit, priority)), F.col("category"))
    return groups.withColumn("position", F.when(position > 0, position).otherwise(len(priority) + 1).cast("int"))


def folder_groups(hits: DataFrame, token: str) -> DataFrame:
    """(dir, n, newest, relevance, depth): hits by the shallowest folder above them whose name holds the token, else by their own folder.

    relevance is 0 for a folder whose own name holds the token, 1 for one below such a folder, 2 otherwise and without a token; depth is
    the number of names in the folder's path. Groups are shown by relevance, depth, newest first, dir.
    """
    held = lambda text: F.contains(F.lower(text), F.lit(token)) if token else F.lit(False)
    named = F.filter(ancestors(F.col("path")), lambda d: held(basename(d)))
    own = F.coalesce(F.get(named, 0), parent_of(F.col("path")))
    groups = hits.groupBy(own.alias("dir")).agg(F.count(F.lit(1)).alias("n"), F.max("mtime").alias("newest"))
    relevance = F.when(held(basename(F.col("dir"))), 0).when(held(F.col("dir")), 1).otherwise(2)
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    return groups.withColumns({"relevance": relevance, "depth": depth})


def pinned_first(values: DataFrame, column: str, favourites: list[str]) -> DataFrame:
    """Values with their position: favourites in their own order, then the rest, to be ordered by value."""
    at = F.array_position(F.array(*map(F.lit, favourites)), F.col(column))
    return values.withColumn("position", F.when(at > 0, at).otherwise(len(favourites) + 1).cast("int"))


def largest(catalog: DataFrame, category: str, k: int = 25) -> DataFrame:
    return catalog.where(F.col("category") == category).orderBy(F.col("size_bytes").desc(), "path").limit(k)


def widest(catalog: DataFrame, k: int = 12, category: str = "data_matrix") -> DataFrame:
    """The matrices of most rows, by n_obs and then path; those whose shape is unknown take no part."""
    known = catalog.where((F.col("category") == category) & F.col("n_obs").isNotNull())
    return known.orderBy(F.col("n_obs").desc(), "path").limit(k)
