"""Tiered ranking: folders, then names, paths and metadata, in a short band."""

from __future__ import annotations

from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_fold, basename, composed_class, holds, nfd_pattern, nfd_token
from .search import Search, condition, order, with_name

BAND, FOLDERS = 20, 3


def tier_of(name: Column, path: Column, tokens: list[str]) -> Column:
    """1 if every token is in the folded name, 2 if every token is in the folded path (or there is none), else null."""
    if not tokens:
        return F.lit(2)
    in_name = reduce(and_, (holds(name, t) for t in tokens))
    in_path = reduce(and_, (holds(name, t) | holds(path, t) for t in tokens))
    return F.when(in_name, 1).when(in_path, 2)


def boundary(name: Column, tokens: list[str]) -> Column:
    """Whether some token starts, at any of its places, at the name's start, after / - . _ or a digit, or as an upper-case letter
    after any other. The last needs a name whose decomposition is as long as itself."""
    parts = []
    for token in filter(None, tokens):
        pattern, _ = nfd_pattern(token)
        parts.append(name.rlike(rf"(?i)(?:^|(?<=[/\-._0-9])){pattern}"))
        if token[0].isascii() and token[0].isalpha():
            rest, _ = nfd_pattern(token[1:]) if len(token) > 1 else ("", False)
            kept = ~name.rlike(r"[^\x00-\x7F]") | ~name.rlike(composed_class())
            parts.append(name.rlike(rf"(?<![A-Z]){token[0].upper()}(?i:{rest})") & kept)
    return reduce(or_, parts) if parts else F.lit(False)


def _folded(rows: DataFrame, column: str) -> Column:
    """The stored fold of a column, or the fold of it."""
    return F.col(f"{column}_fold") if f"{column}_fold" in rows.columns else ascii_fold(F.col(column))


def tree_rows(catalog: DataFrame, search: Search, found_elsewhere: DataFrame | None = None) -> DataFrame:
    """Files that pass the filters and hold every token in their path, or whose path is in `found_elsewhere` (path)."""
    passing = catalog.where(condition(Search([], search.filters), "ui"))
    in_path = reduce(and_, (holds(_folded(passing, "path"), nfd_token(t)) for t in search.free), F.lit(True))
    if found_elsewhere is None:
        return passing.where(in_path)
    marks = found_elsewhere.select("path", F.lit(True).alias("__found")).distinct()
    return passing.join(marks, "path", "left").where(in_path | F.coalesce("__found", F.lit(False))).drop("__found")


def folder_hits(dirs: DataFrame, tokens: list[str], k: int = FOLDERS) -> DataFrame:
    """(path, rank): folders whose own name holds every token, shortest name first, then by path."""
    if not tokens or k <= 0:
        return dirs.limit(0).select("path", F.lit(1).alias("rank"))
    name = basename(F.col("path"))
    hits = dirs.where(reduce(and_, (holds(ascii_fold(name), nfd_token(t)) for t in tokens)))
    top = hits.orderBy(F.char_length(name), "path").limit(k)
    rank = F.row_number().over(Window.orderBy(F.char_length(name), "path"))  # at most k rows
    return top.select("path", rank.alias("rank"))


def top_hits(
    catalog: DataFrame,
    search: Search,
    dirs: DataFrame | None = None,
    found_elsewhere: DataFrame | None = None,
    sort: str = "name",
    k: int = BAND,
    collation: str | None = None,
) -> DataFrame:
    """(rank, path, is_folder, tier, matched, boundary): the k best hits, ranked.

    Folders first (at most 3), then files that match every token, by tier, boundary and the sort; files that match some tokens fill
    up what is left and rank below. Files of `found_elsewhere` (path) match in tier 3. Without tokens all passing files rank by
    the sort alone. Composed and decomposed accents match. Full matches sort above partial ones, so one bounded top-k serves both; whether partial ones may show
    depends only on how many full ones the top holds.
    """
    tokens = [nfd_token(t) for t in search.free]
    files = with_name(catalog).where(condition(Search([], search.filters), "ui"))
    name, path = _folded(files, "name"), _folded(files, "path")
    tier = tier_of(name, path, tokens)
    if tokens and found_elsewhere is not None:
        marks = found_elsewhere.select("path", F.lit(3).alias("__tier")).distinct()
        files = files.join(marks, "path", "left")
        tier = F.coalesce(tier, F.col("__tier"))
    held = [holds(path, t) for t in tokens]
    matched = reduce(add, (h.cast("int") for h in held), F.lit(0))
    partial_tier = F.when(
        reduce(and_, (~h | holds(name, t) for h, t in zip(held, tokens)), F.lit(True)), 1
    ).otherwise(2)
    partial_boundary = reduce(or_, (h & boundary(F.col("name"), [t]) for h, t in zip(held, tokens)), F.lit(False))
    full = tier.isNotNull()
    ranked = files.select(
        "path", "name", "category", "size_bytes", "mtime",
        F.coalesce(tier, partial_tier).alias("tier"),
        F.when(full, F.lit(len(tokens))).otherwise(matched).alias("matched"),
        F.when(full, boundary(F.col("name"), tokens)).otherwise(partial_boundary).alias("boundary"),
        full.alias("full"),
    ).where("full or matched > 0")
    best = [F.col("matched").desc(), F.col("tier"), F.col("boundary").desc(), *order(sort, collation)]
    top = ranked.orderBy(*best).limit(k).withColumn("at", F.row_number().over(Window.orderBy(*best)))
    columns = ["is_folder", "path", "tier", "matched", "boundary", "at"]
    out = top.withColumn("is_folder", F.lit(False)).select(columns)
    if dirs is not None and tokens:
        folders = folder_hits(dirs, tokens, min(FOLDERS, k)).select(
            F.lit(True).alias("is_folder"), "path", F.lit(0).alias("tier"), F.lit(len(tokens)).alias("matched"),
            F.lit(True).alias("boundary"), F.col("rank").alias("at"),
        )
        out = folders.unionByName(out)
    rank = F.row_number().over(Window.orderBy(F.col("is_folder").desc(), "at"))  # at most k + 3 rows
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("rank", *columns[:-1])
