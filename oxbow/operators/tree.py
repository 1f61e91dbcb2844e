"""Folder trees from paths: directory rows, parents, children, rollups. No recursion: every file names all of its ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ancestors, basename, depth_of, norm_key, parent_of


def directories(catalog: DataFrame, by_key: bool = False) -> DataFrame:
    """(path, parent, name, depth) of every directory above a file, without paths that are files themselves.

    With `by_key`, directories that differ in case or normal form are one; the spelling of the smallest file path stays.
    """
    spelled = catalog.select(F.col("path").alias("file"), F.explode(ancestors(F.col("path"))).alias("path"))
    if by_key:
        keyed = spelled.groupBy(norm_key(F.col("path")).alias("key")).agg(F.min_by("path", "file").alias("path"))
        files = catalog.select(norm_key(F.col("path")).alias("key"))
        found = keyed.join(files, "key", "left_anti").select("path")
    else:
        found = spelled.select("path").distinct().join(catalog.select("path"), "path", "left_anti")
    path = F.col("path")
    return found.select(
        "path", parent_of(path).alias("parent"), basename(path).alias("name"), depth_of(path).cast("int").alias("depth")
    )


def rollup(catalog: DataFrame) -> DataFrame:
    """(dir, n_files, total_bytes, newest, oldest) over everything below each directory, the root as the empty path."""
    above = F.concat(F.array(F.lit("")), ancestors(F.col("path")))
    known = F.when(F.col("mtime") > F.timestamp_seconds(F.lit(0)), F.col("mtime"))
    rows = catalog.select(F.explode(above).alias("dir"), "size_bytes", "mtime", known.alias("known"))
    return rows.groupBy("dir").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum("size_bytes").alias("total_bytes"),
        F.max("mtime").alias("newest"),
        F.min("known").alias("oldest"),
    )


def with_directories(catalog: DataFrame) -> DataFrame:
    """(path, name, parent, depth, is_dir) of files and directories together."""
    path = F.col("path")
    files = catalog.select("path", basename(path).alias("name"), parent_of(path).alias("parent"), depth_of(path).cast("int").alias("depth"))
    return files.withColumn("is_dir", F.lit(False)).unionByName(directories(catalog).withColumn("is_dir", F.lit(True)))


def parent_links(tree: DataFrame) -> DataFrame:
    """`tree` with has_parent: whether the parent directory is a row of its own (false at the top)."""
    dirs = tree.where("is_dir").select(F.col("path").alias("parent"), F.lit(True).alias("__is")).distinct()
    return tree.join(dirs, "parent", "left").withColumn("has_parent", F.coalesce("__is", F.lit(False))).drop("__is")


def child_counts(tree: DataFrame) -> DataFrame:
    """(path, child_count) of every directory, those without children included."""
    counts = tree.groupBy(F.col("parent").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    dirs = tree.where("is_dir").select("path")
    return dirs.join(counts, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("child_count"))


def children(tree: DataFrame, parent: str, limit: int = 500, offset: int = 0) -> DataFrame:
    """One page of a directory: directories first, then by the name's key (see `norm_key`) and path."""
    own = tree.where(F.col("parent") == parent)
    return own.orderBy(F.col("is_dir").desc(), norm_key(F.col("name")), "path").offset(offset).limit(limit)


def sort_directories(totals: DataFrame, by: str = "name") -> DataFrame:
    """Directories ordered by what is below them; ties by name."""
    keys = {"newest": F.col("newest").desc(), "oldest": F.col("oldest").asc(), "largest": F.col("total_bytes").desc(), "smallest": F.col("total_bytes").asc()}
    return totals.orderBy(*([keys[by]] if by in keys else []), "dir")


def subtree(catalog: DataFrame, root: str) -> DataFrame:
    """Rows at or below a path; a prefix predicate that reaches the Parquet scan."""
    path = F.col("path")
    return catalog if root == "" else catalog.where((path == root) | path.startswith(root + "/"))
