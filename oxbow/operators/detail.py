"""The detail view of one entry: its row, what its metadata says, and its lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.meta import int_at, strings_at


def column_names(meta: Column) -> Column:
    """Names of the columns, whether the metadata has plain names or structs with a name."""
    named = F.from_json(F.get_json_object(meta, "$.columns"), "array<struct<name:string>>")
    names = F.filter(F.transform(named, lambda c: c["name"]), lambda c: c.isNotNull())
    return F.when(F.get_json_object(meta, "$.columns[0].name").isNotNull(), names).otherwise(strings_at(meta, "columns"))


def sheets(meta: Column) -> Column:
    return F.from_json(F.get_json_object(meta, "$.sheets"), "array<struct<name:string,n_columns:long,row_count:long,row_count_exact:boolean>>")


def row_count_note(meta: Column) -> Column:
    """Why a row count is missing or inexact, in words; null if there is nothing to say."""
    reason = F.get_json_object(meta, "$.row_count_reason")
    known = F.when(reason == "size_gated", "not counted: the file is too large").when(reason == "read_error", "not counted: the file could not be read")
    known = known.when(reason == "empty", "the file is empty").when(reason == "no_dimension", "the sheet declares no size")
    exact = F.get_json_object(meta, "$.row_count_exact") == "false"
    return F.coalesce(known, F.when(exact & int_at(meta, "row_count").isNotNull(), "as declared, not counted"))


def entry(catalog: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """One row: the entry with its column names, sheets and note, the paths it refers to, those that refer to it, and which of
    either are not in the catalogue."""
    meta = F.col("meta")
    row = catalog.where(F.col("path") == path)
    row = row.withColumns({"column_names": column_names(meta), "sheet_list": sheets(meta), "row_count_note": row_count_note(meta)})
    ends = edges.where((F.col("src") == path) | (F.col("dst") == path))
    other = F.when(F.col("src") == path, F.col("dst")).otherwise(F.col("src"))
    ends = ends.select(other.alias("other"), (F.col("src") == path).alias("out"))
    known = ends.join(catalog.select(F.col("path").alias("other"), F.lit(True).alias("known")), "other", "left")
    listed = lambda condition: F.array_sort(F.collect_set(F.when(condition, F.col("other"))))
    found = known.agg(listed(F.col("out")).alias("refs"), listed(~F.col("out")).alias("ref_by"), listed(F.col("known").isNull()).alias("dangling"))
    return row.crossJoin(found)  # one row each
