"""Catalogue rows from relational tables: each table's rows stand for files. Every adapter has a DuckDB twin for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["path", "category", "ext", "extractor", "size_bytes", "mtime", "meta"]
_DAY0 = "timestamp'2024-01-01 00:00:00'"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _catalog(
    rows: DataFrame, path: str, category: str, ext: str, extractor: str, size: str, seconds: str, meta: str, time: str | None = None
) -> DataFrame:
    return rows.select(
        F.expr(path).alias("path"),
        F.expr(category).alias("category"),
        F.expr(ext).alias("ext"),
        F.lit(extractor).alias("extractor"),
        F.expr(size).cast("long").alias("size_bytes"),
        F.expr(time or f"{_DAY0} + make_dt_interval(0, 0, 0, {seconds})").alias("mtime"),
        F.expr(meta).alias("meta"),
        F.array().cast("array<string>").alias("tags"),
        F.lit(None).cast("string").alias("figure_text"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source/lang/doc_<id>.txt, the language as category and the text as metadata."""
    rows = read(spark, sf_dir, "documents")
    return _catalog(rows, "concat(source, '/', lang, '/doc_', doc_id, '.txt')", "lang", "'txt'", "doc", "n_chars", "doc_id", "text")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """brand/type/part_<key>, the type as category and a bucket of the size as extension."""
    rows = read(spark, sf_dir, "part")
    ext = "element_at(array('csv', 'png', 'md', 'npy', ''), cast(p_size % 5 + 1 as int))"
    meta = "concat('{\"brand\":\"', p_brand, '\"}')"
    return _catalog(rows, "concat(p_brand, '/', p_type, '/part_', p_partkey)", "p_type", ext, "generic", "p_size", "p_partkey", meta)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type/user_<id>/ev_<id> with the properties as metadata and the event's own time."""
    rows = read(spark, sf_dir, "events")
    path = "concat(event_type, '/user_', user_id, '/ev_', event_id)"
    return _catalog(rows, path, "event_type", "''", "generic", "event_id", "0", "props", time="ts")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """host/path of the address, without query and fragment; the references of the page as a document's."""
    rows = read(spark, sf_dir, "pages")
    path = r"regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', '')"
    refs = r"""to_json(named_struct('outbound_refs', regexp_extract_all(html, 'href="([^"]*)"', 1)))"""
    return _catalog(rows, path, r"regexp_extract(url, '://([^./]+)', 1)", "''", "doc", "length(html)", "page_id", refs)


_ZERO = "TIMESTAMP '2024-01-01 00:00:00'"
SQL = {
    "documents": f"""(SELECT source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, lang AS category, 'txt' AS ext, 'doc' AS extractor,
        n_chars AS size_bytes, {_ZERO} + to_seconds(doc_id) AS mtime, text AS meta FROM documents)""",
    "part": f"""(SELECT p_brand || '/' || p_type || '/part_' || p_partkey AS path, p_type AS category,
        list_extract(['csv', 'png', 'md', 'npy', ''], CAST(p_size % 5 + 1 AS INT)) AS ext, 'generic' AS extractor,
        CAST(p_size AS BIGINT) AS size_bytes, {_ZERO} + to_seconds(p_partkey) AS mtime, '{{"brand":"' || p_brand || '"}}' AS meta FROM part)""",
    "events": """(SELECT event_type || '/user_' || user_id || '/ev_' || event_id AS path, event_type AS category, '' AS ext,
        'generic' AS extractor, event_id AS size_bytes, ts AS mtime, props AS meta FROM events)""",
    "pages": rf"""(SELECT regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', '') AS path,
        regexp_extract(url, '://([^./]+)', 1) AS category, '' AS ext, 'doc' AS extractor, CAST(length(html) AS BIGINT) AS size_bytes,
        {_ZERO} + to_seconds(page_id) AS mtime, html FROM pages)""",
}
