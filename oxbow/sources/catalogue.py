"""The catalogue as a table: building it from a tree, keeping snapshots, reading and writing its interchange files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import meta as M
from ..functions import text as X
from ..operators.delta import reusable
from ..operators.search import haystack
from .extract import describe
from .files import Folder
from .manifest import entry_texts, write_document
from .store import Store as Store
from .tree import walk

ENTRY = (
    "path string, category string, ext string, size_bytes long, mtime_iso string, is_symlink boolean, symlink_target string, "
    "symlink_ok boolean, extractor string, tags array<string>, meta string, error string"
)
COLUMNS = [
    "path", "name", "parent", "depth", "path_key", "path_fold", "category", "ext", "size_bytes", "mtime", "is_symlink", "symlink_target",
    "symlink_ok", "extractor", "tags", "meta", "figure_text", "error", "n_obs", "n_vars", "haystack",
]


def derive(entries: DataFrame, tags: list[tuple[str, str]] = tuple(X.TAGS), columns: bool = True, figure_text: bool = True) -> DataFrame:
    """Catalogue rows from entries: names, keys and folded text are stored, so that searches reach the Parquet scan.

    Figure text moves from `meta` to a column of its own. Without `columns` long column lists leave `meta`; their counts stay.
    """
    path, meta = F.col("path"), F.coalesce("meta", F.lit("{}"))
    n_obs, n_vars = M.shape(meta)
    left = M.without_keys(meta, [*M.FIGURE_KEYS, *([] if columns else ["columns"])])
    base = entries.withColumn("__figure", M.figure_text(meta) if figure_text else F.lit(None).cast("string"))
    return base.withColumns(
        {
            "name": X.basename(path), "parent": X.parent_of(path), "depth": X.depth_of(path), "path_key": X.norm_key(path),
            "path_fold": X.ascii_fold(path), "tags": X.tags_for(path, list(tags)), "n_obs": n_obs, "n_vars": n_vars,
            "figure_text": F.col("__figure"), "meta": left,
        }
    ).withColumn("haystack", haystack("sql")).select(*COLUMNS)


def build(spark: SparkSession, root: str, prior: DataFrame | None = None, reference: float | None = None, tags=tuple(X.TAGS), **options) -> DataFrame:
    """The catalogue of a tree. Files that `prior` describes and that have not changed since are not opened again."""
    files = walk(spark, root, **{k: v for k, v in options.items() if k not in ("columns", "figure_text")})
    toggles = {k: v for k, v in options.items() if k in ("columns", "figure_text")}
    if prior is None:
        return derive(describe(files, root), tags, **toggles)
    marked = reusable(files, prior, None if reference is None else F.lit(reference))
    kept = marked.where("reuse").select(*files.columns)
    old = prior.select("path", "extractor", "meta", "figure_text", "n_obs", "n_vars")
    known = kept.join(old, "path")
    fresh = derive(describe(marked.where("not reuse").drop("reuse"), root), tags, **toggles)
    again = derive(known.drop("figure_text", "n_obs", "n_vars"), tags, **toggles).drop("figure_text", "n_obs", "n_vars")
    return fresh.unionByName(again.join(old.select("path", "figure_text", "n_obs", "n_vars"), "path").select(*COLUMNS))


def entries_of(catalog: DataFrame) -> DataFrame:
    """Interchange entries of catalogue rows, `meta` as JSON text."""
    iso = X.iso_utc(F.unix_timestamp("mtime"))
    return catalog.select(*(iso.alias(c) if c == "mtime_iso" else F.col(c) for c in (p.split()[0] for p in ENTRY.split(", "))))


def _fields() -> list:
    names = [p.split()[0] for p in ENTRY.split(", ")]
    meta = F.coalesce(F.get_json_object("value", "$.meta"), F.lit("{}"))
    return [meta.alias(c) if c == "meta" else F.col(f"e.{c}") for c in names]


def read_jsonl(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Entries of a line-per-entry file, `meta` kept as text. Bad lines are skipped, or with `strict` end the read."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = lines.select("value", F.from_json("value", ENTRY, {"mode": "FAILFAST" if strict else "PERMISSIVE"}).alias("e"))
    found = parsed if strict else parsed.where("e.path is not null")
    return found.select(*_fields())


def entry_lines(catalog: DataFrame) -> DataFrame:
    """(value): entries in path order as JSON texts; range-sorted, so the whole is ordered without one task holding it."""
    entries = entries_of(catalog)
    whole = F.to_json(F.struct(*(c for c in entries.columns if c != "meta")))
    line = F.concat(F.regexp_replace(whole, r"\}$", ""), F.lit(',"meta":'), F.coalesce("meta", F.lit("{}")), F.lit("}"))
    return entries.orderBy("path").select(line.alias("value"))


def write_jsonl(catalog: DataFrame, path: str) -> None:
    """Entries in path order, a line each."""
    entry_lines(catalog).write.mode("overwrite").text(path)


def read_index(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Entries of a single-document manifest (see `manifest`). A bad entry ends the read, or without `strict` is left out."""
    values = entry_texts(spark, path)
    parsed = values.select("value", F.from_json("value", ENTRY, {"mode": "FAILFAST" if strict else "PERMISSIVE"}).alias("e"))
    if strict:
        nameless = F.raise_error(F.concat(F.lit("an entry has no path: "), F.substring("value", 1, 200)))
        parsed = parsed.withColumn("e", F.when(F.col("e.path").isNull(), nameless).otherwise(F.col("e")))
    else:
        parsed = parsed.where("e.path is not null")
    return parsed.select(*_fields())


# Items and characters that a lean row keeps, and metadata lists that it cuts.
LEAN_ITEMS, LEAN_PARAGRAPH = 48, 600
LONG_LISTS = (
    "columns", "defs", "classes", "imports", "uns_keys", "layers", "obsp", "varm", "members", "datasets", "outbound_refs", "top_level_keys",
)


def lean(catalog: DataFrame, most: int = LEAN_ITEMS, keys: tuple[str, ...] = LONG_LISTS, paragraph: int = LEAN_PARAGRAPH) -> DataFrame:
    """(path, <key>, n_<key>_total, first_paragraph): long lists of the metadata cut to `most` items, with how many there are where some
    were cut, and a paragraph cut to `paragraph` characters and an ellipsis. Figure labels are left out."""
    lists = {k: M.strings_at(F.col("meta"), k) for k in keys}
    text = F.get_json_object("meta", "$.first_paragraph")
    return catalog.select(
        "path",
        *(F.slice(v, 1, most).alias(k) for k, v in lists.items()),
        *(F.when(F.size(v) > most, F.size(v)).alias(f"n_{k}_total") for k, v in lists.items()),
        F.when(F.char_length(text) > paragraph, F.concat(F.substring(text, 1, paragraph), F.lit("…"))).otherwise(text).alias("first_paragraph"),
    )


def header(catalog: DataFrame, digest: str) -> dict:
    """What a manifest says before its entries."""
    from ..operators.facets import summary, summary_maps

    counts = summary(catalog).first().asDict() | summary_maps(catalog).first().asDict()
    return {"schema_version": "1.0", "content_digest": digest, "summary": counts}


def write_index(catalog: DataFrame, digest: str, path: str) -> None:
    """A manifest as one document, which `read_index` reads again."""
    write_document(entry_lines(catalog), header(catalog, digest), path)


def peek(spark: SparkSession, path: str, most: int = 1 << 18) -> str | None:
    """The content digest of a manifest from its first bytes, without reading its entries; null where they do not tell it."""
    folder, _, name = path.rpartition("/")
    found = re.search(r'"content_digest"\s*:\s*"([^"]*)"', Folder(spark, folder or ".").start(name, most))
    return found[1] if found else None
