"""A Markdown report of a catalogue: small aggregates, rendered by the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.meta import strings_at
from ..functions.text import human_bytes
from .facets import facets, largest, summary

# Parts of column names that usually hold labels, and the list lengths of the report.
LABEL_PARTS = ["leiden", "label", "type", "annotation"]
LARGEST, LISTED, ITEMS = 25, 200, 12


def label_columns(meta: Column) -> Column:
    """Names among obs_columns that look like labels."""
    return F.filter(strings_at(meta, "obs_columns"), lambda c: F.exists(F.array(*map(F.lit, LABEL_PARTS)), lambda p: F.contains(F.lower(c), p)))


def _table(rows: DataFrame, heads: list[str]) -> str:
    """A Markdown table of a few rows; bars in values are escaped."""
    line = lambda values: "| " + " | ".join(values) + " |"
    body = [line("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in row) for row in rows.collect()]
    return "\n".join([line(heads), line("---" for _ in heads), *body])


def health(catalog: DataFrame, limit: int = LISTED) -> tuple[DataFrame, DataFrame]:
    """(broken links, failed files) in path order, at most `limit` of each."""
    broken = catalog.where("is_symlink and not symlink_ok").select("path", "symlink_target").orderBy("path").limit(limit)
    return broken, catalog.where("error is not null").select("path", "error").orderBy("path").limit(limit)


def matrices(catalog: DataFrame, k: int = LARGEST) -> DataFrame:
    """The largest data matrices with their shapes and label-like columns, lists cut to a few items."""
    rows = largest(catalog, "data_matrix", k)
    labels = F.array_join(F.slice(label_columns(F.col("meta")), 1, ITEMS), ", ")
    return rows.select("path", human_bytes(F.col("size_bytes")).alias("size"), "n_obs", "n_vars", labels.alias("labels"))


def render(catalog: DataFrame, title: str = "Catalogue") -> str:
    one = summary(catalog).first()
    counts = facets(catalog).where("facet = 'category'").orderBy(F.col("n").desc(), "value").select("value", "n")
    broken, failed = health(catalog)
    parts = [
        f"# {title}",
        f"{one.n_files} files, {one.total_bytes} bytes, {one.n_symlinks} links ({one.n_broken_symlinks} broken), {one.n_errors} errors.",
        "## Categories", _table(counts, ["category", "files"]),
        "## Largest matrices", _table(matrices(catalog), ["path", "size", "rows", "columns", "labels"]),
        "## Broken links", _table(broken, ["path", "target"]),
        "## Errors", _table(failed, ["path", "error"]),
        "## How to ask", "`python -m oxbow query STORE \"cat:data umap\"`, `python -m oxbow check ROOT STORE`",
    ]
    return "\n\n".join(parts) + "\n"
