"""Search over a catalogue: a search text becomes columns, and Catalyst does the rest.

Three dialects differ in what a prefixed word means (`sql`: the indexed search, `ui`: the ranked band, `page`: the static page).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.meta import flatten_json, strings_at
from ..functions.text import LOWER, UPPER, ascii_fold, basename, parent_of

PREFIXES = {
    "sql": {"cat", "type", "ext", "path", "dir", "obs", "obsm", "fig"},
    "ui": {"cat", "type", "ext", "path", "dir", "obs", "obsm"},
    "page": {"cat", "type", "ext", "dir", "obs"},
}
_ASCII_BLANKS = " \t\n\r\x0b\x0c"
PAGE_LIMIT = 500


@dataclass
class Search:
    """Free tokens and filter values by kind, folded; `dangling` has prefixes without a value."""

    free: list[str] = field(default_factory=list)
    filters: dict[str, list[str]] = field(default_factory=dict)
    dangling: list[str] = field(default_factory=list)

    @property
    def empty(self) -> bool:
        return not self.free and not self.filters


def terms(text: str, dialect: str = "sql") -> list[str]:
    """Words of a search text. Quotes keep blanks inside a word and are dropped; the page knows no quotes."""
    if dialect == "page":
        return text.split()
    out, word, quoted = [], "", False
    for char in text:
        if char == '"':
            quoted = not quoted
        elif not quoted and (char in _ASCII_BLANKS if dialect == "ui" else char.isspace()):
            out, word = out + [word] * bool(word), ""
        else:
            word += char
    return out + [word] * bool(word)


def parse(text: str, dialect: str = "sql") -> Search:
    fold = str.lower if dialect == "page" else lambda s: s.translate(str.maketrans(UPPER, LOWER))
    found = Search()
    for term in terms(text, dialect):
        kind, colon, value = term.partition(":")
        kind = kind.lower()
        if not colon or kind not in PREFIXES[dialect]:
            kind, value = "free", term
        elif not value.strip():
            found.dangling.append(kind)
            continue
        elif dialect == "ui" and kind not in ("cat", "type", "ext"):
            kind = "free"
        value = fold(value.strip() if dialect == "sql" else value)
        if kind == "free":
            if value and value not in found.free:
                found.free.append(value)
        else:
            own = found.filters.setdefault("cat" if kind == "type" else kind, [])
            if value not in own:
                own.append(value)
    return found


def haystack(dialect: str = "sql", figure_text: bool = False) -> Column:
    """What a free token is looked for in. Tags and meta are raw JSON text in `sql`, flattened in the others."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    if dialect == "sql":
        parts = ["path", "category", "ext", "extractor", "tags", "meta", *["figure_text"] * figure_text]
        tags = F.coalesce(F.to_json("tags"), F.lit(""))
        return ascii_fold(F.concat_ws(" ", *(tags if c == "tags" else empty(c) for c in parts)))
    text = [empty("path"), empty("category"), empty("ext"), empty("extractor"), F.array_join("tags", " "), flatten_json(F.col("meta"))]
    return F.lower(F.concat_ws("" if dialect == "page" else " ", *text))


def has(text: Column, token: str) -> Column:
    """Literal substring; LIKE would read %, _ and \\ as patterns."""
    return F.contains(text, F.lit(token))


def condition(
    search: Search, dialect: str = "sql", figure_text: bool = False, categories: str | None = None, stored: Iterable[str] = ()
) -> Column:
    """The predicate of a search. `stored` names columns at hand: with haystack and path_fold among them, `sql` and `ui` predicates
    are plain `contains` on those, which reach the Parquet scan. Tokens and kinds combine with AND, values of a kind with OR, except that category values
    combine with AND in `sql`, and so do the scoped substrings; `categories` ("or" or "and") overrides that."""
    fold = F.lower if dialect == "page" else ascii_fold
    path = F.col("path_fold") if "path_fold" in stored and dialect != "page" else fold(F.col("path"))
    hay = None
    if search.free and dialect == "sql" and "haystack" in stored:
        more = [ascii_fold(F.coalesce("figure_text", F.lit("")))] * figure_text
        hay = F.concat_ws(" ", "haystack", *more) if more else F.col("haystack")
    elif search.free:
        hay = haystack(dialect, figure_text)
    parts = [has(hay, token) for token in search.free]
    together = {"and": and_, "or": or_}[categories or ("and" if dialect == "sql" else "or")]
    scope = {
        "path": lambda: path,
        "dir": lambda: fold(parent_of(F.col("path"))) if dialect == "page" else path,
        "obs": lambda: F.lower(F.array_join(strings_at(F.col("meta"), "obs_columns"), " "))
        if dialect == "page"
        else ascii_fold(F.coalesce("meta", F.lit(""))),
        "obsm": lambda: ascii_fold(F.coalesce("meta", F.lit(""))),
        "fig": lambda: ascii_fold(F.coalesce("figure_text", F.lit(""))),
    }
    for kind, values in search.filters.items():
        if kind == "ext":
            parts.append(fold(F.col("ext")).isin([v for v in values if v]))
        elif kind == "cat":
            parts.append(reduce(together, (has(fold(F.col("category")), v) for v in values)))
        else:
            parts += [has(scope[kind](), v) for v in values]
    return F.coalesce(reduce(and_, parts, F.lit(True)), F.lit(False))


def search(catalog: DataFrame, text: str, dialect: str = "sql", figure_text: bool = False, categories: str | None = None) -> DataFrame:
    """All files that match, unordered; sort and limit them with `page`. An empty search matches all; one of bare prefixes
    matches none in `sql` and all elsewhere."""
    parsed = parse(text, dialect)
    files = catalog.where(~F.col("is_dir")) if "is_dir" in catalog.columns else catalog
    if parsed.empty:
        return files.limit(0) if dialect == "sql" and text.strip() else files
    return files.where(condition(parsed, dialect, figure_text, categories, catalog.columns))


def search_ids(catalog: DataFrame, tokens: list[str], exts: list[str] = (), cats: list[str] = (), figure_text: bool = False) -> DataFrame:
    """(path, via_figure_text) of files that hold every token; without tokens none. The flag tells matches whose tokens are all
    in the figure text too."""
    wanted = Search([t for t in tokens if t], {k: list(v) for k, v in (("ext", exts), ("cat", cats)) if v})
    wanted.free = [t.translate(str.maketrans(UPPER, LOWER)) for t in wanted.free]
    if not wanted.free:
        return catalog.limit(0).select("path", F.lit(False).alias("via_figure_text"))
    own = ascii_fold(F.coalesce("figure_text", F.lit("")))
    via = reduce(and_, (has(own, t) for t in wanted.free)) if figure_text else F.lit(False)
    files = catalog.where(~F.col("is_dir")) if "is_dir" in catalog.columns else catalog
    return files.where(condition(wanted, "sql", figure_text, "or", catalog.columns)).select("path", via.alias("via_figure_text"))


def filter_files(
    catalog: DataFrame, path=None, category=None, ext=None, extractor=None, has_obs=None, has_obsm=None, broken=False, errors=False
) -> DataFrame:
    """The command line's filters, all of which must hold: path substring with case, exact category, extension and extractor,
    a name among obs_columns, a key of obsm, broken links, rows with an error."""
    meta = F.col("meta")
    parts = [F.contains("path", F.lit(path))] if path else []
    parts += [F.col(c) == v for c, v in (("category", category), ("ext", ext), ("extractor", extractor)) if v is not None]
    if has_obs:
        parts.append(F.array_contains(strings_at(meta, "obs_columns"), has_obs))
    if has_obsm:
        parts.append(F.array_contains(F.json_object_keys(F.get_json_object(meta, "$.obsm")), has_obsm))
    parts += [F.col("is_symlink") & ~F.col("symlink_ok")] * broken + [F.col("error").isNotNull()] * errors
    return catalog.where(F.coalesce(reduce(and_, parts, F.lit(True)), F.lit(False)))


def active(catalog: DataFrame, categories: list[str]) -> DataFrame:
    """Rows of the categories that are switched on; rows without one count as other."""
    return catalog.where(F.coalesce(F.when(F.col("category") != "", F.col("category")), F.lit("other")).isin(categories))


# Fixed value: rows of a full listing.
LISTING_LIMIT = 5_000_000


def listing(catalog: DataFrame, most: int = LISTING_LIMIT) -> DataFrame:
    """All rows in path order, up to a limit. A sort by ranges, not a top-k: the limit is as large as most catalogues."""
    return catalog.orderBy("path").limit(most)


SORTS = {
    "name": ["name"],
    "newest": ["-mtime"],
    "oldest": ["mtime"],
    "largest": ["-size_bytes"],
    "smallest": ["size_bytes"],
    "type": ["category", "name"],
    "path": [],
}


def order(sort: str = "path", collation: str | None = None) -> list[Column]:
    """Sort columns, with the path as the last resort. Missing times count as the epoch; `collation` ("en") orders names by
    language instead of by byte."""
    out = []
    for key in SORTS[sort]:
        column = F.col(key.lstrip("-"))
        if key.endswith("mtime"):
            column = F.coalesce(column, F.timestamp_seconds(F.lit(0)))
        elif collation and key in ("name", "category"):
            column = F.collate(column, collation)
        out.append(column.desc() if key.startswith("-") else column.asc())
    return [*out, F.col("path").asc()]


def page(catalog: DataFrame, sort: str = "path", limit: int = 100, offset: int = 0, most: int = PAGE_LIMIT) -> DataFrame:
    """One page of a listing: a bounded top-k, not a full sort of the catalogue."""
    return catalog.orderBy(*order(sort)).offset(max(0, offset)).limit(max(0, min(limit, most)))


def with_name(catalog: DataFrame) -> DataFrame:
    return catalog if "name" in catalog.columns else catalog.withColumn("name", basename(F.col("path")))
