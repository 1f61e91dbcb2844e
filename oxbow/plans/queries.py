"""Registered catalogue queries over the relational adapters, each with its DuckDB twin."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import meta as M
from ..functions import text as X
from ..operators import delta, digest, expand, facets, journal, lineage, rank, search, tree, upkeep
from ..checkpoint import cut, shared_folder
from ..sources import catalogue, extract
from ..sources import tables as T
from ..sources import tree as sources_tree
from ..sources.catalogue import lean
from ..streaming import live, timers

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        _QUERIES[query.__name__] = query
        if sql is not None:
            _SQL[query.__name__] = sql
        return query

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


DOCS, PART, EVENTS, PAGES = (T.SQL[t] for t in ("documents", "part", "events", "pages"))
FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
HAY = FOLD.format("path || ' ' || category || ' ' || ext || ' ' || extractor || ' [] ' || meta")
NAME = "list_extract(string_split(path, '/'), -1)"
PARENT = "CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END"


# Search and filters


@register(f"SELECT path, category, size_bytes FROM {DOCS} WHERE contains({HAY}, 'then')")
def search_free_token(spark, sf_dir):
    return search.search(T.documents(spark, sf_dir), "THEN").select("path", "category", "size_bytes")


@register(f"SELECT path FROM {DOCS} WHERE contains({HAY}, 'src1') AND contains({HAY}, 'the') AND contains({HAY}, 'ing')")
def search_multi_token(spark, sf_dir):
    return search.search(T.documents(spark, sf_dir), "src1 the ing").select("path")


@register(f"SELECT path FROM {DOCS} WHERE contains({HAY}, 'of the') AND contains(category, 'en')")
def search_phrase(spark, sf_dir):
    return search.search(T.documents(spark, sf_dir), '"of the" cat:en').select("path")


@register(f"SELECT path FROM {DOCS} WHERE contains({HAY}, '%') AND NOT contains({HAY}, '_x_')")
def search_literal_wildcards(spark, sf_dir):
    docs = T.documents(spark, sf_dir)
    return search.search(docs, "%").join(search.search(docs, "_x_").select("path"), "path", "left_anti").select("path")


@register(f"SELECT count(*) AS n_none, 0 AS n_bare, (SELECT count(*) FROM {DOCS}) AS n_all FROM {DOCS} WHERE contains({HAY}, 'zzzzzz')")
def search_empty_and_bare(spark, sf_dir):
    docs = T.documents(spark, sf_dir)
    count = lambda text, name: search.search(docs, text).agg(F.count(F.lit(1)).alias(name))
    bare = count("ext:", "n_bare").select(F.col("n_bare").cast("int"))
    return count("zzzzzz", "n_none").join(bare).join(count("", "n_all"))  # three single rows


@register(f"SELECT path, ext FROM {PART} WHERE ext IN ('csv', 'png')")
def filter_ext_union(spark, sf_dir):
    return search.search(T.parts(spark, sf_dir), "ext:CSV ext:png").select("path", "ext")


@register(f"SELECT path FROM {PART} WHERE contains({FOLD.format('category')}, 'promo') OR contains({FOLD.format('category')}, 'small')")
def filter_cat_or(spark, sf_dir):
    return search.search(T.parts(spark, sf_dir), "cat:promo type:small", "ui").select("path")


@register(f"SELECT path FROM {PART} WHERE contains({FOLD.format('category')}, 'promo') AND contains({FOLD.format('category')}, 'o')")
def filter_cat_and(spark, sf_dir):
    return search.search(T.parts(spark, sf_dir), "cat:promo cat:o").select("path")


@register(f"SELECT path FROM {PART} WHERE contains({FOLD.format('path')}, 'brand#1') AND contains({FOLD.format('path')}, 'part_7')")
def filter_path_scope(spark, sf_dir):
    return search.search(T.parts(spark, sf_dir), "path:Brand#1 dir:part_7").select("path")


@register(f"SELECT path FROM {PART} WHERE contains(lower({PARENT}), 'brand#2')")
def filter_dir_scope_page(spark, sf_dir):
    return search.search(T.parts(spark, sf_dir), "dir:brand#2", "page").select("path")


@register(f"SELECT path FROM {EVENTS} WHERE contains({FOLD.format('meta')}, '{chr(34)}k')")
def meta_key_filter(spark, sf_dir):
    return T.events(spark, sf_dir).where(search.condition(search.Search([], {"obs": ['"k']}))).select("path")


@register(f"SELECT path, json_exists(meta, '$.k') AS has_k, json_exists(meta, '$.absent') AS has_absent FROM {EVENTS}")
def meta_has_key(spark, sf_dir):
    meta = F.col("meta")
    return T.events(spark, sf_dir).select("path", M.has_key(meta, "k").alias("has_k"), M.has_key(meta, "absent").alias("has_absent"))


@register(
    f"""SELECT path, CASE WHEN json_type(meta, '$.k') IN ('BIGINT', 'UBIGINT') THEN CAST(json_extract_string(meta, '$.k') AS BIGINT) END AS k,
    CAST(-1 AS BIGINT) AS from_float FROM {EVENTS}"""
)
def meta_int_only(spark, sf_dir):
    floats = F.concat(F.lit('{"k":1.5,"s":"'), F.col("size_bytes").cast("string"), F.lit('"}'))
    return T.events(spark, sf_dir).select("path", M.int_at(F.col("meta"), "k").alias("k"), F.coalesce(M.int_at(floats, "k"), F.lit(-1).cast("long")).alias("from_float"))


@register(
    f"""SELECT path, CASE WHEN size_bytes % 2 = 0 THEN size_bytes ELSE size_bytes + 1 END AS n_obs, CAST(7 AS BIGINT) AS n_vars FROM {EVENTS}"""
)
def shape_denormalised(spark, sf_dir):
    n = F.col("size_bytes").cast("string")
    even = F.concat(F.lit('{"n_obs":'), n, F.lit(',"row_count":3,"n_vars":7}'))
    odd = F.concat(F.lit('{"n_obs":null,"num_rows":'), (F.col("size_bytes") + 1).cast("string"), F.lit(',"n_columns":7}'))
    meta = F.when(F.col("size_bytes") % 2 == 0, even).otherwise(odd)
    n_obs, n_vars = M.shape(meta)
    return T.events(spark, sf_dir).select("path", n_obs.alias("n_obs"), n_vars.alias("n_vars"))


@register(f"SELECT path FROM {EVENTS} WHERE contains(path, 'user_1') AND category = 'click' AND json_exists(meta, '$.k')")
def cli_query_conjunction(spark, sf_dir):
    events = search.filter_files(T.events(spark, sf_dir), path="user_1", category="click", extractor="generic")
    return events.where(M.has_key(F.col("meta"), "k")).select("path")


@register(
    f"""SELECT path, size_bytes % 3 = 0 AS broken, size_bytes % 4 = 0 AS failed FROM {EVENTS} WHERE size_bytes % 3 = 0 OR size_bytes % 4 = 0"""
)
def filter_broken_and_errors(spark, sf_dir):
    n = F.col("size_bytes")
    rows = T.events(spark, sf_dir).withColumns(
        {"is_symlink": n % 3 == 0, "symlink_ok": F.when(n % 3 == 0, F.lit(False)), "error": F.when(n % 4 == 0, F.lit("E: x"))}
    )
    broken = search.filter_files(rows, broken=True).select("path", F.lit(True).alias("broken"))
    failed = search.filter_files(rows, errors=True).select("path", F.lit(True).alias("failed"))
    both = broken.join(failed, "path", "full_outer")
    return both.select("path", F.coalesce("broken", F.lit(False)).alias("broken"), F.coalesce("failed", F.lit(False)).alias("failed"))


@register(f"SELECT path, contains({FOLD.format('category')}, 'o') AS via_figure_text FROM {PART} WHERE contains({HAY}, 'o') AND ext IN ('png')")
def search_ids_figure_text(spark, sf_dir):
    return search.search_ids(T.parts(spark, sf_dir).withColumn("figure_text", F.col("category")), ["O"], ["png"], (), True)


@register(f"SELECT path, 'x' || path AS shown FROM {PART} WHERE contains({FOLD.format('path')}, 'promo') AND contains({HAY}, 'brand#3')")
def search_stored_columns(spark, sf_dir):
    parts = T.parts(spark, sf_dir).withColumns({"path_fold": X.ascii_fold(F.col("path")), "haystack": search.haystack()})
    found = search.search(parts, "path:PROMO Brand#3")
    return found.select("path", F.concat(F.lit("x"), "path").alias("shown"))


@register(
    f"""SELECT path, CAST(least(len(r), 2) AS INTEGER) AS n_kept, CAST(CASE WHEN len(r) > 2 THEN len(r) END AS INTEGER) AS n_total
    FROM (SELECT path, regexp_extract_all(html, 'href="([^"]*)"', 1) AS r FROM {PAGES})"""
)
def lean_projection(spark, sf_dir):
    rows = lean(T.pages(spark, sf_dir), 2, ("outbound_refs",))
    return rows.select("path", F.size("outbound_refs").alias("n_kept"), F.col("n_outbound_refs_total").alias("n_total"))


@register(
    r"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'a/c' WHEN event_id % 3 = 1 THEN '../x' ELSE 'b' END AS collapsed,
    regexp_full_match('d/f' || event_id || '.csv', '(?s)d/f[12].*\.cs.') AS globbed FROM events"""
)
def path_collapse_and_glob(spark, sf_dir):
    k = F.col("event_id")
    raw = F.when(k % 3 == 0, "a/./b/../c").when(k % 3 == 1, "a/../../x").otherwise(".//b/")
    name = F.concat(F.lit("d/f"), k.cast("string"), F.lit(".csv"))
    rows = T.read(spark, sf_dir, "events")
    return rows.select("event_id", lineage.collapse(raw).alias("collapsed"), name.rlike(X.glob_to_regex("d/f[12]*.cs?")).alias("globbed"))


# Ranking

_TIER = "CASE WHEN contains({n}, '1') AND contains({n}, '2') THEN 1 WHEN contains({p}, '1') AND contains({p}, '2') THEN 2 END".format(
    n=FOLD.format(NAME), p=FOLD.format("path")
)


@register(f"SELECT path, CAST({_TIER} AS INTEGER) AS tier FROM {DOCS} WHERE {_TIER} IS NOT NULL")
def tier_of(spark, sf_dir):
    rows = search.with_name(T.documents(spark, sf_dir))
    tier = rank.tier_of(X.ascii_fold(F.col("name")), X.ascii_fold(F.col("path")), ["1", "2"])
    return rows.select("path", tier.alias("tier")).where("tier is not null")


@register(
    f"""SELECT path, starts_with(name, '1') OR regexp_matches(name, '[/._0-9-]1') AS flag FROM (SELECT path, {NAME} AS name FROM {DOCS})"""
)
def boundary_flag(spark, sf_dir):
    rows = search.with_name(T.documents(spark, sf_dir))
    return rows.select("path", rank.boundary(F.col("name"), ["1"]).alias("flag"))


def _band_sql(source: str, tokens: list[str], where: str, sort: str, k: int = 20) -> str:
    name, path = FOLD.format("name"), FOLD.format("path")
    held = " + ".join(f"CAST(contains({path}, '{t}') AS INT)" for t in tokens)
    all_in = lambda c: " AND ".join(f"contains({c}, '{t}')" for t in tokens)
    tier = f"CASE WHEN {all_in(name)} THEN 1 WHEN {all_in(path)} THEN 2 END"
    partial = " AND ".join(f"(NOT contains({path}, '{t}') OR contains({name}, '{t}'))" for t in tokens)
    start = lambda t: f"(starts_with({name}, '{t}') OR regexp_matches({name}, '[/._0-9-]{t}'))"
    bound = " OR ".join(f"(contains({path}, '{t}') AND {start(t)})" for t in tokens)
    return f"""
    WITH files AS (SELECT *, {NAME} AS name FROM {source} WHERE {where}),
    scored AS (SELECT path, name, category, size_bytes, mtime, {held} AS matched,
      coalesce({tier}, CASE WHEN {partial} THEN 1 ELSE 2 END) AS tier, ({bound}) AS boundary FROM files),
    best AS (SELECT * FROM scored WHERE matched > 0 ORDER BY matched DESC, tier, boundary DESC, {sort}path LIMIT {k})
    SELECT CAST(row_number() OVER (ORDER BY matched DESC, tier, boundary DESC, {sort}path) AS INTEGER) AS rank, path,
      CAST(tier AS INTEGER) AS tier, CAST(matched AS INTEGER) AS matched, boundary FROM best"""


_SORT_SQL = {"name": "name, ", "newest": "mtime DESC, ", "oldest": "mtime, ", "largest": "size_bytes DESC, ", "smallest": "size_bytes, ", "type": "category, name, "}


def _band(sort: str) -> None:
    def query(spark, sf_dir):
        found = rank.top_hits(T.documents(spark, sf_dir), search.parse("cat:en 1", "ui"), sort=sort)
        return found.select("rank", "path", "tier", "matched", "boundary")

    query.__name__ = f"band_top20_{sort}" if sort != "newest" else "band_top20"
    register(_band_sql(DOCS, ["1"], "contains(category, 'en')", _SORT_SQL[sort]))(query)


for _sort in _SORT_SQL:
    _band(_sort)


@register(_band_sql(DOCS, ["src1/", "doc_11"], "true", "size_bytes DESC, "))
def band_backfill(spark, sf_dir):
    found = rank.top_hits(T.documents(spark, sf_dir), search.parse("src1/ doc_11", "ui"), sort="largest")
    return found.select("rank", "path", "tier", "matched", "boundary")


_DIRS = "(SELECT DISTINCT array_to_string(list_slice(p, 1, n), '/') AS path FROM (SELECT string_split(path, '/') AS p FROM {0}) s, range(1, len(p)) r(n))"


_ACCENTED = f"(SELECT * REPLACE (replace(path, 'doc_1', CASE WHEN size_bytes % 2 = 0 THEN 'Caf' || chr(233) || '_1' ELSE 'Caf' || 'e' || chr(769) || '_1' END) AS path) FROM {DOCS})"


@register(
    f"""WITH files AS (SELECT path, {NAME} AS name, size_bytes, replace({FOLD.format(NAME)}, chr(233), 'e' || chr(769)) AS folded FROM {_ACCENTED}),
    best AS (SELECT * FROM files WHERE contains(folded, 'cafe' || chr(769)) ORDER BY size_bytes DESC, path LIMIT 20)
    SELECT CAST(row_number() OVER (ORDER BY size_bytes DESC, path) AS INTEGER) AS rank, path, 1 AS tier, 1 AS matched, true AS boundary FROM best"""
)
def band_top20_accents(spark, sf_dir):
    """Composed and decomposed names, found by a composed word."""
    name = F.when(F.col("size_bytes") % 2 == 0, "Caf\u00e9_1").otherwise("Cafe\u0301_1")
    docs = T.documents(spark, sf_dir).withColumn("path", F.replace("path", F.lit("doc_1"), name))
    found = rank.top_hits(docs, search.parse("caf\u00e9", "ui"), sort="largest")
    return found.select("rank", "path", "tier", "matched", "boundary")


@register(
    f"""WITH hits AS (SELECT path, {NAME} AS name FROM {_DIRS.format(PART)} WHERE contains({FOLD.format(NAME)}, 'st'))
    SELECT path, CAST(row_number() OVER (ORDER BY length(name), path) AS INTEGER) AS rank FROM hits ORDER BY length(name), path LIMIT 3"""
)
def folder_hits(spark, sf_dir):
    return rank.folder_hits(tree.directories(T.parts(spark, sf_dir)), ["st"])


@register(
    f"""SELECT path FROM {DOCS} WHERE category = 'de' AND (contains({FOLD.format("path")}, 'src1') OR contains({FOLD.format("meta")}, 'ung'))"""
)
def tree_rows_with_tier3(spark, sf_dir):
    docs = T.documents(spark, sf_dir)
    elsewhere = search.search_ids(docs, ["ung"])
    return rank.tree_rows(docs, search.parse("cat:de src1", "ui"), elsewhere).select("path")


@register(
    f"""WITH hits AS (SELECT path, length({NAME}) AS l FROM {_DIRS.format(DOCS)} WHERE contains({FOLD.format(NAME)}, 'src1') ORDER BY l, path LIMIT 3),
    f AS (SELECT path, size_bytes, CASE WHEN contains({FOLD.format("path")}, 'src1') THEN 2 WHEN size_bytes % 5 = 0 THEN 3 END AS tier FROM {DOCS} WHERE path IS NOT NULL),
    u AS (SELECT path, true AS is_folder, 0 AS tier, row_number() OVER (ORDER BY l, path) AS pos FROM hits
      UNION ALL SELECT path, false, tier, row_number() OVER (ORDER BY tier, size_bytes DESC, path) FROM f WHERE tier IS NOT NULL)
    SELECT CAST(row_number() OVER (ORDER BY is_folder DESC, pos) AS INTEGER) AS rank, path, is_folder, CAST(tier AS INTEGER) AS tier FROM u
    QUALIFY row_number() OVER (ORDER BY is_folder DESC, pos) <= 250"""
)
def band_folders_and_tiers(spark, sf_dir):
    """A band of 250 with folders on top, then files whose path holds the word, then files that were found elsewhere."""
    docs = T.documents(spark, sf_dir)
    elsewhere = docs.where("size_bytes % 5 = 0").select("path")
    found = rank.top_hits(docs, search.parse("src1", "ui"), tree.directories(docs), elsewhere, "largest", 250)
    return found.select("rank", "path", "is_folder", F.col("tier").cast("int").alias("tier"))


# Pages, children, counts


@register(
    f"""SELECT path, size_bytes, CAST(row_number() OVER (ORDER BY size_bytes DESC, path) AS INTEGER) AS pos
    FROM (SELECT * FROM {DOCS} ORDER BY size_bytes DESC, path LIMIT 25 OFFSET 10)"""
)
def page_sorted(spark, sf_dir):
    rows = search.page(T.documents(spark, sf_dir), "largest", 25, 10)
    return rows.select("path", "size_bytes", F.row_number().over(Window.orderBy(F.col("size_bytes").desc(), "path")).alias("pos"))


@register(f"SELECT count(*) AS total FROM {DOCS} WHERE contains({HAY}, 'then')")
def search_total(spark, sf_dir):
    return search.search(T.documents(spark, sf_dir), "then").agg(F.count(F.lit(1)).alias("total"))


_TREE = f"""(SELECT path, {NAME} AS name, {PARENT} AS parent, false AS is_dir FROM {{0}}
  UNION ALL SELECT path, {NAME}, {PARENT}, true FROM {_DIRS})"""


@register(
    f"""SELECT path, name, is_dir FROM {_TREE.format(PART)} WHERE parent = 'Brand#11' ORDER BY is_dir DESC, lower(name), path LIMIT 500"""
)
def list_children(spark, sf_dir):
    return tree.children(tree.with_directories(T.parts(spark, sf_dir)), "Brand#11").select("path", "name", "is_dir")


@register(
    f"""WITH t AS {_TREE.format(PART)} SELECT d.path, count(c.path) AS child_count FROM t d LEFT JOIN t c ON c.parent = d.path
    WHERE d.is_dir GROUP BY d.path"""
)
def count_children(spark, sf_dir):
    return tree.child_counts(tree.with_directories(T.parts(spark, sf_dir)))


@register(
    f"""WITH t AS {_TREE.format(PART)} SELECT c.path, c.is_dir, d.path IS NOT NULL AS has_parent
    FROM t c LEFT JOIN (SELECT path FROM t WHERE is_dir) d ON d.path = c.parent"""
)
def parent_link(spark, sf_dir):
    return tree.parent_links(tree.with_directories(T.parts(spark, sf_dir))).select("path", "is_dir", "has_parent")


@register(f"SELECT path, {PARENT} AS parent, {NAME} AS name, CAST(len(string_split(path, '/')) - 1 AS INTEGER) AS depth FROM {_DIRS.format(PAGES)} WHERE path NOT IN (SELECT path FROM {PAGES})")
def dir_synthesis(spark, sf_dir):
    return tree.directories(T.pages(spark, sf_dir))


def _rollup_sql(source: str) -> str:
    return f"""SELECT dir, count(*) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS total_bytes,
    strftime(max(mtime), '%Y-%m-%dT%H:%M:%SZ') AS newest, strftime(min(mtime), '%Y-%m-%dT%H:%M:%SZ') AS oldest
    FROM (SELECT CASE WHEN n = 0 THEN '' ELSE array_to_string(list_slice(p, 1, n), '/') END AS dir, size_bytes, mtime
      FROM (SELECT string_split(path, '/') AS p, size_bytes, mtime FROM {source}) s, range(0, len(p)) r(n)) GROUP BY dir"""


def _shown(rows: DataFrame) -> DataFrame:
    iso = lambda c: X.iso_utc(F.unix_timestamp(c)).alias(c)
    return rows.select("dir", "n_files", "total_bytes", iso("newest"), iso("oldest"))


@register(_rollup_sql(PART))
def tree_rollup(spark, sf_dir):
    return _shown(tree.rollup(T.parts(spark, sf_dir)))


@register(_rollup_sql(EVENTS))
def tree_rollup_events(spark, sf_dir):
    return _shown(tree.rollup(T.events(spark, sf_dir)))


@register(f"SELECT dir, n_files FROM ({_rollup_sql(PAGES)})")
def dir_totals(spark, sf_dir):
    return tree.rollup(T.pages(spark, sf_dir)).select("dir", "n_files")


@register(f"SELECT path FROM {PART} WHERE path = 'Brand#1' OR starts_with(path, 'Brand#1/') OR starts_with(path, 'Brand#13/')")
def subtree_scope(spark, sf_dir):
    parts = T.parts(spark, sf_dir)
    return tree.subtree(parts, "Brand#1").unionByName(tree.subtree(parts, "Brand#13")).select("path")


@register(
    f"""WITH f AS (SELECT string_split(path, '/') AS p FROM {PART}), d AS (SELECT DISTINCT list_slice(p, 1, n) AS p FROM f, range(1, len(p)) r(n)),
    a AS (SELECT p, 0 AS dir FROM f UNION ALL SELECT p, 1 FROM d),
    n AS (SELECT array_to_string(list_slice(p, 1, n), '/') AS path, n, len(p) AS depth, dir FROM a, range(0, len(p)) r(n))
    SELECT coalesce(path, '') AS path, count(*) FILTER (n = depth - 1 AND dir = 0) AS own_files, count(*) FILTER (n = depth - 1 AND dir = 1) AS own_dirs,
    count(*) FILTER (dir = 0) AS files, count(*) FILTER (dir = 1) AS dirs FROM n GROUP BY 1"""
)
def folder_counts(spark, sf_dir):
    return expand.folder_counts(T.parts(spark, sf_dir)).drop("parent")


@register()
def expand_plan(spark, sf_dir):
    return expand.expand(expand.folder_counts(T.parts(spark, sf_dir)), budget=1500)[1]


# Aggregates kept up by changes: rows of `events` by their size stay, leave, are replaced or come


def _changes(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(before, upserts, removed) of a catalogue of events with links and errors."""
    n = F.col("size_bytes")
    rows = T.events(spark, sf_dir).withColumns({"is_symlink": n % 7 == 0, "symlink_ok": F.when(n % 7 == 0, n % 14 != 0), "error": F.when(n % 5 == 0, "x")})
    before = rows.where(n % 11 != 4)
    came = rows.where(n % 11 == 4)
    replaced = before.where(n % 11 == 5).withColumns({"size_bytes": n * 2, "mtime": F.col("mtime") - F.expr("interval 9 days"), "category": F.lit("other")})
    return before, came.unionByName(replaced), before.where(n % 11 == 6).select("path")


_AFTER = f"""(SELECT path, CASE WHEN size_bytes % 11 = 5 THEN 'other' ELSE category END AS category, ext, size_bytes % 7 = 0 AS link,
    size_bytes % 14 = 0 AS broken, size_bytes % 5 = 0 AS failed, CASE WHEN size_bytes % 11 = 5 THEN size_bytes * 2 ELSE size_bytes END AS size_bytes,
    CASE WHEN size_bytes % 11 = 5 THEN mtime - INTERVAL 9 DAY ELSE mtime END AS mtime FROM {EVENTS} WHERE size_bytes % 11 <> 6)"""


@register(_rollup_sql(_AFTER))
def rollup_upkeep(spark, sf_dir):
    before, upserts, removed = _changes(spark, sf_dir)
    changes, after = upkeep.signed(before, upserts, removed), delta.apply_delta(before, upserts, removed)
    return _shown(upkeep.rollup_of(upkeep.rollup_after(upkeep.rollup_state(before), changes, after)))


@register(f"SELECT 'category' AS facet, category AS value, count(*) AS n FROM {_AFTER} WHERE category <> '' GROUP BY 2")
def facets_upkeep(spark, sf_dir):
    before, upserts, removed = _changes(spark, sf_dir)
    return upkeep.counts_after(facets.facets(before), upkeep.signed(before, upserts, removed))


@register(
    f"""SELECT count(*) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, count(*) FILTER (link) AS n_symlinks,
    count(*) FILTER (broken) AS n_broken_symlinks, count(*) FILTER (failed) AS n_errors FROM {_AFTER}"""
)
def summary_upkeep(spark, sf_dir):
    before, upserts, removed = _changes(spark, sf_dir)
    return upkeep.summary_after(facets.summary(before), upkeep.signed(before, upserts, removed))


# Aggregates


@register(
    f"""SELECT 'category' AS facet, category AS value, count(*) AS n FROM {PART} WHERE category <> '' GROUP BY 2
    UNION ALL SELECT 'ext', ext, count(*) FROM {PART} WHERE ext <> '' GROUP BY 2"""
)
def facets_category_ext(spark, sf_dir):
    return facets.facets(T.parts(spark, sf_dir))


@register(
    f"""SELECT count(*) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, count(*) FILTER (size_bytes % 7 = 0) AS n_symlinks,
    count(*) FILTER (size_bytes % 14 = 0) AS n_broken_symlinks, count(*) FILTER (size_bytes % 5 = 0) AS n_errors FROM {EVENTS}"""
)
def summary_health(spark, sf_dir):
    n = F.col("size_bytes")
    link = n % 7 == 0
    rows = T.events(spark, sf_dir).withColumns(
        {"is_symlink": link, "symlink_ok": F.when(link, n % 14 != 0), "error": F.when(n % 5 == 0, F.lit("x"))}
    )
    return facets.summary(rows)


@register(f"SELECT ext, arg_min(category, path) AS category FROM {PART} WHERE ext <> '' GROUP BY ext")
def ext_category_map(spark, sf_dir):
    return facets.ext_categories(T.parts(spark, sf_dir))


@register(
    f"""SELECT category, count(*) AS n, max(mtime) AS newest, CAST(CASE category WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS INTEGER) AS position
    FROM {EVENTS} GROUP BY category"""
)
def category_groups(spark, sf_dir):
    return facets.category_groups(T.events(spark, sf_dir), ["purchase", "click"])


_ABOVE = "[d FOR d IN [array_to_string(list_slice(string_split(path, '/'), 1, n), '/') FOR n IN range(1, len(string_split(path, '/')))]"


@register(
    f"""WITH hits AS (SELECT *, coalesce(list_extract({_ABOVE} IF contains(lower(list_extract(string_split(d, '/'), -1)), 'promo')], 1), {PARENT}) AS dir
      FROM {PART}), g AS (SELECT dir, count(*) AS n, max(mtime) AS newest FROM hits GROUP BY dir)
    SELECT dir, n, newest, CAST(CASE WHEN contains(lower(list_extract(string_split(dir, '/'), -1)), 'promo') THEN 0
      WHEN contains(lower(dir), 'promo') THEN 1 ELSE 2 END AS INTEGER) AS relevance, CAST(len(string_split(dir, '/')) AS INTEGER) AS depth FROM g"""
)
def folder_groups(spark, sf_dir):
    return facets.folder_groups(T.parts(spark, sf_dir), "promo")


def _counts_sql(column: str) -> str:
    return f"(SELECT array_to_string(list(v || '=' || n ORDER BY v), ' ') FROM (SELECT {column} AS v, count(*) AS n FROM {PART} GROUP BY 1))"


@register(f"SELECT {_counts_sql('category')} AS by_category, {_counts_sql('ext')} AS by_ext")
def summary_maps(spark, sf_dir):
    shown = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), " ").alias(c)
    return facets.summary_maps(T.parts(spark, sf_dir)).select(shown("by_category"), shown("by_ext"))


@register(f"SELECT path, size_bytes AS n_obs FROM {EVENTS} WHERE category = 'click' AND size_bytes % 2 = 0 ORDER BY n_obs DESC, path LIMIT 12")
def widest_matrices(spark, sf_dir):
    shaped = T.events(spark, sf_dir).withColumn("n_obs", F.when(F.col("size_bytes") % 2 == 0, F.col("size_bytes")))
    return facets.widest(shaped, category="click").select("path", "n_obs")


@register(
    f"SELECT DISTINCT ext, CAST(CASE ext WHEN 'png' THEN 1 WHEN 'csv' THEN 2 ELSE 3 END AS INTEGER) AS position FROM {PART} WHERE ext <> ''"
)
def types_pinned_first(spark, sf_dir):
    return facets.pinned_first(T.parts(spark, sf_dir).where("ext <> ''").select("ext").distinct(), "ext", ["png", "csv"])


@register(f"SELECT path, size_bytes FROM {EVENTS} WHERE category = 'click' ORDER BY size_bytes DESC, path LIMIT 25")
def largest_of_category(spark, sf_dir):
    return facets.largest(T.events(spark, sf_dir), "click").select("path", "size_bytes")


@register(
    """SELECT * EXCLUDE (r) FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
    WHERE r = 1"""
)
def dedupe_latest(spark, sf_dir):
    events = T.read(spark, sf_dir, "events")
    return delta.latest(events, ["user_id"], F.col("ts").desc(), F.col("event_id").desc()).select("user_id", "event_id")


# Lineage

_HREFS = r"""(SELECT path AS src, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS raw FROM """ + PAGES + ")"
_REF = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '^\s+|\s+$', '', 'g'),
  '^["''`]+|["''`]+$', '', 'g'), '[#?].*$', '', 's'), '^(?:\./)+', ''), '/+$', '')"""
_REFS = rf"(SELECT src, {_REF} AS ref FROM {_HREFS} WHERE NOT contains(raw, '://') AND NOT regexp_matches(lower(raw), '^(mailto|data|tel):'))"


@register(f"SELECT src, ref, count(*) AS n FROM {_REFS} WHERE ref <> '' GROUP BY ALL")
def md_like_refs(spark, sf_dir):
    return lineage.references(T.pages(spark, sf_dir)).groupBy("src", "ref").agg(F.count(F.lit(1)).alias("n"))


_ORDER_FILES = "(SELECT 'cust_' || c_custkey || '/c_' || c_custkey || '.md' AS path FROM customer WHERE c_custkey % 3 <> 0)"
_ORDER_REFS = "(SELECT 'orders/o_' || o_orderkey || '.md' AS src, 'cust_' || o_custkey || '/c_' || o_custkey || '.md' AS dst FROM orders)"


@register(f"SELECT src, dst FROM {_ORDER_REFS} WHERE dst IN (SELECT path FROM {_ORDER_FILES})")
def lineage_edges(spark, sf_dir):
    return _order_graph(spark, sf_dir).where("dst is not null").select("src", "dst")


@register(f"SELECT src, '../' || dst AS ref FROM {_ORDER_REFS} WHERE dst NOT IN (SELECT path FROM {_ORDER_FILES})")
def lineage_dangling(spark, sf_dir):
    return _order_graph(spark, sf_dir).where("dst is null").select("src", "ref")


def _order_graph(spark, sf_dir):
    """Orders that refer, relative to their own folder, to files of customers, of which every third has none."""
    orders, customers = T.read(spark, sf_dir, "orders"), T.read(spark, sf_dir, "customer")
    name = lambda c: F.concat(F.lit("cust_"), F.col(c), F.lit("/c_"), F.col(c), F.lit(".md"))
    src = F.concat(F.lit("orders/o_"), F.col("o_orderkey"), F.lit(".md"))
    refs = orders.select(src.alias("src"), F.concat(F.lit("../"), name("o_custkey")).alias("ref"))
    return lineage.resolve(refs, customers.where("c_custkey % 3 <> 0").select(name("c_custkey").alias("path")))


_COMMON = "(SELECT 'c' || (o_orderkey % 50) || '/d' || o_orderkey || '/README.md' AS path FROM orders)"


@register(
    """SELECT 'src/s' || o_orderkey || '.py' AS src, 'c' || (o_orderkey % 50) || '/d' || o_orderkey || '/README.md' AS dst
    FROM orders WHERE o_orderkey % 2 = 0"""
)
def lineage_common_name(spark, sf_dir):
    """Every file has the same name; a reference's folder tells which one is meant."""
    key = F.col("o_orderkey").cast("string")
    orders = T.read(spark, sf_dir, "orders").select(key.alias("k"), (F.col("o_orderkey") % 50).cast("string").alias("c"), (F.col("o_orderkey") % 2 == 0).alias("even"))
    paths = orders.select(F.concat(F.lit("c"), "c", F.lit("/d"), "k", F.lit("/README.md")).alias("path"))
    refs = orders.where("even").select(F.concat(F.lit("src/s"), "k", F.lit(".py")).alias("src"), F.concat(F.lit("/d"), "k", F.lit("/README.md")).alias("ref"))
    return lineage.resolve(refs, paths).select("src", "dst")


_EDGES = f"(SELECT DISTINCT src, ref FROM {_REFS} WHERE ref <> '')"


@register(f"SELECT 'refs' AS direction, ref AS other, count(*) AS n FROM {_EDGES} GROUP BY ref UNION ALL SELECT 'ref_by', src, count(*) FROM {_EDGES} GROUP BY src")
def page_neighbours(spark, sf_dir):
    """From how many pages each reference is referred to, and to how many each page refers."""
    edges = lineage.references(T.pages(spark, sf_dir)).select("src", F.col("ref").alias("dst"))
    turned = F.when(F.col("direction") == "refs", "ref_by").otherwise("refs")
    return lineage.degrees(edges).select(turned.alias("direction"), F.col("path").alias("other"), "n")


@register(
    """WITH e AS (SELECT DISTINCT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders UNION SELECT DISTINCT 'o' || l_orderkey, 's' || l_suppkey FROM lineitem)
    SELECT src AS path, 'refs' AS direction, array_to_string(list(dst ORDER BY dst), ' ') AS others FROM e GROUP BY src
    UNION ALL SELECT dst, 'ref_by', array_to_string(list(src ORDER BY src), ' ') FROM e GROUP BY dst"""
)
def graph_neighbours(spark, sf_dir):
    """Customers refer to their orders, and orders to their suppliers: all neighbours of every node."""
    name = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    orders = T.read(spark, sf_dir, "orders").select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst"))
    lines = T.read(spark, sf_dir, "lineitem").select(name("o", "l_orderkey").alias("src"), name("s", "l_suppkey").alias("dst"))
    return lineage.all_neighbours(orders.unionByName(lines)).select("path", "direction", F.array_join("others", " ").alias("others"))


@register(
    f"""WITH e AS (SELECT n_name AS src, r_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT 'ref_by' AS direction, src AS other FROM e WHERE dst = 'ASIA' UNION ALL SELECT 'refs', dst FROM e WHERE src = 'CHINA'"""
)
def refs_and_ref_by(spark, sf_dir):
    nation, region = T.read(spark, sf_dir, "nation"), T.read(spark, sf_dir, "region")
    edges = nation.join(region, nation.n_regionkey == region.r_regionkey)
    edges = edges.select(F.col("n_name").alias("src"), F.col("r_name").alias("dst"), F.lit("in").alias("kind"))
    found = lineage.neighbours(edges, "ASIA").where("direction = 'ref_by'")
    return found.unionByName(lineage.neighbours(edges, "CHINA").where("direction = 'refs'")).select("direction", "other")


@register(f"SELECT p.path FROM {PAGES} p WHERE p.path NOT IN (SELECT path FROM {PAGES} WHERE size_bytes % 2 = 0)")
def dangling_paths(spark, sf_dir):
    pages = T.pages(spark, sf_dir)
    return lineage.missing(pages.select("path"), pages.where("size_bytes % 2 = 0"))


# Deltas: two states of `orders`, derived by key

_STATE = "SELECT CAST(o_orderkey AS VARCHAR) AS path, o_custkey AS size_bytes, o_orderstatus AS extractor, o_orderpriority AS meta FROM orders"
_OLD = f"({_STATE} WHERE o_orderkey % 7 <> 0)"
_NEW = f"(SELECT path, CASE WHEN CAST(path AS BIGINT) % 5 = 0 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes, extractor, CASE WHEN CAST(path AS BIGINT) % 11 = 0 THEN NULL ELSE meta END AS meta FROM ({_STATE}) WHERE CAST(path AS BIGINT) % 9 <> 0)"


def _states(spark, sf_dir):
    orders = T.read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_orderkey").cast("string").alias("path"), F.col("o_custkey").alias("size_bytes"),
        F.col("o_orderstatus").alias("extractor"), F.col("o_orderpriority").alias("meta"),
    )
    new = orders.where("k % 9 <> 0").withColumns(
        {
            "size_bytes": F.when(F.col("k") % 5 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")),
            "meta": F.when(F.col("k") % 11 != 0, F.col("meta")),
        }
    )
    return orders.where("k % 7 <> 0").drop("k"), new.drop("k")


_CHANGE = """CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed'
  WHEN a.size_bytes IS DISTINCT FROM b.size_bytes OR a.extractor IS DISTINCT FROM b.extractor OR a.meta IS DISTINCT FROM b.meta THEN 'changed' END"""


@register(f"SELECT coalesce(a.path, b.path) AS path, {_CHANGE} AS change FROM {_OLD} a FULL JOIN {_NEW} b ON a.path = b.path WHERE {_CHANGE} IS NOT NULL")
def drift_diff(spark, sf_dir):
    return delta.diff(*_states(spark, sf_dir))


@register("SELECT CAST(o_orderkey AS VARCHAR) AS path, 'changed' AS change FROM orders WHERE o_orderkey % 13 = 0")
def drift_json_reordered(spark, sf_dir):
    """Metadata with other blanks and another order of keys are the same; another value is not."""
    key = F.col("o_orderkey")
    text = lambda form, value: F.format_string(form, value, F.col("o_orderpriority"))
    rows = T.read(spark, sf_dir, "orders").select(key, "o_orderpriority").withColumns({"path": key.cast("string"), "size_bytes": key, "extractor": F.lit("x")})
    old = rows.withColumn("meta", text('{"a":%d,"b":"%s"}', key))
    new = rows.withColumn("meta", text('{ "b": "%2$s", "a": %1$d }', key + F.when(key % 13 == 0, 1).otherwise(0)))
    return delta.diff(old, new)


@register(
    """SELECT path, change FROM (SELECT CAST(o_orderkey AS VARCHAR) AS path, CASE WHEN o_orderkey % 7 = 0 THEN 'added' WHEN o_orderkey % 9 = 0 THEN 'removed'
      WHEN o_orderkey % 5 = 0 OR o_orderkey % 6 = 0 OR o_orderkey % 8 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 10 = 1 OR o_orderkey % 14 = 1
        OR o_orderkey % 15 = 1 THEN 'changed' END AS change FROM orders WHERE o_orderkey % 7 <> 0 OR o_orderkey % 9 <> 0) WHERE change IS NOT NULL"""
)
def view_delta(spark, sf_dir):
    """Each of the seven fields changes in rows of its own."""
    key = F.col("o_orderkey")

    def state(later: bool) -> DataFrame:
        flip = lambda n, r=0: (key % n == r) & F.lit(later)
        fields = {
            "path": key.cast("string"), "size_bytes": key + flip(5).cast("int"), "mtime": F.timestamp_seconds(key + flip(6).cast("int")),
            "extractor": F.when(flip(8), "other").otherwise("doc"), "meta": F.when(~flip(11), '{"a":1}'), "is_symlink": flip(10, 1),
            "symlink_target": F.when(flip(14, 1), "t"), "symlink_ok": F.when(flip(15, 1), False),
        }
        kept = key % 9 != 0 if later else key % 7 != 0
        return T.read(spark, sf_dir, "orders").where(kept).select(*(c.alias(n) for n, c in fields.items()))

    return delta.diff(state(False), state(True), delta.VIEW_FIELDS)


@register(f"SELECT path, size_bytes, extractor, meta FROM {_NEW}")
def apply_delta(spark, sf_dir):
    old, new = _states(spark, sf_dir)
    changes = delta.diff(old, new)
    upserts = new.join(changes.where("change <> 'removed'").select("path"), "path", "left_semi")
    return delta.apply_delta(old, upserts, changes.where("change = 'removed'"))


@register(
    f"SELECT path, size_bytes, extractor, meta FROM {_NEW} UNION ALL SELECT path, size_bytes, extractor, meta FROM {_OLD} WHERE CAST(path AS BIGINT) % 9 = 0"
)
def upsert_merge(spark, sf_dir):
    return delta.upsert(*_states(spark, sf_dir))


@register(
    """SELECT CAST(o_orderkey AS VARCHAR) AS path, CASE WHEN o_orderkey % 3 = 0 THEN 'broken' ELSE 'repaired' END AS flip
    FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0 OR o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0"""
)
def health_flips(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = T.read(spark, sf_dir, "orders")
    state = lambda n: rows.select(key.cast("string").alias("path"), F.lit(True).alias("is_symlink"), (key % n != 0).alias("symlink_ok"))
    return delta.health_flips(state(2), state(3))


@register(
    f"""SELECT b.path, coalesce(a.path IS NOT NULL AND a.size_bytes = b.size_bytes AND a.extractor IS NOT NULL AND a.extractor <> 'F'
      AND CAST(b.path AS BIGINT) <= 20000, false) AS reuse FROM {_NEW} b LEFT JOIN {_OLD} a ON a.path = b.path"""
)
def reuse_gate(spark, sf_dir):
    old, new = _states(spark, sf_dir)
    timed = lambda df: df.withColumn("mtime", F.timestamp_seconds(F.col("path").cast("long")))
    prior = timed(old).withColumn("error", F.when(F.col("extractor") == "F", F.lit("E: old")))
    return delta.reusable(timed(new), prior, F.lit(20002.0)).select("path", "reuse")


@register("SELECT event_id, event_id > 998 AS racy, false AS never FROM events")
def racy_window(spark, sf_dir):
    at = F.col("event_id").cast("double")
    rows = T.read(spark, sf_dir, "events")
    return rows.select("event_id", delta.is_racy(at, F.lit(1000.0)).alias("racy"), delta.is_racy(at, F.lit(None).cast("double")).alias("never"))


@register(f"SELECT path FROM {EVENTS} WHERE NOT (starts_with(path, 'click/user_1/') OR path = 'click/user_1') OR size_bytes % 2 = 0")
def sweep_subtree(spark, sf_dir):
    events = T.events(spark, sf_dir)
    return delta.sweep(events, events.where("size_bytes % 2 = 0"), "click/user_1").select("path")


@register(f"SELECT path FROM {EVENTS} WHERE path IN (SELECT path FROM {EVENTS} WHERE size_bytes % 3 = 0)")
def known_keys(spark, sf_dir):
    events = T.events(spark, sf_dir)
    return delta.known(events, events.where("size_bytes % 3 = 0")).select("path")


_H = "sha256('+' || length(CAST(p_partkey AS VARCHAR)) || ':' || p_partkey || '+' || length(p_name) || ':' || p_name)"


@register(
    f"""WITH h AS (SELECT {_H} AS h FROM part), g AS (SELECT substr(h, 1, 4) AS p, sha256(string_agg(h, '' ORDER BY h)) AS g, count(*) AS n FROM h GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS n_rows, sha256(string_agg(g, '' ORDER BY p)) AS digest FROM g"""
)
def digest_rowwise(spark, sf_dir):
    return digest.row_digest(T.read(spark, sf_dir, "part"), ["p_partkey", "p_name"])


_PART_META = """'{"brand":"' || p_brand || '","size":' || p_size || '}'"""
_PART_ROW = "CAST(p_partkey AS VARCHAR)"
_LANES = ", ".join(f"lpad(printf('%x', CAST(sum(CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT)) % 4294967296 AS BIGINT)), 8, '0')" for k in range(8))


@register(
    f"""WITH r AS (SELECT p_brand || '/' || {_PART_ROW} AS path, CAST(p_size AS VARCHAR) AS size_bytes, p_type AS extractor, {_PART_META} AS meta FROM part),
    h AS (SELECT substr(path, 1, 8) AS part, sha256('+' || length(path) || ':' || path || '+' || length(size_bytes) || ':' || size_bytes
      || '+' || length(extractor) || ':' || extractor || '+' || length(meta) || ':' || meta) AS h FROM r),
    b AS (SELECT part, h FROM h UNION ALL SELECT '', h FROM h)
    SELECT part, count(*) AS n_rows, printf('%x', count(*)) || '-' || concat({_LANES}) AS digest FROM b GROUP BY part"""
)
def digest_ranges(spark, sf_dir):
    """Digests of ranges of paths that add up to the whole's, over rows with metadata whose keys come in another order."""
    other = F.concat(F.lit('{ "size": '), F.col("p_size"), F.lit(', "brand":"'), F.col("p_brand"), F.lit('"}'))
    path = F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string"))
    rows = T.read(spark, sf_dir, "part").select(path.alias("path"), F.col("p_size").alias("size_bytes"), F.col("p_type").alias("extractor"), other.alias("meta"))
    return digest.range_digest(rows, prefix=8)


# Metadata and events derived from `events`


def _described(spark, sf_dir) -> DataFrame:
    """Events as matrices with observation columns n0 to n2, and as figures with labels."""
    n = lambda k: (F.col("size_bytes") % k).cast("string")
    obs = F.concat(F.lit('{"obs_columns":["Cell","N'), n(3), F.lit('"],"obsm":{"X_'), n(5), F.lit('":[9,2]},"figure_text":["Axis","B'), n(4), F.lit('"]}'))
    return T.events(spark, sf_dir).withColumn("meta", obs)


@register(f"SELECT path FROM {EVENTS} WHERE size_bytes % 3 = 1")
def filter_obs_page(spark, sf_dir):
    return search.search(_described(spark, sf_dir), "obs:n1", "page").select("path")


@register(f"SELECT path FROM {EVENTS} WHERE size_bytes % 3 = 2 AND size_bytes % 5 = 1")
def find_has_obs_and_obsm(spark, sf_dir):
    return search.filter_files(_described(spark, sf_dir), has_obs="N2", has_obsm="X_1").select("path")


@register(f"SELECT path, 'axis b' || (size_bytes % 4) AS labels FROM {EVENTS}")
def figure_text_split(spark, sf_dir):
    return _described(spark, sf_dir).select("path", M.figure_text(F.col("meta")).alias("labels"))


@register(
    f"""SELECT path, CASE WHEN starts_with(path, 'click/user_1/') AND mtime <= TIMESTAMP '2024-01-15 00:00:00'
      THEN TIMESTAMP '2024-01-15 00:00:00.5' ELSE mtime END AS drain_at FROM {EVENTS}"""
)
def defer_events(spark, sf_dir):
    owners = spark.sql("select 'click/user_1' as root, true as subtree, timestamp'2024-01-15 00:00:00' as lease_until, cast(null as timestamp) as retired_at")
    events = T.events(spark, sf_dir).select(F.col("mtime").alias("ts"), "path")
    return live.defer(events, owners).select("path", "drain_at")


# Functions over texts, names and JSON


@register(
    """SELECT doc_id, array_to_string(list_sort(list_distinct([lower(t) FOR t IN string_split(text, ' ')
      IF length(t) BETWEEN 2 AND 40 AND NOT regexp_full_match(t, '[0-9.,+-]+')])), ' ') AS tokens FROM documents"""
)
def text_tokens(spark, sf_dir):
    return T.read(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(X.label_tokens(F.col("text"))), " ").alias("tokens"))


@register("SELECT event_id, array_to_string(json_keys(props), ' ') AS keys, CAST(len(json_keys(props)) AS INTEGER) AS n_keys FROM events")
def json_top_keys(spark, sf_dir):
    keys = M.top_keys(F.col("props"))
    return T.read(spark, sf_dir, "events").select("event_id", F.array_join(keys, " ").alias("keys"), F.size(keys).alias("n_keys"))


@register(f"SELECT path, {HAY} AS hay FROM {EVENTS}")
def haystack_flat(spark, sf_dir):
    return T.events(spark, sf_dir).select("path", search.haystack().alias("hay"))


@register(
    f"""SELECT path, {NAME} AS name, {PARENT} AS parent, CAST(len(string_split(path, '/')) - 1 AS INTEGER) AS depth, 'txt' AS ext, 'doc' AS category,
    'file:///data/' || path AS uri FROM {DOCS}"""
)
def path_parts(spark, sf_dir):
    path = F.col("path")
    ext = X.ext_of(path)
    return T.documents(spark, sf_dir).select(
        "path", X.basename(path).alias("name"), X.parent_of(path).alias("parent"), X.depth_of(path).alias("depth"), ext.alias("ext"),
        X.category_for(ext).alias("category"), X.path_form("/data", path, "file_uri").alias("uri"),
    )


@register(
    f"""SELECT path, array_to_string([t FOR t IN [CASE WHEN contains(lower(path), 'promo') THEN 'metal' END, CASE WHEN regexp_matches(path, 'Brand#[12]') THEN 'low' END]
      IF t IS NOT NULL], ' ') AS tags FROM {PART}"""
)
def ontology_tags(spark, sf_dir):
    rules = [("PROMO", "metal"), ("brand#[12]", "low"), ("promo", "metal")]
    return T.parts(spark, sf_dir).select("path", F.array_join(X.tags_for(F.col("path"), rules), " ").alias("tags"))


_TENTHS = "printf('%.1f ', floor(size_bytes / {0} * 10 + 0.5) / 10)"
_UNITS = " ".join(f"WHEN size_bytes < {1024 ** (p + 1)} THEN {_TENTHS.format(f'{1024.0**p:.1f}')} || '{u}'" for p, u in enumerate(("KB", "MB", "GB", "TB"), 1))


@register(f"SELECT path, CASE WHEN size_bytes < 1024 THEN size_bytes || ' B' {_UNITS} ELSE {_TENTHS.format(f'{1024.0**5:.1f}')} || 'PB' END AS shown FROM {DOCS}")
def display_bytes(spark, sf_dir):
    return T.documents(spark, sf_dir).select("path", X.human_bytes(F.col("size_bytes")).alias("shown"))


@register(
    f"""SELECT path, CASE WHEN age < 86400 THEN 'today' WHEN age < 604800 THEN 'week' ELSE 'older' END AS bucket
    FROM (SELECT path, epoch(TIMESTAMP '2024-01-20 00:00:00') - epoch(mtime) AS age FROM {EVENTS})"""
)
def recency_buckets(spark, sf_dir):
    age = F.unix_timestamp(F.lit("2024-01-20 00:00:00").cast("timestamp")) - F.unix_micros(F.col("mtime").cast("timestamp")) / 1e6
    return T.events(spark, sf_dir).select("path", X.recency(age).alias("bucket"))


@register(f"SELECT path FROM {EVENTS} WHERE category IN ('click', 'other') ORDER BY path LIMIT 5000000")
def active_listing(spark, sf_dir):
    """The full list of the categories that are switched on."""
    return search.listing(search.active(T.events(spark, sf_dir), ["click", "other"])).select("path")


@register("""SELECT page_id, replace(replace(replace(html, '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026') AS embedded FROM pages""")
def embedded_pages(spark, sf_dir):
    return T.read(spark, sf_dir, "pages").select("page_id", X.embeddable(F.col("html")).alias("embedded"))


# Sources and sinks: `part` as a tree of files, a manifest and a store, in the folder that the executors share

_FILE = """p_brand || '/' || p_type || '/part_' || p_partkey || '.' || ext"""
_FILES = """(SELECT *, CASE ext WHEN 'csv' THEN 'k,name' || repeat(',x', p_size % 7) || chr(10) || '1,2' || chr(10) WHEN 'json' THEN '{"key' || p_partkey || '":[1]}'
      WHEN 'md' THEN '# Part ' || p_partkey || chr(10) || chr(10) || 'See [it](x.csv).' || chr(10) WHEN 'py' THEN 'def part_' || p_partkey || '(): pass' || chr(10) ELSE 'plain' END AS content
    FROM (SELECT *, list_extract(['csv', 'json', 'md', 'py', 'log'], CAST(p_size % 5 + 1 AS INT)) AS ext FROM part))"""


def _tree_of_parts(spark, sf_dir) -> str:
    """A tree with a file for each part, written by the tasks; its folder."""
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    ext = F.element_at(F.array(*map(F.lit, ("csv", "json", "md", "py", "log"))), (size % 5 + 1).cast("int"))
    texts = {
        "csv": F.concat(F.lit("k,name"), F.repeat(F.lit(",x"), (size % 7).cast("int")), F.lit("\n1,2\n")), "json": F.concat(F.lit('{"key'), key, F.lit('":[1]}')),
        "md": F.concat(F.lit("# Part "), key, F.lit("\n\nSee [it](x.csv).\n")), "py": F.concat(F.lit("def part_"), key, F.lit("(): pass\n")), "log": F.lit("plain"),
    }
    content = F.coalesce(*(F.when(F.col("ext") == e, t) for e, t in texts.items()))
    rows = T.read(spark, sf_dir, "part").withColumn("ext", ext).withColumn("content", content)
    path = F.concat_ws("/", "p_brand", "p_type", F.concat(F.lit("part_"), key, F.lit("."), "ext"))
    root = shared_folder(spark, "tree").removeprefix("file:")

    def write(batches):
        for batch in batches:
            for name, text in zip(batch["path"], batch["content"]):
                os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
                with open(f"{root}/{name}", "w", encoding="utf-8") as file:
                    file.write(text)
            yield batch[["path"]]

    rows.select(path.alias("path"), "content").mapInPandas(write, "path string").write.format("noop").mode("overwrite").save()
    return root


@register(f"SELECT {_FILE} AS path, CAST(strlen(content) AS BIGINT) AS size_bytes, ext, false AS is_symlink FROM {_FILES}")
def walk_tree(spark, sf_dir):
    """A file for each part, found again by a walk in rounds."""
    return sources_tree.walk(spark, _tree_of_parts(spark, sf_dir)).select("path", "size_bytes", "ext", "is_symlink")


@register(
    f"""SELECT {_FILE} AS path, CASE ext WHEN 'csv' THEN CAST(p_size % 7 + 2 AS VARCHAR) WHEN 'json' THEN 'key' || p_partkey WHEN 'md' THEN 'Part ' || p_partkey
      WHEN 'py' THEN 'part_' || p_partkey END AS detail FROM {_FILES}"""
)
def describe_tree(spark, sf_dir):
    """What the readers find in each of these files."""
    root = _tree_of_parts(spark, sf_dir)
    found = extract.describe(sources_tree.walk(spark, root), root)
    at = {"csv": "$.n_columns", "json": "$.top_level_keys[0]", "md": "$.h1_title", "py": "$.defs[0]"}
    detail = F.coalesce(*(F.when(F.col("ext") == e, F.get_json_object("meta", p)) for e, p in at.items()))
    return found.select("path", detail.alias("detail"))


def _entries(spark, sf_dir) -> DataFrame:
    rows = T.parts(spark, sf_dir)
    none = {"is_symlink": F.lit(False), "symlink_target": F.lit(None).cast("string"), "symlink_ok": F.lit(None).cast("boolean"), "error": F.lit(None).cast("string")}
    return rows.withColumns(none)


@register(f"SELECT path, category, ext, size_bytes, strftime(mtime, '%Y-%m-%dT%H:%M:%SZ') AS mtime_iso, extractor, meta FROM {PART}")
def manifest_roundtrip(spark, sf_dir):
    """Written as one document and read again by ranges."""
    path = f"{shared_folder(spark, 'manifest')}/INDEX.json"
    catalogue.write_index(_entries(spark, sf_dir), "-", path)
    return catalogue.read_index(spark, path).select("path", "category", "ext", "size_bytes", "mtime_iso", "extractor", "meta")


@register(f"SELECT path, CASE WHEN starts_with(path, 'Brand#1') THEN size_bytes + 1000 ELSE size_bytes END AS size_bytes FROM {PART} WHERE NOT (starts_with(path, 'Brand#1') AND size_bytes % 3 = 0)")
def store_update(spark, sf_dir):
    """A store of many segments after the folders of ten brands were looked at again: some rows gone, the others changed."""
    rows = cut(T.parts(spark, sf_dir).select("path", "size_bytes"))
    store = catalogue.Store(spark, shared_folder(spark, "store"), segment_rows=max(100, rows.count() // 40))
    store.publish(rows)
    marks = [(r[0], True) for r in rows.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("b")).where("b like 'Brand#1%'").distinct().collect()]
    held = store.touched(marks)
    inside = live.at_or_below(F.col("path"), [m for m, _ in marks])
    found = rows.where(inside & (F.col("size_bytes") % 3 != 0)).withColumn("size_bytes", F.col("size_bytes") + 1000)
    store.publish(live.reconcile(store.read(only=held), [m for m, _ in marks], found), only=held)
    return store.read()


# Streams as batches over event logs


@register(
    """WITH e AS (SELECT event_id, event_id // 50 AS s, event_id % 50 AS k FROM events),
    b AS (SELECT *, (k - min(k) OVER (PARTITION BY s)) // 20 AS b FROM e),
    t AS (SELECT event_id, s, min(k) OVER (PARTITION BY s, b) * 100 AS first, max(k) OVER (PARTITION BY s, b) * 100 AS last FROM b)
    SELECT event_id, make_timestamp(CAST((s * 60000 + least(last + 300, first + 2000)) * 1000 AS BIGINT)) AS drain_at FROM t"""
)
def held_events(spark, sf_dir):
    """Five seconds of events in each minute, never quiet: each is due when its burst has lasted two seconds, or is quiet."""
    n = F.col("event_id")
    ms = F.floor(n / 50) * 60_000 + n % 50 * 100
    events = T.read(spark, sf_dir, "events").select(F.timestamp_millis(ms).alias("ts"), F.concat(F.lit("all/"), n.cast("string")).alias("path"), F.lit(False).alias("recursive"))
    due = timers.drain_times(timers.as_log(events))
    return due.select(F.substring_index("path", "/", -1).cast("long").alias("event_id"), F.col("drain_at").cast("timestamp_ntz").alias("drain_at"))


@register(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 3600 SECOND THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, count(*) AS n, CAST(floor(epoch(min(ts))) AS BIGINT) AS first_s FROM s GROUP BY user_id, session"""
)
def debounce_sessions(spark, sf_dir):
    events = T.read(spark, sf_dir, "events")
    bursts = live.bursts(events, "ts", "3600 seconds", "user_id")
    return bursts.select("user_id", "n", F.unix_timestamp("first").alias("first_s"))


@register(
    """SELECT count(DISTINCT user_id) AS n_points, count(DISTINCT user_id) > 10000 AS rescan FROM events"""
)
def storm_cap(spark, sf_dir):
    points = T.read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path")).distinct()
    return live.storm(points)


@register(
    f"""WITH r AS (SELECT path FROM {_DIRS.format(PART)} WHERE contains(path, '/') AND contains(path, 'PROMO') OR path = 'Brand#12'),
    d AS (SELECT path, true AS recursive FROM r UNION SELECT path, false FROM {PART})
    SELECT path, recursive FROM d WHERE NOT EXISTS (SELECT 1 FROM r WHERE starts_with(d.path, r.path || '/') OR (d.path = r.path AND NOT d.recursive))"""
)
def dirty_subsume(spark, sf_dir):
    parts = T.parts(spark, sf_dir)
    roots = tree.directories(parts).where("contains(path, '/') and contains(path, 'PROMO') or path = 'Brand#12'")
    marks = roots.select("path", F.lit(True).alias("recursive")).unionByName(parts.select("path", F.lit(False).alias("recursive")))
    return live.subsume(marks)


_OPS = """(SELECT user_id AS op_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'planned' WHEN 'view' THEN 'executing'
  WHEN 'purchase' THEN 'committed' ELSE 'undone' END AS state FROM events)"""


@register(f"SELECT op_id, arg_max(state, seq) AS state, max(seq) AS seq FROM {_OPS} GROUP BY op_id")
def journal_state(spark, sf_dir):
    return journal.current(_ops(spark, sf_dir))


@register(
    f"""WITH c AS (SELECT op_id, arg_max(state, seq) AS state FROM {_OPS} GROUP BY op_id)
    SELECT op_id, state, CASE WHEN state IN ('planned', 'executing') THEN 'failed' WHEN state = 'committed' THEN 'settled' ELSE state END AS recovered FROM c"""
)
def recovery_branch(spark, sf_dir):
    return journal.recover(journal.current(_ops(spark, sf_dir))).select("op_id", "state", "recovered")


def _ops(spark, sf_dir):
    kind = F.col("event_type")
    state = F.when(kind == "click", "planned").when(kind == "view", "executing").when(kind == "purchase", "committed").otherwise("undone")
    return T.read(spark, sf_dir, "events").select(F.col("user_id").alias("op_id"), F.col("event_id").alias("seq"), state.alias("state"))
