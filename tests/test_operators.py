import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from oxbow.functions import text as X
from oxbow.operators import delta, journal, lineage, rank, search, tree
from oxbow.streaming import live


@pytest.mark.parametrize(
    "text, words",
    [
        ("a  b\tc", ["a", "b", "c"]), ('"cell type" x', ["cell type", "x"]), ('cat:"a b', ["cat:a b"]), ('""', []), ("", []), ('a"b"c', ["abc"]),
    ],
)
def test_terms(text, words):
    assert search.terms(text, "ui") == words


def test_parse_dialects():
    ui = search.parse("Ext:PNG cat:Data type:x path:Foo fig:y ext: a:b :c", "ui")
    assert ui.filters == {"ext": ["png"], "cat": ["data", "x"]} and ui.free == ["foo", "fig:y", "a:b", ":c"] and ui.dangling == ["ext"]
    sql = search.parse("fig:Y obs:Leiden path:É", "sql")
    assert sql.filters == {"fig": ["y"], "obs": ["leiden"], "path": ["É"]} and not sql.free
    assert search.parse('dir:"a b"', "page").filters == {"dir": ['"a']}


def catalog(spark, paths):
    rows = [(p, "doc", "md", "doc", i, datetime(2024, 1, 1 + i % 28), "{}", [], None) for i, p in enumerate(paths)]
    return spark.createDataFrame(rows, "path string, category string, ext string, extractor string, size_bytes long, mtime timestamp, meta string, tags array<string>, figure_text string")


def brute_boundary(name, tokens):
    low = name.lower()
    for t in filter(None, tokens):
        i = low.find(t)
        while i >= 0:
            if i == 0 or low[i - 1] in "/-._0123456789" or (name[i].isascii() and name[i].isupper() and not name[i - 1].isupper()):
                return True
            i = low.find(t, i + 1)
    return False


def test_boundary_and_tiers(spark):
    seeded = random.Random(1)
    names = ["".join(seeded.choice("aAbB_-.1") for _ in range(seeded.randrange(1, 9))) for _ in range(300)]
    for tokens in (["ab"], ["b"], ["a", "b1"], ["_a"]):
        rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", rank.boundary(F.col("name"), tokens).alias("b")).collect()
        assert [r.name for r in rows if r.b != brute_boundary(r.name, tokens)] == []


def test_band(spark):
    paths = ["x/umap_plot.md", "umap/notes.md", "a/data_umap.md", "b/plot.md", "umap/plot_umap.md", "c/none.md", "deep/umapping/t.md"]
    rows = catalog(spark, paths)
    hits = rank.top_hits(rows, search.parse("umap plot", "ui"), tree.directories(rows), k=6).orderBy("rank").collect()
    assert [(h.path, h.tier, h.matched) for h in hits] == [
        ("umap/plot_umap.md", 1, 2), ("x/umap_plot.md", 1, 2), ("a/data_umap.md", 1, 1), ("b/plot.md", 1, 1), ("umap/notes.md", 2, 1), ("deep/umapping/t.md", 2, 1),
    ]
    folders = rank.top_hits(rows, search.parse("umap", "ui"), tree.directories(rows), k=3).orderBy("rank").collect()
    assert [(h.path, h.is_folder) for h in folders] == [("umap", True), ("deep/umapping", True), ("a/data_umap.md", False)]
    third = rank.top_hits(rows, search.parse("zzz", "ui"), found_elsewhere=rows.where("path = 'c/none.md'").select("path")).collect()
    assert [(h.path, h.tier) for h in third] == [("c/none.md", 3)]


def test_keys(spark):
    values = ["Ä", "Ä", "ß", "ss", "İ", "i", "ẞ", "Path/É.TXT"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", X.norm_key(F.col("v")).alias("k"), X.nfd_fold(F.col("v")).alias("n")).collect()
    key = {r.v: r.k for r in rows}
    assert key["Ä"] == key["Ä"] == "ä" and key["ß"] != key["ss"] and key["İ"] != key["i"] and key["ẞ"] == key["ß"] and key["Path/É.TXT"] == "path/é.txt"
    assert {r.v: r.n for r in rows}["Ä"] == "ä"
    parts = spark.createDataFrame([(p,) for p in ["a/b/c.tar.gz", "x.csv.gz", ".bashrc", "dir.d/file", "A.PNG", "top"]], "p string")
    got = parts.select(X.ext_of(F.col("p")), X.parent_of(F.col("p")), X.depth_of(F.col("p")), X.ancestors(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("gz", "a/b", 2, ["a", "a/b"]), ("csv.gz", "", 0, []), ("", "", 0, []), ("", "dir.d", 1, ["dir.d"]), ("png", "", 0, []), ("", "", 0, [])]


@pytest.mark.parametrize("glob, yes, no", [("*.cs?", "a/b.csv", "a.cs"), ("[!a]*", "b", "a"), ("x[0-9].md", "x3.md", "xa.md"), ("a.b", "a.b", "aXb")])
def test_globs(spark, glob, yes, no):
    row = spark.range(1).select(F.lit(yes).rlike(X.glob_to_regex(glob)), F.lit(no).rlike(X.glob_to_regex(glob))).first()
    assert tuple(row) == (True, False)


def test_tree(spark):
    rows = catalog(spark, ["A/x/1.md", "a/x/2.md", "A/y.md", "top.md", "A/x"])
    assert {r.path for r in tree.directories(rows).collect()} == {"A", "a", "a/x"}
    assert {r.path for r in tree.directories(rows, by_key=True).collect()} == {"A"}
    totals = {r.dir: (r.n_files, r.total_bytes) for r in tree.rollup(rows).collect()}
    assert totals == {"": (5, 10), "A": (3, 6), "A/x": (1, 0), "a": (1, 1), "a/x": (1, 1)}


def resolve_by_hand(ref, src, paths):
    by_name = {}
    for p in paths:
        by_name.setdefault(p.rsplit("/", 1)[-1], []).append(p)
    if ref in paths:
        return ref
    parts = []
    for seg in ((src.rsplit("/", 1)[0] + "/" if "/" in src else "") + ref).split("/"):
        if seg == ".." and parts and parts[-1] != "..":
            parts.pop()
        elif seg not in ("", "."):
            parts.append(seg)
    if "/".join(parts) in paths:
        return "/".join(parts)
    found = by_name.get(ref.rsplit("/", 1)[-1], [])
    others = [p for p in found if p != src]
    if len(found) == 1 or not found:
        return found[0] if found else None
    if len(others) == 1:
        return others[0]
    tails = [p for p in others if "/" in ref and p.endswith(ref)]
    return tails[0] if len(tails) == 1 else others[0]


def test_resolver(spark):
    seeded = random.Random(2)
    pick = lambda n: "/".join(seeded.choice(["a", "b", "xa"]) for _ in range(seeded.randrange(n)))
    paths = sorted({f"{pick(3)}/{seeded.choice('pqr')}.md".lstrip("/") for _ in range(14)})
    refs = sorted({(seeded.choice(paths), (seeded.choice(["", "../", "./../"]) + f"{pick(3)}/{seeded.choice('pqrs')}.md").lstrip("/")) for _ in range(200)})
    found = lineage.resolve(spark.createDataFrame(refs, "src string, ref string"), spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    assert len(found) == len(refs)
    assert [(r.src, r.ref, r.dst, resolve_by_hand(r.ref, r.src, paths)) for r in found if r.dst != resolve_by_hand(r.ref, r.src, paths)] == []


def test_common_names_do_not_multiply(spark):
    """References to a name that all files share: rows in proportion, and every folder told apart."""
    for n in (50, 200):
        paths = [(f"p{i}/x{i}/README.md",) for i in range(n)]
        refs = [(f"s{i}.md", f"/x{i}/README.md") for i in range(n)]
        found = lineage.resolve(spark.createDataFrame(refs, "src string, ref string"), spark.createDataFrame(paths, "path string"))
        assert {(r.src, r.dst) for r in found.collect()} == {(f"s{i}.md", f"p{i}/x{i}/README.md") for i in range(n)}


def test_ends_do_not_multiply_by_lengths(spark):
    """References of many lengths to one name: a path shows only the ends that its own folders may match."""
    folders = ["d" * (i % 40 + 1) + str(i) for i in range(200)]
    named = spark.createDataFrame([("R.md", f"c{i % 3}/{d}/R.md") for i, d in enumerate(folders)], "name string, path string")
    wanted = [f"/{d}/R.md" for d in folders] + ["2/" + folders[5] + "/R.md", "9/" + folders[5] + "/R.md", "x/" + folders[1] + "/R.md", "/R.md"]
    found = lineage.ends_of(named, spark.createDataFrame([("R.md", w) for w in wanted], "name string, ref string")).collect()
    assert len(found) == len(set(found)) == 2 * len(folders) + 2  # by characters alone it was over 40 for each path
    matched = {(r.path, r.ref) for r in found if r.ref in wanted}
    paths = [r.path for r in named.collect()]
    assert matched == {(p, w) for p in paths for w in wanted if p.endswith(w)}


def test_file_like_words(spark):
    text = "read('a/x.csv') then \"lib/y.tar.gz\", plot.PNG; not/a/dir word.txt.bak z.py? /q.md a/b/c.unknown"
    found = spark.createDataFrame([(text,)], "t string").select(lineage.file_like(F.col("t"))).first()[0]
    assert found == ["read('a/x.csv".split("'")[1], "lib/y.tar.gz", "x.csv", "y.tar.gz", "plot.PNG", "word.txt", "z.py", "q.md"]


def test_drift_compares_values(spark):
    schema = "path string, size_bytes int, extractor string, meta string"
    old = spark.createDataFrame([("a", 1, "x", '{"a":1,"b":2}'), ("b", 1, "x", '{"a":1}'), ("c", 1, "x", None), ("d", 1, "x", "{")], schema)
    new = spark.createDataFrame([("a", 1, "x", '{"b": 2, "a": 1}'), ("b", 1, "x", '{"a":2}'), ("c", 1, "x", "{}"), ("d", 1, "x", "{")], schema)
    assert {(r.path, r.change) for r in delta.diff(old, new).collect()} == {("b", "changed"), ("c", "changed")}


def test_accents_meet(spark):
    rows = spark.createDataFrame([(1, "caf\u00e9.md"), (2, "x/Cafe\u0301.md"), (3, "cafe.md"), (4, None)], "i int, name string")
    found = rows.where(X.holds(X.ascii_fold(F.col("name")), X.nfd_token("CAF\u00c9")))
    assert {r.i for r in found.collect()} == {1, 2}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Union" not in plan
    ago = spark.createDataFrame([(5.0,), (300.0,), (7300.0,), (200_000.0,), (-9.0,), (None,)], "s double").select(X.relative_time(F.col("s")))
    assert [r[0] for r in ago.collect()] == ["just now", "5m ago", "2h ago", "2d ago", "just now", ""]


def test_references(spark):
    refs = ["./a/b.md#x", "`c.csv`", "http://x/y.md", "mailto:a@b", "d\\e.txt/", "?q", " f.md "]
    found = spark.createDataFrame([(r,) for r in refs], "r string").where(~lineage.is_external(F.col("r"))).select(lineage.normal_ref(F.col("r")))
    assert [r[0] for r in found.collect()] == ["a/b.md", "c.csv", "d/e.txt", "", "f.md"]


def test_delta(spark):
    old = spark.createDataFrame([("a", 1, None), ("b", 2, "m"), ("c", 3, "m")], "path string, size_bytes int, meta string")
    new = spark.createDataFrame([("a", 1, None), ("b", 2, None), ("d", 4, "m")], "path string, size_bytes int, meta string")
    changes = delta.diff(old, new, ["size_bytes", "meta"])
    assert {r.path: r.change for r in changes.collect()} == {"b": "changed", "c": "removed", "d": "added"}
    upserts = new.join(changes.where("change <> 'removed'").select("path"), "path", "left_semi")
    assert sorted(map(tuple, delta.apply_delta(old, upserts, changes.where("change = 'removed'")).collect()), key=str) == sorted(map(tuple, new.collect()), key=str)
    assert sorted(r.path for r in delta.upsert(old, new).collect()) == ["a", "b", "c", "d"]
    values = [999.0, 1000.0, 1005.0, 998.0, 990.0]
    racy = spark.createDataFrame([(v,) for v in values], "m double").select(delta.is_racy(F.col("m"), F.lit(1000.0))).collect()
    assert [r[0] for r in racy] == [True, True, True, False, False]


def test_journal(spark):
    log = spark.createDataFrame([(1, 1, "planned"), (1, 2, "executing"), (2, 1, "planned"), (2, 2, "committed"), (3, 1, "undone"), (4, 1, "planned"), (4, 2, "executing"), (4, 3, "committed")], "op_id int, seq int, state string")
    assert {r.op_id: r.recovered for r in journal.recover(journal.current(log)).collect()} == {1: "failed", 2: "settled", 3: "undone", 4: "settled"}
    assert sorted((r.op_id, r.seq) for r in journal.illegal(log).collect()) == [(2, 2), (3, 1)]


def test_dirty_marks(spark):
    marks = spark.createDataFrame([("a", True), ("a/b", True), ("a/b/c.md", False), ("ab", False), ("d", False), ("d", True), ("e/._x", False)], "path string, recursive boolean")
    assert {(r.path, r.recursive) for r in live.subsume(marks).collect()} == {("a", True), ("ab", False), ("d", True), ("e/._x", False)}
    everything = live.subsume(marks.union(spark.createDataFrame([("", True)], marks.schema)))
    assert [tuple(r) for r in everything.collect()] == [("", True)]
    assert marks.where(live.excluded(F.col("path"))).count() == 1 and not live.storm(marks).first().rescan and live.storm(marks, 3).first().rescan


def test_deferral(spark):
    second = lambda n: datetime(2024, 1, 1, 0, 0, n)
    events = spark.createDataFrame([(second(1), "a/x"), (second(1), "b"), (second(9), "a/x"), (second(1), "c/d")], "ts timestamp, path string")
    owners = spark.createDataFrame([("a", True, second(10), second(3)), ("a/x", False, second(5), None), ("c", False, second(9), None)], "root string, subtree boolean, lease_until timestamp, retired_at timestamp")
    found = {(r.ts.second, r.path): (r.drain_at.second, r.drain_at.microsecond) for r in live.defer(events, owners).collect()}
    assert found == {(1, "a/x"): (5, 500000), (1, "b"): (1, 0), (9, "a/x"): (9, 0), (1, "c/d"): (1, 0)}


def test_detail(spark):
    from oxbow.operators import detail

    rows = spark.createDataFrame(
        [("t.csv", '{"columns":["a","b"],"row_count_reason":"size_gated"}'), ("p.parquet", '{"columns":[{"name":"k","type":"int64"}]}')], "path string, meta string"
    )
    edges = spark.createDataFrame([("d.md", "t.csv", "doc_ref"), ("t.csv", "p.parquet", "x")], "src string, dst string, kind string")
    one = detail.entry(rows, edges, "t.csv").first()
    assert (one.column_names, one.refs, one.ref_by, one.dangling) == (["a", "b"], ["p.parquet"], ["d.md"], ["d.md"])
    assert one.row_count_note.startswith("not counted") and detail.entry(rows, edges, "p.parquet").first().column_names == ["k"]
    assert detail.entry(rows, edges, "absent").count() == 0


def test_display_bytes_shows_long_documents(spark, tmp_path):
    from pyspark.sql import functions as F

    from oxbow.plans import queries

    lengths = [0, 1023, 1024, 1536, 1048575, 1048576, 3 * 1048576 + 52429]
    docs = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, n long")
    docs = docs.select("doc_id", F.expr("repeat('x', cast(n as int))").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.col("n").alias("n_chars"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    shown = sorted(r.shown for r in queries.display_bytes(spark, str(tmp_path)).collect())
    assert shown == sorted(["0 B", "1023 B", "1.0 KB", "1.5 KB", "1024.0 KB", "1.0 MB", "3.1 MB"])


def test_directory_order(spark):
    totals = spark.createDataFrame([("b", 1, 5), ("a", 1, 9), ("c", 3, 1)], "dir string, newest int, total_bytes int").withColumn("oldest", F.col("newest"))
    order = lambda by: [r.dir for r in tree.sort_directories(totals, by).collect()]
    assert order("name") == ["a", "b", "c"] and order("newest") == ["c", "a", "b"] and order("oldest") == ["a", "b", "c"]
    assert order("largest") == ["a", "b", "c"] and order("smallest") == ["c", "b", "a"]


def test_stored_links(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b", "doc_ref"), ("c", "d", "code_ref")], lineage.LINK)
    lineage.write_links(edges, str(tmp_path / "links"))
    (tmp_path / "links" / "more.json").write_text('not json\n{"src": "x"}\n')
    assert sorted(map(tuple, lineage.read_links(spark, str(tmp_path / "links")).collect())) == sorted(map(tuple, edges.collect()))
    assert lineage.read_links(spark, str(tmp_path / "nothing")).count() == 0


def test_aggregates_follow_changes(spark):
    """After each of several random changes, kept aggregates are those of a full count, nulls and ties included."""
    import random
    from datetime import datetime, timedelta

    from oxbow.operators import delta, facets, tree, upkeep

    rng, day = random.Random(4), datetime(2024, 1, 1)
    schema = "path string, category string, ext string, size_bytes long, mtime timestamp, is_symlink boolean, symlink_ok boolean, error string"

    def row(path):
        mtime = rng.choice([None, datetime(1970, 1, 1), *(day + timedelta(days=rng.randrange(6)) for _ in range(4))])
        link = rng.choice([None, False, True])
        return path, rng.choice(["a", "b", "", None]), rng.choice(["x", ""]), rng.choice([None, rng.randrange(9)]), mtime, link, rng.choice([None, True, False]) if link else None, rng.choice([None, "e"])

    rows = {p: row(p) for p in (f"{rng.choice('pqr')}/{rng.choice('st')}/{i}" for i in range(40))}
    frame = lambda values: spark.createDataFrame(list(values), schema)
    shown = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    current = frame(rows.values())
    state, counts, summary = upkeep.rollup_state(current), facets.facets(current), facets.summary(current)
    for _ in range(3):
        gone = rng.sample(sorted(rows), 8) + ["never/there"]
        new = [row(p) for p in [*rng.sample(sorted(set(rows) - set(gone)), 4), f"new/{rng.randrange(9)}", "top"]]
        rows = {p: r for p, r in rows.items() if p not in gone} | {r[0]: r for r in new}
        removed = spark.createDataFrame([(p,) for p in gone], "path string")
        changes = upkeep.signed(current, frame(new), removed)
        current = frame(rows.values())
        state = spark.createDataFrame(upkeep.rollup_after(state, changes, current).collect(), state.schema)
        counts = spark.createDataFrame(upkeep.counts_after(counts, changes).collect(), counts.schema)
        summary = spark.createDataFrame(upkeep.summary_after(summary, changes).collect(), summary.schema)
        assert shown(upkeep.rollup_of(state)) == shown(tree.rollup(current))
        assert shown(counts) == shown(facets.facets(current)) and shown(summary) == shown(facets.summary(current))
    assert delta.apply_delta(current, frame(new), removed).count() == len(rows)


def plain_plan(tree, root, budget):
    """The walk by plain recursion; tree: {folder: (own files, [child folders in order])}."""
    size = lambda d: tree[d][0] + sum(1 + size(c) for c in tree[d][1])
    below = lambda d: [d, *(x for c in tree[d][1] for x in below(c))]
    opened, closed = [], []

    def spend(d, left):
        cost = tree[d][0] + len(tree[d][1])
        if cost > left:
            closed.extend(below(d))
            return 0
        opened.append(d)
        used, later = cost, []
        for c in tree[d][1]:
            if size(c) <= left - used:
                opened.extend(below(c))
                used += size(c)
            else:
                later.append(c)
        for c in later:
            used += spend(c, left - used)
        return used

    rows = spend(root, budget)
    return sorted(opened), len(closed), rows


def test_expand_plans(spark, data):
    import random

    from oxbow.operators import expand
    from oxbow.sources import tables

    rng = random.Random(5)
    paths = {"/".join(rng.choice("abcDé") for _ in range(rng.randrange(5))) + f"/f{i}" for i in range(400)}
    paths = {p.lstrip("/") for p in paths} | {f"wide/{i:03d}/x" for i in range(90)}
    counts = expand.folder_counts(spark.createDataFrame([(p,) for p in paths], "path string")).cache()
    folders = {r.path: r for r in counts.collect()}
    key = lambda p: (p.rsplit("/", 1)[-1].lower(), p)
    tree = {p: (r.own_files, sorted((q for q, c in folders.items() if c.parent == p), key=key)) for p, r in folders.items()}
    assert folders[""].files == len(paths) and folders[""].dirs == len(folders) - 1
    for root in ("", "a", "wide"):
        for budget in (0, 3, 20, 45, 90, 120, 250, 9000):
            plan, opened = expand.expand(counts, root, budget)
            want, closed, rows = plain_plan(tree, root, min(budget, expand.CEILING))
            assert sorted(r.path for r in opened.collect()) == want and (plan.rows, plan.closed, plan.opened) == (rows, closed, len(want)), (root, budget)
            assert plan.rows <= plan.budget and plan.truncated == bool(closed) and plan.files == sum(tree[p][0] for p in want)
            assert plan.rows == plan.files + sum(len(tree[p][1]) for p in want)
    assert expand.expand(counts, "not/there")[1].count() == 0
    plan, opened = expand.expand(expand.folder_counts(tables.parts(spark, data)), budget=150)
    own = {r.path: r.own_files for r in opened.collect()}
    assert 0 < plan.rows <= 150 and "" in own and plan.files == sum(own.values()) and plan.truncated


def test_tokens_in_composed_and_decomposed_texts(spark):
    """The native pattern finds what a search in the decomposed text finds, for letters with several marks and Korean syllables too."""
    import random
    import unicodedata

    rng = random.Random(3)
    letters = ["a", "A", "e", "o", "\u00e9", "\u1ed9", "\u00f4", "\u01d6", "\u00fc", "\u0323", "\u0301", "\ud55c", "\ud558", "\uae00", "\u11ab", "1", "/", "\u212b", "\u0130"]
    word = lambda n: unicodedata.normalize(rng.choice(["NFC", "NFD"]), "".join(rng.choice(letters) for _ in range(rng.randrange(1, n))))
    texts = [word(9) for _ in range(400)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").cache()
    for token in {word(4) for _ in range(60)}:
        folded = X.nfd_token(token)
        if X._joins(folded[0]):
            continue  # no letter of its own: found where it stands decomposed or ends a composed letter
        got = {r.t for r in frame.where(X.holds(X.ascii_fold(F.col("t")), folded)).collect()}
        assert got == {t for t in texts if folded in X.nfd_token(t)}, (token, got ^ {t for t in texts if folded in X.nfd_token(t)})
