import hashlib
import gzip
import json
import os
import time
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from oxbow.operators import digest, lineage, search
from oxbow.sources import catalogue, extract, tree, workbooks


@pytest.fixture()
def root(tmp_path):
    def put(name, text):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())

    put("tables/cells.csv", 'gene,score,label\na,1,"x\ny"\nb,2,z\nc,3,w\n')
    put("tables/cells.csv.gz", gzip.compress(b"gene,score\na,1\nb,2\n"))
    put("tables/empty.tsv", "")
    pq.write_table(pa.table({"k": [1, 2], "s": ["a", "b"]}), tmp_path / "tables" / "t.parquet")
    os.makedirs(tmp_path / "data")
    np.save(tmp_path / "data" / "small.npy", np.zeros((7, 5), "<f4"))
    np.savez(tmp_path / "data" / "bundle.npz", alpha=np.zeros((3, 4)), beta=np.zeros(10, "<i4"))
    put("data/broken.npy", "no array")
    put("conf/params.yaml", "a: 1\nb:\n  c: 2\nd: [1]\ne: x\n")
    put("conf/params.toml", "x = 1\n[y]\nz = 2\n")
    put("conf/list.json", "[1, 2, 3]")
    put("conf/word.json", '"word"')
    put("code/module.py", '"""First line.\n\nMore."""\nimport os, sys\nfrom .a import b\ndef f(): pass\nclass C: pass\nx = 1\n')
    put("code/script.sh", "#!/bin/bash\n# Reads data/small.npy now\necho\n")
    put("code/model.R", "#' Fits it\nlibrary(dplyr)\nfit <- function(x) x\n")
    put("docs/README.md", "# Title\n\nFirst paragraph\nhere. See [cells](../tables/cells.csv) and `small.npy` and [web](https://x.org/a).\n\n```\n# not a title\n```\n")
    put("fig/plot.svg", '<svg><text x="1">HMGCR cells</text><text>12.5</text></svg>')
    put("fig/glyphs.svg", '<svg><g id="text_1"><use xlink:href="#DejaVu-41"/><use xlink:href="#DejaVu-62"/></g></svg>')
    put("book.ipynb", json.dumps({"cells": [{"cell_type": "markdown", "source": ["# Book\n"]}, {"cell_type": "code", "source": []}], "metadata": {"kernelspec": {"name": "py"}}}))
    put("._shadow", "junk")
    put("_vendor/vendored.py", "x = 1")
    put("sub/.hidden", "h")
    os.makedirs(tmp_path / "links")
    os.symlink("../tables/cells.csv", tmp_path / "links" / "good.csv")
    os.symlink("nowhere", tmp_path / "links" / "broken.csv")
    os.symlink("../data", tmp_path / "links" / "folder")
    _workbook(tmp_path / "tables" / "book.xlsx")
    return str(tmp_path)


def _workbook(path):
    ns, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="Main" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>gene</t></si><si><t>score</t></si></sst>')
        rows = '<row><c t="s"><v>0</v></c><c t="s"><v>1</v></c></row><row><c><v>1</v></c><c><v>2</v></c></row>'
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData>{rows}</sheetData></worksheet>')


@pytest.mark.parametrize("splits", ["1", "4", "64"])
def test_walk(spark, root, splits):
    rows = {r.path: r for r in tree.walk(spark, root, splits=splits).collect()}
    assert {"tables/cells.csv", "links/good.csv", "links/broken.csv", "links/folder", "sub/.hidden", "book.ipynb"} <= set(rows)
    assert not any("_shadow" in p or "_vendor" in p or p.startswith("links/folder/") for p in rows)
    assert rows["links/good.csv"].is_symlink and rows["links/good.csv"].symlink_ok and not rows["links/broken.csv"].symlink_ok
    assert rows["tables/cells.csv.gz"].ext == "csv.gz" and rows["tables/cells.csv.gz"].category == "data_table"
    assert rows["sub/.hidden"].ext == "" and rows["sub/.hidden"].symlink_ok is None
    assert all(r.error is None for r in rows.values())


def test_walk_rules(spark, root):
    paths = lambda **o: {r.path for r in tree.walk(spark, root, **o).collect()}
    assert paths(include="*.csv") == {"tables/cells.csv", "links/good.csv", "links/broken.csv"}
    assert not any(p.startswith("tables") for p in paths(exclude="tables"))
    assert not any(p.startswith("conf") for p in paths(prune="conf")) and not any(p.startswith("fig") for p in paths(out="fig"))
    with pytest.raises(Exception, match="No such file"):
        paths_of_missing = tree.walk(spark, root + "/absent").collect()
        assert not paths_of_missing


def test_metadata(spark, root):
    rows = {r.path: r for r in catalogue.build(spark, root).collect()}
    meta = {p: json.loads(r.meta) for p, r in rows.items()}
    assert meta["tables/cells.csv"] == {"columns": ["gene", "score", "label"], "n_columns": 3, "delimiter": ",", "row_count": 3, "row_count_exact": True}
    assert (rows["tables/cells.csv.gz"].n_obs, rows["tables/cells.csv.gz"].n_vars) == (2, 2)
    assert meta["tables/empty.tsv"]["row_count_reason"] == "empty"
    assert meta["tables/t.parquet"]["columns"] == [{"name": "k", "type": "int64"}, {"name": "s", "type": "string"}] and rows["tables/t.parquet"].n_obs == 2
    assert meta["tables/book.xlsx"]["sheet_names"] == ["Main"] and meta["tables/book.xlsx"]["columns"] == ["gene", "score"] and rows["tables/book.xlsx"].n_obs == 1
    assert meta["data/small.npy"] == {"shape": [7, 5], "dtype": "<f4", "fortran_order": False}
    assert meta["data/bundle.npz"]["members"]["beta"] == {"shape": [10], "dtype": "<i4"}
    assert rows["data/broken.npy"].error.startswith("ValueError") and meta["data/broken.npy"] == {}
    assert meta["conf/params.yaml"]["top_level_keys"] == ["a", "b", "d", "e"] and meta["conf/params.toml"]["n_keys"] == 2
    assert meta["conf/list.json"] == {"length": 3} and meta["conf/word.json"] == {"json_type": "str"}
    assert meta["code/module.py"] == {"docstring_first_line": "First line.", "defs": ["f"], "classes": ["C"], "imports": ["os", "sys", ".a"]}
    assert meta["code/model.R"] == {"functions": ["fit"], "libraries": ["dplyr"], "roxygen_title": "Fits it"}
    assert meta["code/script.sh"] == {"shebang": "#!/bin/bash", "first_comment": "Reads data/small.npy now"}
    assert meta["docs/README.md"]["h1_title"] == "Title" and meta["docs/README.md"]["outbound_refs"] == ["../tables/cells.csv", "https://x.org/a", "small.npy"]
    assert meta["docs/README.md"]["first_paragraph"].startswith("First paragraph here.")
    assert meta["book.ipynb"] == {"n_cells": 2, "n_code": 1, "n_markdown": 1, "kernel": "py", "first_title": "Book"}
    assert rows["fig/plot.svg"].figure_text == "hmgcr cells" and meta["fig/plot.svg"] == {} and rows["fig/glyphs.svg"].figure_text == "ab"
    assert "columns" not in json.loads({r.path: r for r in catalogue.build(spark, root, columns=False).collect()}["tables/cells.csv"].meta)


def test_search_and_lineage_on_a_tree(spark, root):
    built = catalogue.build(spark, root, tags=[("cells", "cell")]).cache()
    paths = lambda df: {r.path for r in df.collect()}
    assert paths(search.search(built, "hmgcr")) == set() and paths(search.search(built, "HMGCR", figure_text=True)) == {"fig/plot.svg"}
    assert paths(search.search(built, "fig:hmgcr")) == {"fig/plot.svg"} and paths(search.search(built, "ext:npy cat:data")) == {"data/small.npy", "data/broken.npy"}
    assert paths(search.filter_files(built, broken=True)) == {"links/broken.csv"} and paths(search.filter_files(built, errors=True)) == {"data/broken.npy"}
    edges, dangling = lineage.graph(built)
    assert {(r.src, r.dst) for r in edges.collect()} >= {("docs/README.md", "tables/cells.csv"), ("docs/README.md", "data/small.npy"), ("code/script.sh", "data/small.npy")}
    assert built.where("array_contains(tags, 'cell')").count() == 2
    assert digest.row_digest(built).first() == digest.row_digest(built.repartition(3)).first() and digest.row_digest(built).first().n_rows == built.count()


def test_digest_of_a_hand_made_catalogue(spark):
    """Hashes written out by hand: times do not count, nor do blanks and order in metadata."""
    rows = [("a.md", 3, "doc", '{"b": 1, "a": [2]}', 5.0), ("b", None, None, None, 6.0)]
    frame = spark.createDataFrame(rows, "path string, size_bytes long, extractor string, meta string, mtime double")
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    one, two = sha('+4:a.md+1:3+3:doc+15:{"a":[2],"b":1}'), sha("+1:b--+2:{}")
    assert one[:4] != two[:4]
    want = sha("".join(sha(h) for h in sorted((one, two))))
    assert tuple(digest.row_digest(frame).first()) == (2, want)
    again = [("b", None, None, "{}", 7.0), ("a.md", 3, "doc", '{"a":[2],"b":1}', 8.0)]
    assert tuple(digest.row_digest(spark.createDataFrame(again, frame.schema)).first()) == (2, want)


def test_incremental_build_and_store(spark, root, tmp_path_factory):
    store = catalogue.Store(spark, str(tmp_path_factory.mktemp("store")))
    assert store.generation() is None and store.age_seconds() is None
    store.publish(catalogue.build(spark, root))
    first = store.read()
    with open(f"{root}/tables/new.csv", "w") as f:
        f.write("a,b\n1,2\n")
    os.remove(f"{root}/book.ipynb")
    again = catalogue.build(spark, root, prior=first)
    fresh = catalogue.build(spark, root)
    as_rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert as_rows(again) == as_rows(fresh)
    assert store.publish(again) == 2 and store.generation() == 2 and store.read(1).count() == first.count() and store.age_seconds() < 60


def test_interchange(spark, root, tmp_path_factory):
    built = catalogue.build(spark, root).cache()
    folder = str(tmp_path_factory.mktemp("x"))
    catalogue.write_jsonl(built, f"{folder}/jsonl")
    lines = [line for p in sorted(os.listdir(f"{folder}/jsonl")) if p.startswith("part") for line in open(f"{folder}/jsonl/{p}").read().splitlines()]
    assert [json.loads(x)["path"] for x in lines] == sorted(r.path for r in built.collect())
    back = {r.path: r for r in catalogue.read_jsonl(spark, f"{folder}/jsonl").collect()}
    assert all(json.loads(back[r.path].meta) == json.loads(r.meta) and back[r.path].size_bytes == r.size_bytes for r in built.collect())
    with open(f"{folder}/bad.jsonl", "w") as f:
        f.write(lines[0] + "\n\nnot json\n" + lines[1] + "\n")
    assert catalogue.read_jsonl(spark, f"{folder}/bad.jsonl").count() == 2
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        catalogue.read_jsonl(spark, f"{folder}/bad.jsonl", strict=True).collect()
    with open(f"{folder}/INDEX.json", "w") as f:
        json.dump({"schema_version": "1.0", "entries": [json.loads(x) for x in lines]}, f)
    assert catalogue.read_index(spark, f"{folder}/INDEX.json").count() == len(lines)
    asked = spark.createDataFrame([('{"path": "tables/cells.csv"}',), ("oops",), ('{"path": 3}',), ('{"path": "absent.md"}',), (" ",)], "value string")
    found = {r.value: r for r in extract.describe_requests(asked, root).collect()}
    assert len(found) == 4 and found['{"path": "tables/cells.csv"}'].error is None and all(found[v].error for v in found if "cells" not in v)
    assert catalogue.lean(built, 2).where("path = 'tables/cells.csv'").select("columns", "n_columns_total").first() == (["gene", "score"], 3)


def test_lean_rows_and_index(spark, root, tmp_path):
    meta = json.dumps({"columns": [f"c{i}" for i in range(60)], "defs": ["a"], "first_paragraph": "x" * 700})
    row = catalogue.lean(spark.createDataFrame([("p", meta)], "path string, meta string")).first()
    assert len(row["columns"]) == 48 and row["n_columns_total"] == 60 and row["defs"] == ["a"] and row["n_defs_total"] is None
    assert row["first_paragraph"] == "x" * 600 + "…" and row["n_layers_total"] is None
    built = catalogue.build(spark, root)
    path = str(tmp_path / "INDEX.json")
    catalogue.write_index(built, "d1", path)
    document = json.load(open(path))
    assert document["content_digest"] == catalogue.peek(spark, path) == "d1" and [e["path"] for e in document["entries"]] == sorted(r.path for r in built.collect())
    assert sum(document["summary"]["by_category"].values()) == sum(document["summary"]["by_ext"].values()) == built.count()
    rows = lambda df: sorted(str(r.asDict() | {"meta": json.loads(r.meta)}) for r in df.collect())
    assert rows(catalogue.read_index(spark, path)) == rows(catalogue.entries_of(built)) and os.listdir(tmp_path).count("INDEX.json.parts") == 0
    catalogue.write_index(built.limit(0), "d2", path)  # replaced whole
    assert json.load(open(path))["entries"] == [] and catalogue.read_index(spark, path).count() == 0 and catalogue.peek(spark, path) == "d2"



def test_digests_find_the_segments_that_differ(spark, tmp_path):
    """Equal roots read no row of the store; a change reads its own segment alone."""
    meta = lambda i: json.dumps({"k": i, "a": [1]})
    rows = [(f"d{i % 5}/{i:03d}", i, "doc", meta(i), i % 7 == 0, i % 14 == 0) for i in range(100)]
    schema = "path string, size_bytes long, extractor string, meta string, is_symlink boolean, symlink_ok boolean"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    store = catalogue.Store(spark, str(tmp_path / "store"), segment_rows=12)
    store.publish(frame(rows))
    one = catalogue.Store(spark, str(tmp_path / "one"))
    one.publish(frame(rows[::-1]))
    assert store.digest() == one.digest() and len(store.entry()["segments"]) >= 8 and len(one.entry()["segments"]) == 1
    reads, read = [], store.read
    store.read = lambda generation=None, only=None: reads.append(only) or read(generation, only)
    blanks = [(p, n, x, json.dumps({"a": [1], "k": i}, indent=1), s, ok) for i, (p, n, x, m, s, ok) in enumerate(rows)]
    changes, differ = store.compare(frame(blanks))
    assert (changes.collect(), differ, reads) == ([], [], [[]])
    other = [r for r in rows if r[0] != "d2/002"] + [("d2/0021", 1, "doc", "{}", False, None)]
    other = [(p, n, x, m, s, True if p == "d4/049" else ok) for p, n, x, m, s, ok in other]
    changes, differ = store.compare(frame(other))
    assert sorted(map(tuple, changes.collect())) == [("d2/002", "removed"), ("d2/0021", "added"), ("d4/049", "repaired")]
    assert len(differ) <= 3 and reads[-1] == differ
    assert store.refresh(frame(other)) and not store.refresh(frame(other))
    one.publish(frame(other))
    assert store.digest() == one.digest()
    places = [{s.place for s in store.entry(g)["segments"]} for g in (1, 2)]
    assert len(places[0] - places[1]) == len(differ)


def test_queries_look_first_when_the_last_look_is_old(spark, root, tmp_path_factory, capsys):
    from oxbow.__main__ import main

    place = str(tmp_path_factory.mktemp("kept"))
    store = catalogue.Store(spark, place)
    main(["build", root, place], spark)
    with open(f"{root}/late.csv", "w") as f:
        f.write("a\n1\n")
    capsys.readouterr()
    ask = lambda *o: (main(["query", place, "late.csv", "--count", *o], spark), capsys.readouterr())[1]
    assert ask().out.split() == ["0"] and store.generation() == 1  # younger than ten seconds
    assert ask("--fresh", "0").out.split() == ["1"] and store.generation() == 2
    assert ask("--fresh", "0").out.split() == ["1"] and store.generation() == 2 and store.age_seconds() < 10  # looked, found nothing
    os.rename(root, root + "-away")
    try:
        gone = ask("--fresh", "0")
        assert gone.out.split() == ["1"] and "not refreshed" in gone.err and store.generation() == 2
    finally:
        os.rename(root + "-away", root)
    assert main(["check", root, place], spark) == 0
    os.remove(f"{root}/late.csv")
    assert main(["check", root, place], spark) == 1 and "removed\tlate.csv" in capsys.readouterr().out


def test_walk_in_rounds(spark, tmp_path):
    """A wide folder and a deep chain in many small rounds: the rows of the lazy source, and every task takes part."""
    for i in range(300):
        (tmp_path / "tree" / "wide" / f"f{i}").mkdir(parents=True)
        (tmp_path / "tree" / "wide" / f"f{i}" / "x.md").write_text("x")
    deep = tmp_path / "tree"
    for i in range(60):
        deep = deep / f"d{i}"
        deep.mkdir()
        (deep / "y.md").write_text("y")
    root = str(tmp_path / "tree")
    found = list(tree.rounds(spark, root, budget=20))
    rows = [tuple(r) for part in found for r in part.where("not closed").drop("closed").collect()]
    spark.dataSource.register(tree.TreeSource)
    lazy = spark.read.format("oxbow-tree").load(root)
    assert sorted(rows) == sorted(map(tuple, lazy.collect())) and len(rows) == 360 and len(found) > 3
    tasks = found[1].where("not closed").select(F.spark_partition_id()).distinct().count()
    assert tasks >= 8
    marks = spark.createDataFrame([("wide/f7",), ("wide/f7/x.md",), ("gone",), ("d0/d1/d2/y.md",), ("wide/f8/nothing",)], "path string")
    assert {r.path for r in tree.walk(spark, root, start=marks).collect()} == {"wide/f7/x.md", "d0/d1/d2/y.md"}
    assert tree.walk(spark, root, start=marks).count() == 2
    assert tree.walk(spark, root, start=spark.createDataFrame([("wide/f7/x.md",)], "path string"), prune="wide").count() == 0


# Workbooks


def put_book(path, sheets, strings=(), rels=True):
    """sheets: (name, part, rows of cells, declared range); a cell is a number of a string, ("inline", text), a text value or None."""
    ns, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def cell(c):
        if c is None:
            return "<c/>"
        if isinstance(c, int):
            return f'<c t="s"><v>{c}</v></c>'
        return f'<c t="inlineStr"><is><t>{c[1]}</t></is></c>' if isinstance(c, tuple) else f"<c><v>{c}</v></c>"

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        listed = "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, (n, *_) in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>')
        if rels:
            z.writestr("xl/_rels/workbook.xml.rels", "<R>" + "".join(f'<Relationship Id="r{i}" Target="{p}"/>' for i, (_, p, *_) in enumerate(sheets)) + "</R>")
        if strings:
            with z.open("xl/sharedStrings.xml", "w") as f:
                f.write(f'<sst xmlns="{ns}">'.encode())
                for text in strings:
                    f.write(f"<si>{text}</si>".encode())
                f.write(b"</sst>")
        for _, part, rows, declared in sheets:
            dimension = f'<dimension ref="{declared}"/>' if declared else ""
            body = "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows)
            z.writestr(f"xl/{part}", f'<worksheet xmlns="{ns}">{dimension}<sheetData>{body}</sheetData></worksheet>')


def t(*texts):
    return [f"<t>{x}</t>" for x in texts]


def test_workbooks(tmp_path):
    path = str(tmp_path / "b.xlsx")
    one = lambda rows, strings=(), declared=None, counted=workbooks.COUNTED: (put_book(path, [("S", "worksheets/sheet1.xml", rows, declared)], strings), workbooks.describe_workbook(path, counted))[1]
    found = one([[0, 1], ["1", "2"], ["3", "4"]], t(" gene ", "score"))
    assert found["columns"] == ["gene", "score"] and (found["n_columns"], found["row_count"], found["row_count_exact"]) == (2, 2, True)
    assert found["primary_sheet"] == "S" and found["sheets"][0] == {"name": "S", "columns": ["gene", "score"], "n_columns": 2, "row_count": 2, "row_count_exact": True}
    banner = one([[0, None, None], [("inline", "a"), ("inline", "b")], ["1", "2"]], t("Table 3. All of it"))
    assert banner["columns"] == ["a", "b"] and banner["row_count"] == 1
    single = one([[("inline", "only")], ["1"], ["2"]])
    assert single["columns"] == ["only"] and single["row_count"] == 2
    lone = one([[("inline", "only")], *([str(i)] for i in range(20))])  # no head within the first rows
    assert lone["columns"] == ["only"] and lone["row_count"] == 20
    assert one([])["row_count_reason"] == "empty" and one([])["row_count"] == 0
    rows = [[("inline", "a"), ("inline", "b")], *(["1", "2"] for _ in range(50))]
    gated = one(rows, declared="A1:B51", counted=10)
    assert (gated["row_count"], gated["row_count_exact"], gated["row_count_reason"], gated["columns"]) == (50, False, "size_gated", ["a", "b"])
    assert one(rows, counted=10)["row_count_reason"] == "no_dimension" and one(rows, counted=10)["row_count"] is None
    rich = one([[1, 0, 2]], ["<r><t>bo</t></r><r><t>ld</t></r>", "<t>x &amp; y</t>", "<t></t>"])
    assert rich["columns"] == ["x & y", "bold", ""]
    put_book(path, [("Second", "worksheets/sheet2.xml", [[("inline", "q"), ("inline", "r")]], None), ("First", "worksheets/sheet1.xml", [[("inline", "z")]], None)])
    two = workbooks.describe_workbook(path)
    assert two["sheet_names"] == ["Second", "First"] and two["sheets"][0]["columns"] == ["q", "r"] and "columns" not in two and "primary_sheet" not in two
    put_book(path, [(f"s{i}", f"worksheets/sheet{i + 1}.xml", [["1", "2"]], None) for i in range(70)], rels=False)
    many = workbooks.describe_workbook(path)
    assert many["n_sheets"] == 70 and many["sheets"][63]["row_count"] == 0 and many["sheets"][64]["row_count_reason"] == "sheet_cap"
    (tmp_path / "~$lock.xlsx").write_bytes(b"no archive")
    assert workbooks.describe_workbook(str(tmp_path / "~$lock.xlsx")) == {}
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<w><sheet name="broken"/></w>')
        z.writestr("xl/worksheets/sheet1.xml", "<worksheet><row><c>")
    assert workbooks.describe_workbook(path)["sheets"][0]["row_count_reason"] == "read_error"


def test_a_workbook_of_many_strings_takes_little_memory(tmp_path):
    """A hundred megabytes of shared strings, of which the head names two."""
    import tracemalloc

    path = str(tmp_path / "big.xlsx")
    put_book(path, [("S", "worksheets/sheet1.xml", [[3, 99_000], ["1", "2"]], None)], (f"<t>{i:06d}{'x' * 1000}</t>" for i in range(100_000)))
    tracemalloc.start()
    found = workbooks.describe_workbook(path)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [c[:6] for c in found["columns"]] == ["000003", "099000"] and peak < 8e6


# Isolation and order


def test_readers_that_hang_or_die_cost_their_own_files(spark, tmp_path):
    names = [f"{i:03d}.{'hang' if i == 31 else 'die' if i in (7, 60) else 'bad' if i == 9 else 'ok'}" for i in range(90)]
    for name in names:
        (tmp_path / name).write_text(name)

    def hang(path):
        import time

        time.sleep(600)

    def die(path):
        os._exit(7)

    def bad(path):
        raise ValueError("unreadable")

    readers = {"hang": ("hang", hang), "die": ("die", die), "bad": ("bad", bad), "ok": ("ok", lambda path: {"size": os.path.getsize(path)})}
    began = time.time()
    found = {r.path: r for r in extract.describe(tree.walk(spark, str(tmp_path)).coalesce(2), str(tmp_path), readers, limit=3).collect()}
    assert time.time() - began < 60 and len(found) == 90
    errors = {p: r.error for p, r in found.items() if r.error}
    assert errors == {"007.die": "ReaderDied: exit code 7", "009.bad": "ValueError: unreadable", "031.hang": "TimeoutError: no answer within 3 s", "060.die": "ReaderDied: exit code 7"}
    assert all(json.loads(r.meta) == {"size": 6} for p, r in found.items() if p not in errors)


def test_answers_come_in_the_order_of_the_requests(spark, tmp_path, capsys):
    from oxbow.__main__ import main

    for i in range(50):
        (tmp_path / f"{i}.json").write_text(json.dumps({f"key{i}": 1}))
    lines = [json.dumps({"path": f"{(i * 37) % 60}.json"}) for i in range(60)] + ["", "oops", '{"path": "0.json"}']
    (tmp_path / "requests.txt").write_text("\n".join(lines))
    asked = spark.read.text(str(tmp_path / "requests.txt")).repartition(1)
    spread = spark.createDataFrame(spark.sparkContext.parallelize([(v,) for v in lines], 7), "value string")
    for frame in (asked, spread):
        found = extract.describe_requests(frame, str(tmp_path)).collect()
        assert [r.value for r in found] == [v for v in lines if v] and [r.line for r in found] == [i for i, v in enumerate(lines) if v]
        for r in found:
            number = r.path and r.path.split(".")[0]
            assert (json.loads(r.meta)["top_level_keys"] == [f"key{number}"]) if r.path else r.error
    assert extract.describe_requests(spread.limit(0), str(tmp_path)).collect() == []
    main(["extract", str(tmp_path), str(tmp_path / "requests.txt")], spark)
    out = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [r["value"] for r in out] == [v for v in lines if v]


def test_one_document_is_read_by_many_tasks(spark, tmp_path):
    """Every cut falls somewhere: in strings with braces, quotes and backslashes, in nested values, across entries longer than a range."""
    entries = [
        {"path": f"a/{i}", "size_bytes": i, "tags": ["x{", '"}', "\\"], "meta": {"k": ["}", {"q": '\\"{[', "n": [[1], {}]}], "é": "ü" * (i % 7), "long": "]" * (900 if i % 50 == 3 else 0)}}
        for i in range(200)
    ]
    path = str(tmp_path / "INDEX.json")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for size, indent in (("97b", None), ("251b", 1), ("1000b", None), ("128m", 2)):
            with open(path, "w") as f:
                json.dump({"a": {"b": [{"c": 1}], "d": "[{"}, "entries": entries, "summary": {"n": {"x": {"y": "}"}}}, "z": []}, f, indent=indent, ensure_ascii=indent is None)
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            read = catalogue.read_index(spark, path)
            found = {r.path: (r.size_bytes, r.tags, json.loads(r.meta)) for r in read.collect()}
            assert found == {e["path"]: (e["size_bytes"], e["tags"], e["meta"]) for e in entries}, size
            assert spark.read.text(path, lineSep="}").rdd.getNumPartitions() > 100 or size in ("1000b", "128m")
        with open(path, "w") as f:
            f.write('{"entries": [{"path": "a"}, {"path": 3, "size_bytes": "many"}]}')
        with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
            catalogue.read_index(spark, path).collect()
        assert [r.path for r in catalogue.read_index(spark, path, strict=False).collect()][:1] == ["a"]
        with open(path, "w") as f:
            f.write('{"entries": [{"path": "a"}, {"nothing": 1}]}')
        with pytest.raises(Exception, match="no path"):
            catalogue.read_index(spark, path).collect()
        with open(path, "w") as f:
            f.write('{"entries": [{"path": "a"}, {"pa')
        with pytest.raises(ValueError, match="no whole document"):
            catalogue.read_index(spark, path)
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
