import os

from oxbow.__main__ import main


def test_build_query_check_report(spark, tmp_path, capsys):
    root, store = tmp_path / "tree", str(tmp_path / "store")
    os.makedirs(root / "docs")
    (root / "docs" / "a.md").write_text("# A\n\nSee [table](../t.csv).\n")
    (root / "t.csv").write_text("x,y\n1,2\n")
    os.symlink("nowhere", root / "lost.csv")

    def run(*argv):
        code = main(list(argv), spark)
        return code, capsys.readouterr().out.strip().splitlines()

    assert run("build", str(root), store) == (0, ["1"])
    assert run("query", store, "cat:data_table", "--count") == (0, ["2"])
    assert run("query", store, "ext:csv", "--sort", "largest", "--limit", "1")[1] == ["t.csv\tdata_table\t8"]
    assert run("find", store, "--broken")[1][0].startswith("lost.csv")
    assert run("check", str(root), store) == (0, [])
    (root / "t.csv").write_text("x,y,z\n1,2,3\n")
    os.remove(root / "lost.csv")
    (root / "new.md").write_text("# N\n")
    code, lines = run("check", str(root), store)
    assert code == 1 and lines == ["removed\tlost.csv", "added\tnew.md", "changed\tt.csv", "repaired\tlost.csv"]
    assert run("refresh", str(root), store) == (0, ["2"]) and run("check", str(root), store) == (0, [])
    text = "\n".join(run("report", store)[1])
    assert "3 files" in text and "| doc | 2 |" in text
    assert run("links", store)[1] == ["digraph lineage {", '  "docs/a.md" -> "t.csv";', "}"]
    assert run("export", store, str(tmp_path / "out"))[0] == 0 and any(f.startswith("part") for f in os.listdir(tmp_path / "out"))
