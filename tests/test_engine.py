"""A tree from scan to answer: filters, generations, refreshes, retrieval, reports, streaming."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from plumbline import cli
from plumbline.operators import retrieval
from plumbline.plans import engine, report
from plumbline.plans.engine import Engine, Evidence
from plumbline.plans.store import FactStore, StaleScan, StoreError
from plumbline.sources.tree import read_tree
from plumbline.streaming import changes

FILES = {
    "README.md": "# Demo\n\nA small demo that reads settings.\n", "src/demo/config.py": 'def load_settings(path):\n    """Reads settings."""\n    return path\n', "src/demo/main.py": "from .config import load_settings\n\nif __name__ == '__main__':\n    load_settings('x')\n",
    "tests/test_config.py": "def test_it():\n    pass\n", ".env": "A=1\n", "node_modules/x.js": "x", "a.png": "x", "big.py": "x = 1\n" * 50_000, "bin.py": "a\x00b", ".gitignore": "*.log\n", "x.log": "y", "_hidden/__init__.py": "Z = 1\n",
}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for p, t in FILES.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    (root / "link.py").symlink_to(root / "README.md")
    (root / "out.py").symlink_to("/etc/hostname")
    return root


def test_tree_source(spark, tree):
    got = {r.path: r for r in read_tree(spark, str(tree), maxFileBytes=100_000).collect()}
    reasons = {p: r.reason for p, r in got.items() if r.reason}
    assert reasons == {".env": "sensitive_filename", "node_modules": "default_ignored", "a.png": "unsupported", "big.py": "oversize", "bin.py": "binary", "x.log": "gitignored", "link.py": "symlink", "out.py": "outside_root"}
    assert got["_hidden/__init__.py"].text == "Z = 1\n" and got["src/demo/main.py"].language == "python" and len(got["README.md"].sha256) == 64
    (tree / "src" / ".gitignore").write_text("!\n")
    assert {r.path: r.reason for r in read_tree(spark, str(tree)).collect()}["src"] == "incomplete"
    assert any(r.reason == "repository_budget" for r in read_tree(spark, str(tree), maxEntries=3).collect())


@pytest.mark.parametrize("few", [0, 200])
def test_generations(spark, tree, tmp_path, monkeypatch, few):
    monkeypatch.setattr(engine, "FEW", few)  # 0: every change goes through Spark, not through the driver
    e = Engine(spark, str(tree), str(tmp_path / "store"), maxFileBytes=100_000)
    with pytest.raises(StoreError):
        e.scan("never")
    first = e.scan()
    assert (first.added, first.generation, first.revision, first.cache_hit) == (6, 1, 1, False)
    again = e.scan()
    assert again.cache_hit and (again.generation, again.revision, again.unchanged) == (1, 1, 6)
    os.utime(tree / "README.md")
    assert e.scan().cache_hit  # a touched file has no new facts
    (tree / "tests/test_config.py").unlink()
    (tree / "src/demo/config.py").write_text("def load_all(path):\n    return path\n")
    up = e.scan()
    assert (up.changed, up.removed, up.unchanged, up.generation) == (1, 1, 4, 2)
    assert [r.name for r in e.store.table("symbols").where("path LIKE '%config%'").collect()] == ["load_all"]
    (tree / "src" / ".gitignore").write_text("!\n")
    up = e.scan()
    assert (up.stale, up.removed) == (2, 0) and {r.path for r in e.store.table("files").where("stale").collect()} == {"src/demo/config.py", "src/demo/main.py"}
    (tree / "src" / ".gitignore").unlink()
    assert e.scan().changed == 2  # back from being stale
    assert e.scan("rebuild").unchanged == 5 and e.scan("never").cache_hit
    assert len(e.store.clean()) >= 1 and e.store.status()["n_files"] == 5


def test_files_are_read_once_and_only_when_changed(spark, tree, tmp_path):
    for i in range(5):
        (tree / f"m{i}.py").write_text(f"V = {i}\n")
    e = Engine(spark, str(tree), str(tmp_path / "store"), maxFileBytes=100_000)
    e.scan()
    old = os.stat(tree / "m1.py")
    (tree / "m1.py").write_text("V = 9\n")
    os.utime(tree / "m1.py", ns=(old.st_atime_ns, old.st_mtime_ns))
    assert e.scan().changed == 1  # the time of the inode tells, although size and mtime are the same
    (tree / "m2.py").chmod(0)
    assert e.scan("auto").unchanged >= 10 and e.store.status()["n_files"] == 11
    (tree / "m2.py").chmod(0o644)
    for i in range(12):  # more changes than parts
        (tree / "m3.py").write_text(f"W_{i} = 1\n\ndef f_{i}():\n    pass\n")
        assert e.scan().changed == 1
    assert [r.name for r in e.store.table("symbols").where("path = 'm3.py'").collect()] == ["f_11"] and len(e.store.pointer().parts) <= 9
    assert e.store.table("files").count() == 11 and e.store.table("files").select("path").distinct().count() == 11
    assert e.scan("rebuild").unchanged == 11 and len(e.store.pointer().parts) == 1


def test_stale_commits_are_rejected(spark, tree, tmp_path):
    store = FactStore(spark, str(tmp_path / "store"))
    base, scan = store.pointer(), read_tree(spark, str(tree))
    store.commit(scan, base)
    with pytest.raises(StaleScan):
        store.commit(scan, base)
    (tmp_path / "store" / "stray").mkdir()
    with pytest.raises(StoreError):
        store.clean()


def test_ask_map_diagram(spark, tree, tmp_path, capsys):
    e = Engine(spark, str(tree), str(tmp_path / "store"), maxFileBytes=100_000)
    e.scan()
    top = e.ask("Where is `load_settings` defined?")
    assert top[0].citation == "src/demo/config.py:1-3" and "exact symbol match" in top[0].reason
    assert any("src/demo/main.py" == x.path for x in top)
    parts = e.store.pointer().parts
    assert all(e.store.files.exists(f"{x}/terms") for x in parts)
    (tree / "src/demo/extra.py").write_text("def zebra_crossing():\n    pass\n")
    e.scan()
    assert e.ask("zebra_crossing")[0].path == "src/demo/extra.py" and len(e.store.pointer().parts) == len(parts) + 1
    rows = lambda df: sorted(map(str, df.collect()))
    whole = retrieval.indexed(e.store.table("chunks").withColumn("file_path", F.col("path")))
    assert rows(e.store.index(e.store.pointer()).select("path", "ordinal", "_terms")) == rows(whole.select("path", "ordinal", "_terms"))
    (tree / "src/demo/extra.py").unlink()
    e.scan()
    assert e.ask("zebra_crossing") == [] and e.ask("?!") == [] and e.ask("quantum chromodynamics lattice") == []
    text = e.map()
    assert text == e.map() and report.MARKER in text and "A small demo that reads settings." in text and "src/demo/main.py" in text
    assert e.diagram().startswith("flowchart LR\n  n_")
    out = tmp_path / "MAP.md"
    cli.write_generated(out, text)
    cli.write_generated(out, text)
    out.write_text("mine")
    with pytest.raises(FileExistsError):
        cli.write_generated(out, text)
    assert report.flowchart([], []).count("n_0000000000") == 1


def ev(content, path="a.py", start=1):
    return Evidence(path, start, start + content.count("\n"), content, 1.0, "r", 1)


def test_answers():
    e = [ev("def f():\n    return 1"), ev("x" * 500, "b.py")]
    assert "a.py:1-2" in report.extract(e)
    cut = report.bounded(e, 300)
    assert len(cut) == 2 and 0 < len(cut[1].content) < 500
    good = 'It returns one. [a.py:2]\n> "return 1" [a.py:2]'
    assert "(a.py#L2)" in report.validated(good, e)
    for bad in (good.replace("return 1", "return 2"), good.replace("[a.py:2]", "[a.py:9]"), "No citation.\nNothing.", good + "\nhttps://x", good.replace("one", "one\x1b[0m")):
        with pytest.raises(ValueError):
            report.validated(bad, e)
    assert report.visible("a‮b") == "a\\u202eb"


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    rows = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (1, "b", "2024-01-02 00:00:00"), (2, "c", "2024-01-01 00:00:00")], "k int, v string, at string").select("k", "v", F.to_timestamp("at").alias("ts"))
    rows.write.parquet(str(src))
    for _ in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(str(src))
        changes.follow(spark, stream, str(tmp_path / "state"), str(tmp_path / "cp"), ["k"], "ts", ["v"]).awaitTermination()
        late = spark.createDataFrame([(1, "z", "2023-01-01 00:00:00"), (3, "d", "2024-01-05 00:00:00")], "k int, v string, at string").select("k", "v", F.to_timestamp("at").alias("ts"))
        late.write.mode("append").parquet(str(src))
    got = {r.k: r.v for r in spark.read.parquet(str(tmp_path / "state" / "v-1")).collect()}
    assert got == {1: "b", 2: "c", 3: "d"}
    events = rows.select(F.col("k").alias("user_id"), "ts", F.col("v").alias("event_type"), F.lit(1.0).alias("value"))
    assert changes.windowed_counts(events).count() == 3 and changes.sessions(events).count() == 3


def test_another_tree_under_the_same_name_starts_anew(spark, tree, tmp_path):
    e = Engine(spark, str(tree), str(tmp_path / "store"), maxFileBytes=100_000)
    first = e.scan()
    tree.rename(tmp_path / "old")
    tree.mkdir()
    (tree / "only.py").write_text("X = 1\n")
    again = Engine(spark, str(tree), str(tmp_path / "store"))
    up = again.scan()
    assert (up.added, up.removed) == (1, 0) and up.generation > first.generation and again.store.status()["n_files"] == 1


def test_command_line(spark, tree, tmp_path, capsys):
    (tmp_path / "user.toml").write_text('limit = 3\n[synonyms]\nsetup = ["settings"]\n')
    (tree / "plumbline.toml").write_text("limit = 2\nmax_file_bytes = 100000\n")
    run = lambda *a: (cli.main([*a, "--store", str(tmp_path / "store"), "--settings", str(tmp_path / "user.toml")]), capsys.readouterr().out)[1]
    run("scan", str(tree))
    told = json.loads(run("doctor", str(tree)))
    assert told["facts_fit"] and told["root_readable"] and told["synonyms"] == 1 and set(told["components"]) == {"parsers", "format", "chunks", "terms"}
    assert "src/demo/config.py" in run("ask", str(tree), "load_settings")
    assert "| Module |" in run("diagram", str(tree), "--evidence") and "flowchart LR" in run("diagram", str(tree))


def test_records_have_no_line_ends():
    assert " " not in report.record(ev("a b")) and "\\u2028" in report.record(ev("a b"))
