from __future__ import annotations

import ast

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import terms as T
from plumbline.functions import text as X
from plumbline.functions.paths import clean_path
from plumbline.operators import facts, filters, graph, retrieval, vectors, windows
from plumbline.operators.skew import join_split_hot


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    "path, reason",
    [("a/node_modules/b.js", "default_ignored"), ("a/BUILD/x.py", "default_ignored"), ("x.min.js", "default_ignored"), (".env", "sensitive_filename"), (".env.example", None), ("k/id_rsa", "sensitive_filename"), ("a/.ssh/k.pub", "unsupported"), ("a/.ssh/config", "sensitive_filename"), ("gcp-credentials.json", "sensitive_filename"), ("a.png", "unsupported"), ("CMakeLists.txt", None), ("README.rst", None), ("a.H", None)],
)
def test_skip_reasons(spark, path, reason):
    assert one(spark, filters.skip_reason(F.col("p"), F.lit(1), F.lit("x"), 10), p=path) == reason


def test_skip_reasons_of_contents(spark):
    r = lambda text, size=1: one(spark, filters.skip_reason(F.lit("a.py"), F.lit(size), F.col("t"), 10), t=text)
    assert [r("x", 11), r(None), r("a\x01"), r("x = 'ghp_" + "a" * 36 + "'"), r("x")] == ["oversize", "unreadable", "binary", "likely_secret", None]


def test_terms(spark):
    assert one(spark, T.query_terms(F.col("t")), t="Where is HTTPClient in loadConfigValue src_path?") == ["httpclient", "loadconfigvalue", "src_path", "http", "client", "load", "config", "value", "src", "path"]
    assert one(spark, T.morph_variants(F.col("t")), t="stopped") == ["stopp", "stoppe", "stop"]
    assert [one(spark, T.morph_variants(F.col("t")), t=t) for t in ("queries", "files", "class", "is")] == [["query"], ["file"], [], []]
    assert one(spark, T.cjk_grams(F.col("t")), t="中文字 a 字") == ["中文", "文字", "中文字", "字"]
    assert one(spark, T.exact_terms(F.col("t")), t="Straße ﬁne") == ["strasse", "fine"]


def test_text_functions(spark):
    for text, n in (("", 0), ("a", 1), ("a\n", 1), ("a\n\n", 2)):
        assert one(spark, X.line_count(F.col("t")), t=text) == n
    assert one(spark, X.first_nonblank_line(F.col("t")), t="\n \t\nx") == 3 and one(spark, X.first_nonblank_line(F.col("t")), t="") == 1
    assert one(spark, X.citation(F.col("p"), F.lit(2), F.lit(2)), p="a") == "a:2" and one(spark, X.citation(F.col("p"), F.lit(2), F.lit(5)), p="a") == "a:2-5"
    assert set(one(spark, X.path_aliases(F.col("p")), p="pkg/Sub/__init__.py")) >= {"pkg.sub", "sub", "pkg/sub/__init__.py", "pkg.sub.__init__"}
    assert [one(spark, X.module_group(F.col("p")), p=p) for p in ("main.py", "src/a/b/c/d.py", "x/y.py")] == ["main", "a.b", "x"]
    assert one(spark, clean_path(F.col("p")), p="./a\\..//b/./c") == "b/c" and one(spark, clean_path(F.col("p")), p="../..") == "" and one(spark, clean_path(F.col("p")), p=None) is None


def test_running_sum_equals_a_window(spark):
    rows = [("g" if i % 3 else "h", i, i % 7) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, k int, v int")
    got = {(r.g, r.k): r.running for r in windows.running_sum(df, "g", [F.col("k")], "v").collect()}
    want, sums = {}, {"g": 0, "h": 0}
    for g, k, v in rows:
        sums[g] += v
        want[g, k] = sums[g]
    assert got == want and windows.running_sum(df.limit(0), "g", [F.col("k")], "v").count() == 0


def test_hot_keys_are_joined_whole(spark):
    facts_ = spark.range(1000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"), "id")
    dims = facts_.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    out = join_split_hot(facts_, dims, ["k"], F.col("n"), 1000, 0.1)
    assert out.count() == 1000 and out.where("k = 'hot'").select("n").distinct().collect()[0][0] == 500


def test_sections_keys_and_gaps(spark):
    files = spark.createDataFrame([(1, "markdown", "# A\nx\n## B\ny\n# C\n"), (2, "config", "[s]\na = 1\nb: 2\n"), (3, "python", "1\n2\n3\n4\n5\n"), (4, "markdown", None)], "file_id long, language string, text string").withColumns({"repo": F.lit("r"), "path": F.lit("p")})
    assert sorted(map(tuple, facts.section_ranges(files).select("title", "start_line", "end_line").collect())) == [("A", 1, 4), ("B", 3, 4), ("C", 5, 5)]
    assert sorted(map(tuple, facts.config_keys(files).select("name", "start_line", "end_line").collect())) == [("a", 2, 2), ("b", 3, 3), ("s", 1, 1)]
    regions = spark.createDataFrame([(1, 3, 2, 3), (2, 3, 2, 2), (3, 3, 9, 99), (4, 3, None, 1)], "region_id long, file_id long, start_line int, end_line int").withColumn("symbol", F.lit(None).cast("string"))
    assert sorted(map(tuple, facts.gaps(regions, files).collect())) == [(3, 1, 1), (3, 4, 5)]


def test_imports_resolve_in_all_forms(spark):
    files = spark.createDataFrame([(1, "r", p, lang, t) for p, lang, t in (
        ("src/app/main.py", "python", "from .util import x\nimport lib.tools\nimport os\n"), ("src/app/util.py", "python", ""), ("lib/tools.py", "python", ""),
        ("web/a.ts", "typescript", "import {b} from './b'\nimport c from \"../shared/c\"\n"), ("web/b.ts", "typescript", ""), ("shared/c.ts", "typescript", ""), ("core/d.rs", "rust", "use crate::core::e;\n"), ("core/e.rs", "rust", ""), ("n/x.c", "c", '#include "y.h"\n'), ("n/y.h", "c", ""))], "file_id long, repo string, path string, language string, text string")
    edges = retrieval.resolved_edges(facts.dependencies(files), files)
    assert sorted((r.source_path, r.target_path) for r in edges.collect()) == [("core/d.rs", "core/e.rs"), ("n/x.c", "n/y.h"), ("src/app/main.py", "lib/tools.py"), ("src/app/main.py", "src/app/util.py"), ("web/a.ts", "shared/c.ts"), ("web/a.ts", "web/b.ts")]
    got = {(r.source, r.target): r.n_edges for r in graph.module_edges(retrieval.import_edges(facts.dependencies(files), files)).collect()}
    assert got == {("app", "tools"): 1, ("web", "shared"): 1}


def test_bm25_equals_sqlite(spark):
    import sqlite3

    docs = ["load map of files", "map map map", "nothing here", "files and maps and load", "load", "zebra alpha"]
    try:
        con = sqlite3.connect(":memory:")
        con.execute("CREATE VIRTUAL TABLE t USING fts5(file_path, symbol, content)")
    except sqlite3.OperationalError:
        pytest.skip("no full-text search here")
    con.executemany("INSERT INTO t(rowid, file_path, symbol, content) VALUES (?, ?, ?, ?)", [(i, f"p{i}/a", "load" if i == 2 else "", d) for i, d in enumerate(docs, 1)])
    want = {r[0]: -r[1] for r in con.execute("SELECT rowid, bm25(t, 2, 5, 1) FROM t WHERE t MATCH 'load OR map'")}
    chunks = spark.createDataFrame([(i, f"p{i}/a", "load" if i == 2 else "", d) for i, d in enumerate(docs, 1)], "chunk_id long, file_path string, symbol string, content string")
    got = {r.chunk_id: r.score for r in retrieval.bm25(spark.createDataFrame([(1, "load map")], "qid long, question string"), chunks).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)


IMPORTS = [
    ("python", "a/b/c.py", "import os, sys as s\nfrom . import x, y as z\nfrom ..pkg.mod import (\n    one,  # , not\n    two,\n)\nfrom .. import (up)\n    import deep.er; q = 1\n", [(1, "os"), (1, "sys"), (2, ".x"), (2, ".y"), (3, "..pkg.mod"), (7, "..up"), (8, "deep.er")]),
    ("javascript", "a/b.js", 'import {\n  one,\n  two\n} from "../../x";\nimport "./side";\nexport * from \'m\';\nconst q = require("./r");\nlet s = "import t from \'u\'";\n', [(1, "../../x"), (5, "./side"), (6, "m"), (7, "./r")]),
    ("go", "m.go", 'package m\nimport (\n\t"fmt"\n\tx "a.b/c"\n)\nimport y "d/e"\nvar s = "f.g/h"\n', [(2, "fmt"), (2, "a.b/c"), (6, "d/e")]),
    ("rust", "r.rs", "use crate::a::b::{c, d};\npub use std::io;\nmod inner;\nmod here { }\n", [(1, "crate::a::b"), (2, "std::io"), (3, "inner")]),
    ("java", "J.java", "import static a.b.C.d;\nimport e.f.*;\n", [(1, "a.b.C.d"), (2, "e.f")]),
    ("c", "c.c", '#include <stdio.h>\n# include "x/y.h"\n', [(1, "stdio.h"), (2, "x/y.h")]),
]


def test_imports_over_several_lines_and_of_several_modules(spark):
    from plumbline.operators.parsing import line_dependencies

    files_ = spark.createDataFrame([("r", p, x, t) for x, p, t, _ in IMPORTS], "repo string, path string, language string, text string")
    got = {p: [] for _, p, _, _ in IMPORTS}
    for r in facts.dependencies(files_).collect():
        got[r.source_path].append((r.line, r.target))
    for language, path, text, want in IMPORTS:
        assert sorted(got[path]) == sorted(want), language
        assert sorted((d.line, d.target) for d in line_dependencies(text, language)) == sorted(want), language


def test_python_imports_are_those_of_its_syntax_tree(spark, sf):
    from plumbline.operators.parsing import python_facts

    f = facts.clean_files(spark.read.parquet(sf + "/files.parquet")).where("language = 'python' AND text IS NOT NULL")
    got: dict[str, set] = {}
    for r in facts.dependencies(f).collect():
        got.setdefault((r.repo, r.source_path), set()).add(r.target)
    n = 0
    for r in f.select("repo", "path", "text").collect():
        try:
            ast.parse(r.text)
        except SyntaxError:
            continue
        n += 1
        assert {d.target for d in python_facts(r.path, r.text).dependencies} == got.get((r.repo, r.path), set()), r.path
    assert n > 3


def test_imports_resolve_to_files(spark):
    paths = ["src/app/core/load.py", "src/app/core/__init__.py", "src/app/util.py", "src/app/x.py", "web/a/b/c.js", "web/x.js", "lib/net/http.rs", "src/app-kit/deep/mod.py"]
    lang = {"py": "python", "js": "javascript", "rs": "rust"}
    files_ = spark.createDataFrame([("r", p, lang[p.rsplit(".", 1)[1]]) for p in paths], "repo string, path string, language string")
    deps = [("src/app/core/load.py", "..util"), ("src/app/core/load.py", "..x"), ("src/app/x.py", ".core.load"), ("web/a/b/c.js", "../../x"), ("lib/net/http.rs", "crate::net::nothing"), ("src/app/util.py", "app.core"), ("src/app/util.py", "app_kit.deep.mod.Thing"), ("src/app/util.py", "elsewhere.app")]
    deps_ = spark.createDataFrame([("r", s, 1, t) for s, t in deps], "repo string, source_path string, line int, target string")
    got = {(r.source_path, r.target_path) for r in retrieval.resolved_edges(deps_, files_).collect()}
    want = {("src/app/core/load.py", "src/app/util.py"), ("src/app/core/load.py", "src/app/x.py"), ("src/app/x.py", "src/app/core/load.py"), ("web/a/b/c.js", "web/x.js"), ("src/app/util.py", "src/app/core/__init__.py")}
    assert want <= got and ("src/app/util.py", "src/app-kit/deep/mod.py") not in got
    mods = {(r.target, r.target_path) for r in retrieval.module_targets(deps_, files_).collect()}
    assert ("app_kit.deep.mod.Thing", "src/app-kit/deep/mod.py") in mods and ("app.core", "src/app/core/__init__.py") in mods
    assert not any(t == "elsewhere.app" for t, _ in mods)


def test_questions_are_expanded_but_covered_by_what_they_say(spark):
    chunks = spark.createDataFrame(
        [(1, "r", "a.py", 0, 1, 2, "def parse_policy(x): pass", "python", "parse_policy"), (2, "r", "b.py", 0, 1, 2, "the policies were parsed here", "python", ""), (3, "r", "c.py", 0, 1, 2, "配置文件的加载", "python", "")],
        "chunk_id long, repo string, file_path string, ordinal int, start_line int, end_line int, content string, language string, symbol string",
    )
    ask = lambda *q: spark.createDataFrame(list(enumerate(q)), "qid long, question string")
    index = retrieval.chunk_terms(chunks)
    hits = {(r.qid, r.chunk_id): r.matches for r in retrieval.term_matches(ask("policies parsing", "加载配置", "shop rules"), index, {"shop rules": ["policy"]}).collect()}
    assert hits[0, 1] >= 2 and hits[0, 2] >= 1 and hits[1, 3] >= 2 and hits[2, 1] == 1
    cover = {(r.qid, r.chunk_id) for r in retrieval.covered(ask("policies parsed", "加载", "parse_policy", "parse_rules"), index).collect()}
    assert cover == {(0, 2), (1, 3), (2, 1)}
    symbols = spark.createDataFrame([(1, "r", "a.py", "parse_policy", 1, 2), (2, "r", "a.py", "policy", 3, 4), (3, "r", "a.py", "id", 5, 6), (4, "r", "a.py", "load_policy_file", 7, 8)], "symbol_id long, repo string, path string, name string, start_line int, end_line int")
    got = {(r.qid, r.symbol_id): (r.priority, r.match) for r in retrieval.symbol_matches(ask("policies", "policy", "id"), symbols).collect()}
    assert got[0, 2] == (1, "expanded") and got[0, 1] == (2, "expanded") and got[1, 2] == (0, "exact") and got[1, 4] == (3, "partial") and got[2, 3] == (0, "exact")
    stale = chunks.where("chunk_id <> 1").select("chunk_id")
    assert {r.chunk_id for r in retrieval.bm25(ask("parse policy"), chunks, fresh=stale).collect()}.isdisjoint({1})


@pytest.mark.parametrize("blocks", [(20_000, 2_000), (7, 3)])
def test_nearest_vectors_equal_brute_force(spark, blocks):
    rng = np.random.default_rng(2)
    m = np.vstack([rng.normal(size=(60, 8)), np.zeros((1, 8))])
    rows = [(i, v.tolist(), "x") for i, v in enumerate(m)] + [(3, m[3].tolist(), "x"), (99, None, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = {(r.qid, r["rank"]): (r.id, r.score) for r in vectors.nearest(df, df.where("vec_id % 5 = 0"), "vec_id", "embedding", 4, *blocks).collect()}
    norm = np.linalg.norm(m, axis=1)
    for q in range(0, 61, 5):
        score = np.round(m @ m[q] / np.where(norm * norm[q] > 0, norm * norm[q], 1), 6)
        want = sorted(((-s, i) for i, s in enumerate(score) if i != q))[:4]
        assert [got[q, k + 1][0] for k in range(4)] == [i for _, i in want]
    assert vectors.nearest(df.limit(0), df, "vec_id", "embedding").count() == 0 == vectors.nearest(df, df.limit(0), "vec_id", "embedding").count()


def test_graded_gains_equal_brute_force(spark):
    results = spark.createDataFrame([(1, 10, 1), (1, 1, 2), (1, 12, 3), (2, 5, 1)], "qid long, chunk_id long, rank int")
    qs = spark.createDataFrame([(1, "f", "r", "a.py"), (2, "g", "r", "b.py"), (3, "h", "r", "c.py")], "qid long, question string, repo string, file_path string")
    chunks = spark.createDataFrame([(1, "r", "a.py", "f"), (10, "r", "a.py", ""), (12, "r", "z.py", "f"), (2, "r", "b.py", "g"), (5, "r", "y.py", "")], "chunk_id long, repo string, file_path string, symbol string")
    got = {r.qid: r.ndcg for r in graph.graded_ndcg(results, graph.grades(qs, chunks), qs.select("qid")).collect()}
    dcg, ideal = 3 + 7 / np.log2(3) + 1 / 2, 7 + 3 / np.log2(3) + 1 / 2
    assert got == {1: pytest.approx(dcg / ideal, abs=1e-6), 2: 0, 3: 0}
