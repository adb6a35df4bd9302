from __future__ import annotations

import hashlib
import json

import pytest

from plumbline.llm.handwritten import header_says_copied, header_says_generated, judge, leaves, looks_minified, merkle_nodes, not_handwritten

CODE = "\n\n".join(f"def step_{w}(a, b):\n    c = a + b\n    log('{w}')\n    if c > 3:\n        return {w}(c)\n    return c" for w in ("alpha", "beta", "gamma", "delta", "eps"))


@pytest.mark.parametrize(
    "line", ["# Code generated by x. DO NOT EDIT.", "// Generated on 2020-01-01 from a.idl", "/* auto-generated, do not modify by hand */", "# @generated by t 1", "// Diese Datei wurde automatisch von x erzeugt.", "# This file was automatically created by x; changes will be lost.", "// 由 x 自动生成"]
)
def test_headers(line):
    assert header_says_generated(line + "\nx = 1\n") and header_says_generated("# Copyright 2020\n\n" + line + "\nx = 1\n")
    assert not header_says_generated("x = 1\n" + line)


@pytest.mark.parametrize("text", ['BANNER = "Code generated by x. DO NOT EDIT."', "# Once produced by x; maintained by hand since 2019.", "# Generators of reports live here", "# Do not call this twice", ""])
def test_talk_about_generation_is_none(text):
    assert judge("a/b.py", text + "\n" + CODE) is None


@pytest.mark.parametrize(
    "path, text, want",
    [
        ("a/package-lock.json", "{}", "generated"), ("a/go.sum", "x", "generated"), ("a/x_pb2.py", "x = 1", "generated"), ("vendor/x/a.go", "package a", "vendored"), ("a/node_modules/b.js", "x", "vendored"),
        ("a/t.py", "T = [\n" + "1, 2, 3,\n" * 40 + "]\n", "data"), ("a/t.py", "x = 1\n", None), ("a/t.js", 'module.exports = "' + "aB3/" * 200 + '";\n', "data"), ("a/t.py", '"""' + "Some words about it. " * 60 + '"""\n', None), ("a/vendor.py", CODE, None), ("a/b.py", "", None),
        ("a/x.js", "!function(){" + "var a=b.c(d);e(f,g);function h(i){return i?j(k):l}" * 20 + "}();", "minified"), ("a/x.md", "| 1 | 2 |\n" * 50, None),
    ],
)
def test_judge(path, text, want):
    assert judge(path, text) == want


def test_long_lines_of_handwritten_scripts_are_no_bundles():
    assert not looks_minified("// " + "a comment that goes on and on " * 40 + "\nconst value = computeValue(first, second);\n" * 10)


def test_leaves_ignore_layout_and_comments():
    assert list(leaves("a = 1\nb = 2\nc = 3\n")) == list(leaves("# hi\n  a  =  1\nb = 2\n\tc = 3")) and list(leaves("")) == []


def row(i, repo, path, text):
    return (i, repo, path, hashlib.sha256((text or "").encode()).hexdigest().upper(), text, "x")


SCHEMA = "file_id long, repo string, path string, sha256 string, text string, reason string"


def test_copies_by_merkle_hashes(spark):
    other = CODE.replace("step_", "walk_").replace("log(", "trace(")
    third = CODE.replace("step_", "scan_").replace("log(", "note(")
    changed = other.replace("walk_beta(a, b)", "walk_beta(a, b, extra)")
    known = third + "\n# end\n"
    rows = [
        row(1, "p", "src/mine.py", CODE), row(2, "p", "lib/x/copied.py", other), row(3, "q", "tools/copied.py", changed), row(4, "q", "a/known.py", known), row(4, "q", "a/known.py", known),
        row(5, "r", "a/near.py", third.replace("scan_eps(a, b)", "scan_eps(a, z)")), row(6, "q", "a/empty.py", ""), row(7, "q", "a/null.py", None), row(8, "q", "__init__.py", "x = 1\n"), row(9, "p", "__init__.py", "x = 1\n"),
    ]
    up = spark.createDataFrame([(hashlib.sha256(known.encode()).hexdigest(), "l"), (None, "l")], "sha256 string, library string")
    got = {r.file_id: r.reason for r in not_handwritten(spark.createDataFrame(rows, SCHEMA), up).collect()}
    assert got == {2: "vendored", 3: "vendored", 4: "vendored", 5: "vendored"}


def test_empty_tables(spark):
    assert not_handwritten(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "sha256 string")).count() == 0


def test_directory_hashes_do_not_depend_on_place_or_order(spark):
    rows = [("p", "a/lib/x.c", 1, 9), ("p", "a/lib/d/y.c", 2, 9), ("q", "lib/d/y.c", 2, 9), ("q", "lib/x.c", 1, 9), ("q", "o/lib/x.c", 1, 9)]
    got = {(r.repo, r.path): (r.digest, r.lines) for r in merkle_nodes(spark.createDataFrame(rows, "repo string, path string, digest long, lines long")).collect()}
    assert got["p", "a/lib"] == got["q", "lib"] != got["q", "o/lib"] and got["p", "a"][1] == 18
    assert json.dumps(sorted(map(list, got))).count("lib/d") == 4


def test_headers_are_read_up_to_the_first_code():
    licence = "".join(f"// Clause {i} of a licence.\n" for i in range(60))
    block = "/*\n" + "Words of a licence.\n" * 40
    long = "// " + "words of a licence " * 40
    for head in (licence + "// ", block, long):
        assert header_says_generated(head + "Code generated by x. DO NOT EDIT." + " */" * (head == block) + "\nint x;\n")
    assert header_says_copied(licence + "// Upstream: https://h/x\nint x;\n") and header_says_copied(block + "Upstream: https://h/x\n*/\nint x;\n")
    assert header_says_copied(long + "vendored from x\nint x;\n") and header_says_copied("int x;\n// vendored from x\n")
    assert not header_says_generated(licence + "int x;\n// Code generated by x. DO NOT EDIT.\n")
    assert not header_says_copied(licence + "int x;\n// vendored from x\n")


def test_forks_are_no_vendored_code_and_a_null_repository_loses_nothing(spark):
    code = lambda k: "\n".join(f"def {w}_{k}(x, y):\n    z = x * {k} + y\n    return {w}(z, {k})\n" for w in ("walk", "fold", "trim", "pour"))
    rows = [(repo, f"src/m{k}.py", code(k)) for repo in ("orig", "fork") for k in range(8)]
    rows += [("other", f"lib/o{k}.py", code(100 + k)) for k in range(8)] + [("other", "lib/copied.py", code(3)), (None, "lib/taken.py", code(100))]
    files = spark.createDataFrame([(i, r, p, None, t) for i, (r, p, t) in enumerate(rows)], "file_id long, repo string, path string, sha256 string, text string")
    found = {rows[r.file_id][:2] for r in not_handwritten(files, spark.createDataFrame([], "sha256 string")).collect()}
    assert ("other", "lib/copied.py") in found and (None, "lib/taken.py") in found
    assert {p for r, p in found if r in ("orig", "fork")} == {"src/m3.py"}  # shared with an unrelated repository


def test_a_change_costs_its_own_block_only_even_without_blank_lines():
    lines = [f"value_{i} = compute({i * 37 % 101}, table[{i}])" for i in range(120)]
    changed = [*lines[:60], "value_60 = patched()", *lines[61:]]
    own = dict(leaves("\n".join(lines)))
    assert sum(n for h, n in leaves("\n".join(changed)) if h in own) >= 90
