from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.operators.parsing import Chunk, Facts, ParserRegistry, Symbol, chunk_regions, crossing, default_registry, parse_all, split_lines
from plumbline.sources.ignore import IgnoreStack, InvalidPattern

R = default_registry()


def names(language, text, path="x"):
    return [(s.name, s.start_line, s.end_line) for s in R.parse(language, path, text).symbols]


def test_python():
    f = R.parse("python", "a.py", "import os\nfrom .tools import x\nclass A(B):\n    async def run(self, n: int = 1) -> str:\n        return ''\ndef f(): pass\nif '__main__' == __name__:\n    f()\n")
    assert [(s.kind, s.name, s.start_line, s.end_line) for s in f.symbols] == [("class", "A", 3, 5), ("method", "A.run", 4, 5), ("function", "f", 6, 6)]
    assert f.symbols[1].signature == "async def run(self, n: int=1) -> str" and f.is_entry_point
    assert [(d.line, d.target) for d in f.dependencies] == [(1, "os"), (2, ".tools")]
    broken = R.parse("python", "b.py", "import os\ndef f(:\n  pass\n")
    assert [s.name for s in broken.symbols] == ["f"] and broken.dependencies[0].target == "os"


@pytest.mark.parametrize(
    "language, text, want",
    [
        ("javascript", "// function no() {\nexport async function go(a = '}') {\n  if (a) { }\n}\nconst f = (x) => {\n}\nclass K extends L {\n}\n", [("go", 2, 4), ("f", 5, 6), ("K", 7, 8)]),
        ("typescript", "export interface I<T> {\n a: T\n}\ntype U = string\nexport const enum E {\n A }\n", [("I", 1, 3), ("U", 4, 4), ("E", 5, 6)]),
        ("go", "package main\nfunc (s *S) Do(a int) error {\n}\ntype S struct {\n}\nfunc main() {\n}\n", [("Do", 2, 3), ("S", 4, 5), ("main", 6, 7)]),
        ("rust", "pub struct S<'a> {\n}\nimpl<'a> S<'a> {\n    pub fn go(&self) -> u8 {\n        1\n    }\n}\n", [("S", 1, 2), ("S<'a>", 3, 7), ("go", 4, 6)]),
        ("java", "public class A {\n    public static void main(String[] a) {\n        if (x) { }\n    }\n}\n", [("A", 1, 5), ("main", 2, 4)]),
        ("c", 'struct s {\n};\nstatic int f(char *a) {\n  char c = \'{\'; puts("}");\n}\n', [("s", 1, 2), ("f", 3, 5)]),
        ("cpp", "template <typename T> class X : public Y {\n};\nint ns::g(const std::string& s) const {\n}\n", [("X", 1, 2), ("ns::g", 3, 4)]),
        ("markdown", "# A\n```\n# no\n```\n## B\nTop\n===\n", [("A", 1, 5), ("B", 5, 5), ("Top", 6, 7)]),
        ("config", "[a]\nb = 1\nc: 2\n", [("a", 1, 1), ("b", 2, 2), ("c", 3, 3)]),
    ],
)
def test_symbols(language, text, want):
    assert names(language, text) == want


def test_manifests():
    deps = lambda p, t: [(d.line, d.target) for d in R.parse("config", p, t).dependencies]
    assert deps("package.json", '{\n "dependencies": {\n  "b": "1",\n  "a": "2"\n }\n}') == [(3, "b"), (4, "a")]
    assert deps("requirements-dev.txt", "# x\nnumpy>=1\n-r y\n") == [(2, "numpy")]
    assert deps("Cargo.toml", "[package]\nname = 1\n[dev-dependencies]\nserde = 1\n") == [(4, "serde")]
    assert deps("go.mod", "module a\nrequire (\n\tb.org/c v1\n)\nrequire d.org/e v2\n") == [(3, "b.org/c"), (5, "d.org/e")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab \t", max_size=30), max_size=25), st.lists(st.tuples(st.integers(-3, 30), st.integers(-3, 30), st.sampled_from(["", "s"])), max_size=6), st.integers(1, 6), st.integers(4, 60))
def test_chunks_cover_all_lines_within_their_bounds(lines, regions, max_lines, max_chars):
    text = "\n".join(lines)
    chunks = chunk_regions(text, regions, max_lines, max_chars)
    covered = set()
    for c in chunks:
        assert c.end_line - c.start_line < max_lines and len(c.content) <= max_chars
        assert c.content in "\n".join(split_lines(text)[c.start_line - 1 : c.end_line])
        covered |= set(range(c.start_line, c.end_line + 1))
    assert all(i in covered for i, x in enumerate(split_lines(text) if text else [], 1) if x.strip())


def test_registry_keeps_plug_ins_in_bounds():
    r = ParserRegistry()
    r.register("x", lambda p, t: Facts([Symbol(1, 99, "k", "n")]), "k-1")
    with pytest.raises(ValueError):
        r.register("x", lambda p, t: Facts(), "k-2")
    got = r.parse("x", "p", "a\nb\n")
    assert got.error and got.chunks == [Chunk(1, 2, "", "a\nb")]
    other = r.copy()
    other.register("x", lambda p, t: 1 / 0, "k-3", replace=True)
    assert "ZeroDivisionError" in other.parse("x", "p", "a").error and r.manifest() == [("x", "k-1")]
    assert crossing([Symbol(1, 5, "", "a"), Symbol(3, 8, "", "b")]) and not crossing([Symbol(1, 5, "", "a"), Symbol(2, 5, "", "b"), Symbol(6, 7, "", "c")])


def test_parse_all(spark):
    df = spark.createDataFrame([("a.py", "python", "def f():\n    pass\n", 1), ("b.py", "python", None, 1), ("c.xx", None, "x", 1), ("d.py", "python", "", 1)], "path string, language string, text string, size int")
    got = {r.path: r for r in parse_all(df).where("chunks IS NOT NULL").collect()}
    assert set(got) == {"a.py", "c.xx", "d.py"} and got["a.py"].symbols[0].name == "f" and got["c.xx"].chunks[0].content == "x" and got["d.py"].chunks == []


def test_ignore_files():
    s = IgnoreStack().below("", "*.log\n!keep.log\n/build\n*/tmp/\ndocs/**/*.pdf\n# c\n\\#x\n").below("sub", "!a.log\n")
    yes = ["a.log", "d/b.log", "build", "docs/p.pdf", "docs/q/r/p.pdf", "#x"]
    no = ["keep.log", "sub/a.log", "d/build", "docs.pdf", "c"]
    assert all(s.ignored(p, False) for p in yes) and not any(s.ignored(p, False) for p in no)
    assert s.ignored("x/tmp", True) and not s.ignored("x/tmp", False)
    with pytest.raises(InvalidPattern):
        IgnoreStack().below("", "!\n")


def test_priorities_of_parsers():
    r = ParserRegistry()
    r.register("x", lambda p, t: Facts([Symbol(1, 1, "k", "low")]), "low-1", priority=-5)
    r.register("x", lambda p, t: Facts([Symbol(1, 1, "k", "high")]), "high-1", priority=10)
    r.register("x", lambda p, t: Facts(), "late-1")
    assert r.manifest() == [("x", "high-1")] and r.parse("x", "p", "a").symbols[0].name == "high"
    with pytest.raises(ValueError):
        r.register("y", lambda p, t: Facts(), "y-1", priority=1001)
