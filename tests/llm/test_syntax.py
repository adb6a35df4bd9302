from __future__ import annotations

import ast
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm.derivatives import Grammar
from plumbline.llm.grammars import _TOKENISERS, check, grammar
from plumbline.llm.syntax import broken, parse_files, rates


def test_derivatives_mark_the_failing_token_and_truncation():
    g = Grammar("file : 'a' ('b' 'a')* 'c'? ;")
    t = {k: g.token(k) for k in "abc"}
    run = lambda s: g.parse([t[x] for x in s])
    assert run("aba") == ("ok", 3) and run("abac") == ("ok", 4)
    assert run("abb") == ("token", 2) and run("ab") == ("end", 2) and run("") == ("end", 0)


def test_ambiguous_and_nested_grammar():
    g = Grammar("file : x ; x : 'l' x 'r' | 'l' 'r' | 'l' x ;")
    l, r = g.token("l"), g.token("r")
    assert g.parse([l] * 300 + [r] * 200)[0] == "ok" and g.parse([l, r, r])[0] == "token"


GOOD = {
    "python": [
        "", "x = 1\n", "def f(a, *, b: int = 2, **k) -> str:\n    return a if b else [i for i in k if i]\n", "class A(B, metaclass=M):\n    @p\n    async def g(self):\n        async with a as b, c:\n            yield await d\n",
        "match x:\n    case [1, *y] if y:\n        pass\n    case {'a': 1, **r} | None as z:\n        pass\nmatch = 3\nprint(match, type(match))\n", "try:\n    pass\nexcept* (E, F) as e:\n    raise X from e\nelse:\n    pass\nfinally:\n    pass\n",
        "f'{x!r:>{w}}' \"\"\"\n<<<<<<< ours\n\"\"\"\n", "if (y := f(x)) > 3: z = lambda *a, k=1: (a, k)\n", "x: int\na, *b = c = yield_ = 1, 2\ndel a[1:2, ::3], b\n", "with (open(a) as b, c as d,):\n\tpass\n", "type X[T] = list[T]\n", "x = (1 +\n  2)  # c\n\\\n\ny = 1\n",
    ],
    "json": ["", '{"a": [1, -2.5e3, "\\u00e9", true, null], "b": {}}', " 1 "],
    "toml": ['a = 1\n[b.c]\n"d e" = [1, 2,\n 3, # x\n]\n[[e]]\nf = {g = 1.5, h = "x"}\ni = 1979-05-27T07:32:00Z\nj = """\n]\n"""\n', "3 = true\n", ""],
    "javascript": [
        "import a, {b as c} from './d';\nexport default class extends X { #p = 1; static async *g() { yield* a?.b ?? c } get x() { return 1 } }\n", "const {a, b: [c = 1, ...d], ...e} = f;\nfor await (const x of y) z(x)\nlabel: while (1) break label\n",
        "let s = `a ${`b ${c}`} {`\nlet r = /[/({]+/g.test(x) / 2\n", "x = async (a, {b} = {}) => ({...a, [b]: 1, m() {}, get: 2})\ny = a => b\n", "if (a) b(); else if (c) { d } else e\ndo { x++ } while (x < 3)\nswitch (x) { case 1: case 2: f(); break; default: g() }\n",
        "a\n++b\nvar f = function* () {}, g = new X(...y)\ntry { t() } catch { u() } finally { v() }\n", "export const a = 1, b = 2\nexport { a as default } from 'x'\nexport * as ns from 'y'\n",
    ],
    "typescript": [
        "export interface A<T extends B = C> extends D { readonly a?: string; [k: string]: any; m(x: number): void\n n: () => void }\ntype U = | 'a' | { b: A<C<D>> } & E[] ;\nenum X { A = 1, B }\n", "abstract class A<T> implements B, C { private constructor(public readonly x: number, y?: string) { super() }\n abstract f(): Promise<Map<string, number[]>>;\n static #z!: T }\n",
        "const f = <T,>(x: T, ...r: any[]): x is string => (x as unknown as string)!.length > 0\nlet m = new Map<string, number>();\n", "declare module 'x' { export function f(a: number): void }\nnamespace N.M { const a = 1 }\nfunction f(a: string): void\nfunction f(a: any) { return a satisfies B }\n",
    ],
    "go": [
        'package main\n\nimport (\n\t"fmt"\n\tm "math"\n)\n\ntype S[T any] struct {\n\tA, B int `json:"a"`\n\t*E\n}\n\nfunc (s *S[T]) F(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[a]; ok && v > 1 {\n\t\treturn\n\t}\n\tfor i := range []int{1, 2} {\n\t\tgo func() { ch <- i }()\n\t}\n\tswitch t := x.(type) {\n\tcase int, string:\n\t\tfallthrough\n\tdefault:\n\t}\n\treturn S{A: 1, B: map[string][]int{"a": {1}}}.A, nil\n}\n',
        "package a\nvar x, y = 1, 'a'\nconst (\n\tA = iota\n\tB\n)\ntype I interface {\n\tM(int) error\n\t~int | string\n}\n",
    ],
    "java": [
        'package a.b;\nimport static c.D.*;\n@A(x = {1, 2})\npublic final class X<T extends Y & Z> extends B<T[]> implements C {\n  private static final Map<String, List<int[]>> M = new HashMap<>() {{ put("a", null); }};\n  X(int... a) throws E { this(a, 1); }\n  <R> R f(final T t) { for (var x : y) if (x instanceof String s) return (R) s; int[] z = {1, 2}; z[0] >>>= 1; Runnable r = () -> {}; g(X::new, a -> b); return switch (t) { case 1, 2 -> 3; default -> { yield 4; } }; }\n  enum E { A, B(1) { void q() {} }; int v; }\n  record P(int a, String b) {}\n}\n'
    ],
    "rust": [
        "#![allow(x)]\nuse std::{fmt, io::{self, Read as R}, x::*};\n#[derive(A)]\npub struct S<'a, T: Clone + 'a = u8> where T: B { pub a: &'a mut [T], b: Option<Box<dyn Fn(i32) -> u8>> }\nimpl<'a, T> fmt::Display for S<'a, T> { const N: usize = 3; fn f(&self, mut x: u8) -> Result<(), E> { let v: Vec<_> = x.iter().map(|a| a + 1).collect::<Vec<_>>(); if let Some(y) = z && y > 2 { return Err(E::A { a: 1, ..d })?; } match x { 1..=5 | 7 if q => {}, S { a, .. } => 3, _ => println!(\"{}\", 'c') } 'l: loop { break 'l } for i in 0..n { a[i] <<= 1; } unsafe { *p = 1 } } }\nmacro_rules! m { ($x:expr) => { $x }; }\nenum E { A { a: u8 }, B(i32), C = 3 }\n"
    ],
    "c": [
        '#include <a.h>\n#define X(a) \\\n  { a\ntypedef struct { int a:3; char *b[2]; union { int c; } u; } S;\nstatic inline const char *f(struct s *a, size_t n, ...) { for (int i = 0; i < n; i++) { S x = {.a = 1, {2}}; if (!a->b || (*p)(1, "x" "y")) goto end; } do x++; while (x); switch (x) { case 1: default: break; } end: return (char *)sizeof(int); }\nint (*fp)(int), y[3] = {1, 2, 3};\nenum e { A, B = 2, };\n'
    ],
    "cpp": [
        '#include <v>\nnamespace a::b { template <typename T, int N = 3> class X : public Y<T>, private Z { public: explicit X(int a) : a_(a), b_{1} {} virtual ~X() = default; T operator+(const X& o) const noexcept override { return [&, this](auto x) mutable -> int { return x; }(1); } friend std::ostream& operator<<(std::ostream& s, const X<T>& x); private: std::vector<std::map<int, T>> m_{}; static constexpr int k = 1; }; }\nint main(int c, char** v) { for (const auto& [k, w] : m) { auto p = std::make_unique<X<int, 2>>(1); if (auto it = m.find(1); it != m.end()) throw std::runtime_error("x"); } try { delete[] p; } catch (const E& e) {} return static_cast<int>(x) ? a<b : c; }\nusing T = int; enum class C : int { A };\nauto s = R"(\n<<<<<<< )";\n'
    ],
}
CASES = [(language, text) for language, texts in GOOD.items() for text in texts]


@pytest.mark.parametrize("language, text", CASES)
def test_good_files_parse(language, text):
    assert check(language, text)[0] == "ok", check(language, text)


@pytest.mark.parametrize("language, text", [c for c in CASES if len(c[1]) > 60 and c[0] != "toml"])
def test_conflicts_and_other_languages_do_not(language, text):
    lines = text.split("\n")
    state, at = check(language, "<<<<<<< ours\n" + text)
    assert state != "ok"
    assert check(language, "<!DOCTYPE html>\n<html><head></head>")[0] == "token"
    assert check(language, text + ("\n}" if language != "python" else "\n)"))[0] == "token"
    assert lines


@pytest.mark.parametrize(
    "language, text, state",
    [
        ("python", "def f(:\n    pass\n", "token"), ("python", "def f()\n    pass\n", "token"), ("python", "x = (1,\n", "end"), ("python", "if x:\n  a\n b\n", "token"), ("python", "x = '''abc", "token"), ("python", "def f():\n", "end"), ("python", "print 'a'\n", "token"),
        ("json", "{'a': 1}", "token"), ("json", '{"a": 1,}', "token"), ("json", '{"a": 1', "end"), ("json", " ", "end"), ("toml", "a = \n", "token"), ("toml", "a = 1 b = 2\n", "token"),
        ("javascript", "let x = ;", "token"), ("javascript", "f(a b)", "token"), ("javascript", "function f() {", "end"), ("javascript", "a = `x", "token"), ("typescript", "let x: = 1;", "token"), ("go", "package a\nfunc f() {\n", "end"), ("go", "package a\nx := 1\n", "token"),
        ("java", "class A { void f() { int a = 1 } }", "token"), ("java", "class A {", "end"), ("rust", "fn f() { let x = 1 let y = 2; }", "token"), ("rust", "fn f() {", "end"), ("c", "int f() { return 1 }", "token"), ("c", "int f( {", "token"), ("cpp", "class A { int a; }", "end"), ("cpp", "int x = “a”;", "token"),
    ],
)
def test_broken_files(language, text, state):
    assert check(language, text)[0] == state


PY = st.lists(st.sampled_from(["x", "1", "=", "(", ")", "[", "]", ":", ",", " ", "\n", "\n    ", "if ", "else", "def f", "return ", "lambda ", "for ", " in ", "*", "'s'", "not ", "async ", "await ", "{", "}", ".", "@"]), max_size=14).map("".join)


@settings(max_examples=600, deadline=None)
@given(PY)
def test_what_python_takes_is_taken(text):
    try:
        ast.parse(text)
    except (SyntaxError, ValueError):
        return
    assert check("python", text)[0] == "ok"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='{}[]",:0123456789.eE+-truefalsn \\u/x', max_size=12))
def test_json_is_exact(text):
    def constant(x):
        raise ValueError(x)

    try:
        json.loads(text, parse_constant=constant)
        ok = True
    except ValueError:
        ok = text == ""
    assert (check("json", text)[0] == "ok") == ok


def test_files(spark):
    df = spark.createDataFrame(
        [(1, "r", "a.py", "python", "x = (", "z"), (1, "r", "a.py", "python", "x = (", "z"), (2, "r", "b.JSON", None, "{}", "z"), (3, "r", "c.md", "markdown", "x = (", "z"), (4, "q", "d.go", "go", None, "z"), (5, "q", "e.rs", "rust", "", "z"), (6, "r", "l.py", "python", "x = 1\n" * 20_000, "z")],
        "file_id long, repo string, path string, language string, text string, state string",
    )
    parsed = parse_files(df).cache()
    assert [r.file_id for r in broken(parsed).collect()] == [1]
    assert sorted(tuple(r) for r in rates(parsed).collect()) == [("q", "rust", 1, 0, 0.0), ("r", "json", 1, 0, 0.0), ("r", "python", 2, 1, 0.5)]
    assert parse_files(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "language, text, state",
    [("javascript", "1" * 200_000, "ok"), ("javascript", "x = " + "`${" * 30_000, "token"), ("rust", "fn f() { x.0.1 + " + "1_" * 50_000 + "1 }", "ok"), ("c", "int a[] = {" + "0xff, " * 60_000 + "};", "ok"), ("go", "package a\nvar x = " + "(" * 50_000, "end"), ("json", "[" * 60_000 + "]" * 60_000, "ok"), ("python", "x = [\n" + "1,\n" * 60_000 + "]\n", "ok")],
)
def test_very_long_texts(language, text, state):
    assert check(language, text)[0] == state


def test_templates_nest():
    assert check("javascript", "x = `a ${f(`b ${'}'} ${{a: `c`}}`)} d`;")[0] == "ok"
    assert check("javascript", "x = `a ${f(`b`)} ")[0] == "token"


F_STRINGS = ['f"{x}"','f"{x!r:>{w}}"',"f'{d[\"k\"]}'",'f"{d["k"]}"','f"a{{b}}c"','f"""{\nx}\n"""','f"{x=}"','f"{x=!r:^20}"',"rf'\\d{x}\\{y}'",'f"\\N{BULLET} {x}"','x = f"{a}" "b" f"{c:%Y-%m-%d}"','f"{f"{f"{1}"}"}"','f"{ {1:2}[1] }"','f"{x:{y}{z}}"','f"{(lambda x: 1)(2)}"','f"{x if y else z}"','f"{a != b}"','print(f"{a}", end="")\n','f"{yield_}"','f"{x:}"','f"{a[1:2]}"','f"""a " b {c} "" d"""','f"{x:=5}"','f""',"F'{a}'"]
BROKEN_F_STRINGS = ['f"{x +}"','f"{}"','f"{x"','f"{x!}"','f"}"','f"{a b}"','f"{x:{}}"','f"{"','f"{x!r r}"']


@pytest.mark.parametrize("text", F_STRINGS + BROKEN_F_STRINGS)
def test_fields_of_f_strings_are_parsed(text):
    try:
        ast.parse(text)
    except SyntaxError:
        assert text in BROKEN_F_STRINGS and check("python", text)[0] != "ok"
    else:
        assert text in F_STRINGS and check("python", text)[0] == "ok"


@pytest.mark.parametrize("language", ["javascript", "typescript"])
def test_expressions_of_templates_are_parsed(language):
    for text in ['`a`','`a${b}c`','`${a}${b}`','`${`n${x}`}`','tag`a${ {a:1}.a }`;','x = `a${f(() => { return 1 })}`','const a = `\\`${b}`','`${a}`.length','`a$b`','`$${a}`','f(`${a}`)\ng()']:
        assert check(language, text)[0] == "ok", text
    for text in ['`${a b}`','`${}`','`a','`${a`','`${a +}`']:
        assert check(language, text)[0] != "ok", text


@pytest.mark.parametrize("language", ["c", "cpp"])
def test_conditional_parts_are_alternatives_and_balanced(language):
    for text in ['#if A\nint a;\n#else\nlong a;\n#endif\n','#ifdef __cplusplus\nextern "C" {\n#endif\nint f(void);\n#ifdef __cplusplus\n}\n#endif\n','#if 0\nthis is not C ((\n#endif\nint x;\n','int f(\n#ifdef A\nint a) {\n#else\nlong a) {\n#endif\nreturn a; }\n','#ifndef H\n#define H\nint a;\n#endif','#if 0\n#if X\n((\n#else\n]]\n#endif\n#else\nint z;\n#endif\n','#if A\n#elif B\nint b;\n#else\n#endif']:
        if language == "cpp" or '"C"' not in text:
            assert check(language, text)[0] == "ok", text
    for text in ['#ifndef H\n#define H\nint a;\n','int a;\n#endif\n','#if A\n#else\n#else\n#endif\n','#else\n','#if A\nint a\n#endif\n','#if A\n#else\n#elif B\n#endif','#ifndef H\nvoid f(){\n#endif\n']:
        assert check(language, text)[0] != "ok", text


def test_forgotten_states_change_no_result():
    texts = ["x = [1, (2, 3)]\n", "def f(:\n", "if x:\n    pass\n", "f(a, b=c)\n"]
    g = grammar("python")
    kinds = [[g.tokens.get(k, 0) for k, _ in _TOKENISERS["python"](t, "python")] for t in texts]
    assert [g.parse(k) for k in kinds] == [g.parse(k, most=0) for k in kinds]
