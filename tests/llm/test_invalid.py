import ast
import json
import time

import pytest

from loamworks.llm.grammars import parser
from loamworks.llm.invalid import failure, failures, unparsable, unparsable_rates

VALID = "export async function f<T extends object>(a: Array<Record<string, number>>, o: Map<string, T>= x): Promise<void> {\n  const m = new Map<string, number>();\n  return o?.g(a[0] as T);\n}\n"


@pytest.mark.parametrize(
    ("text", "ok"),
    [
        (VALID, True), (VALID[:-3], False), (VALID.replace("  const", "<<<<<<< ours\n  const"), False), ("/*\n<<<<<<< ours\n*/\n", True),
        ("const a = b ? c as D : e, r: Record<string, number>= {};", True), ("let x: = 1;", False), ("let a: Array<string = [];", False),
        ("class A<T> extends B<T> implements C { x: number = 1; m(): void {} }", True), ("const f = async <T,>(x: T): Promise<T> => x;", True),
        ("declare module 'x' { const a: number; }", True), ("type A<T> = T extends Array<infer U extends X> ? U : T extends B ? C : D;", True),
        ("const a = b ? c ? d ? e : f : g : h;", True), ("if (a >= b && c >>> 2 > d) { x >>>= 1; }", True), ("function () {}", False),
    ],
)
def test_typescript(text, ok):
    assert parser(".ts").valid(text) is ok


@pytest.mark.parametrize(
    ("text", "ok"),
    [
        ("if (a) /re/.test(b);", True), ("while (x) /a/.test(y);", True), ("if (x) { } /re/.exec(s);", True), ("f(`${ {a:{b:{c:1}}}.a }`);", True), ("var \\u0061 = 1;", True), ("a = b ? c ? d ? e : f : g : h;", True),
        ("x = `${a +}`;", False), ("function(){}", False), ("import x from 'y';", False), ("let a = ;", False), ("if (a) b; else c;", True), ("else c;", False), ("a\n.b()\n", True), ("for (const [k, v] of m) { f(k) }", True), ("do x(); while (y)", True),
    ],
)
def test_javascript(text, ok):
    assert parser(".js").valid(text) is ok


@pytest.mark.parametrize(
    ("text", "ok"),
    [
        ("class A { List<Integer> m; }", True), ("class A { List<List<Integer>> m; Map<String, List<Integer>> n = new HashMap<>(); }", True), ('class A { String s = "\\q"; }', False), ("class A { int x = 09; }", False),
        ("class A { int f() { return a < b ? c : d; } }", True), ("class A { void f() { for (int i = 0; i < n; i++) { g(i); } } }", True), ("class A { int f() { return 1 } }", False), ("class A {", False), ("record P(int x) { }", True),
    ],
)
def test_java(text, ok):
    assert parser(".java").valid(text) is ok


@pytest.mark.parametrize(
    ("text", "ok"),
    [("package a\n\nfunc f() int {\n\treturn 1\n}\n", True), ('package a\nvar s = "\\q"\n', False), ("package a\nvar s = 09\n", False), ("package a\nfunc f() {\n", False), ("package a\ntype T[K comparable] map[K]int\nvar x = T[string]{\"a\": 1}\n", True), ("package a\nx := 1\n", False)],
)
def test_go(text, ok):
    assert parser(".go").valid(text) is ok


PYTHON = [
    "def f(a):\n    return a\n", 'print "x"\n', "def f():\n\treturn 1\n        x=2\n", "if 1:\n        x=1\n\ty=2\n", "f'{a b}'\n", "f'{}'\n", "f'{'\n", "f'{a!r:>{w}} {{x}} {b[\"c\"]=}'\n", "(a, b) += 1\n", "(a) += 1\n",
    "print(*a, **k, *b)\n", "print(**k, b=1)\n", "del f()\n", "del a.b, c[0]\n", "def f(*): pass\n", "def f(*, a): pass\n", "def f(/): pass\n", "def f(a, /, b): pass\n", "x = b'\u00e9'\n", "x = 'a' b'c'\n", "\ufeffx = 1\n",
    "match x:\n    case [1, *r] if r:\n        pass\n    case {'a': b}:\n        pass\n", "x = lambda a: b if c else d\n", "x = [a for a in b if c if d]\n", "try:\n    x\nexcept* E as e:\n    y\n", "try:\n    x\n", "    x = 1\n", "", "x = (\n", "async def f():\n    await x\n", "x = 1 if 2\n", "@a\nclass B(C, d=1):\n    x: int = 1\n",
]


@pytest.mark.parametrize("text", PYTHON)
def test_python_agrees_with_its_own_parser(text):
    try:
        ast.parse(text.encode())
        ok = True
    except SyntaxError:
        ok = False
    assert parser(".py").valid(text) is ok


@pytest.mark.parametrize("text", ['{"a": [1, null, true, -1.5e3, "\\u00e9"]}', "{'a': 1}", "[1,]", "[1 2]", "01", '"a\nb"', "\ufeff{}", " [] ", "nul", '{"a":1,}', "// x\n{}", "{}{}"])
def test_json_agrees_with_the_library(text):
    try:
        json.loads(text)
        ok = True
    except ValueError:
        ok = False
    assert parser(".json").valid(text) is ok


def test_depth_costs_no_more_than_length():
    began = time.time()
    assert parser(".json").valid("[" * 50_000 + "]" * 50_000)
    assert parser(".js").valid("a = " + "(" * 5_000 + "b" + ")" * 5_000)
    assert parser(".js").valid("a = " + "b ? " * 3_000 + "c" + " : d" * 3_000)
    assert parser(".js").valid("f(1);\n" * 50_000)
    assert parser(".js").valid("a = [" + "1, 'b', " * 60_000 + "c];")
    assert not parser(".py").valid("a = [" + "1, 'b', " * 60_000 + "c")
    assert time.time() - began < 20


@pytest.mark.parametrize(
    ("ext", "text", "where", "cause"),
    [
        (".js", "let a = 1;\nlet b = ;\n", "let b = ;", "statement"), (".js", "f(1));\n", ");", "bracket"), (".js", "f();\n<<<<<<< ours\ng();\n=======\nh();\n>>>>>>> theirs\n", "<<<<<<<", "merge conflict"),
        (".js", "def f(a):\n    return a\n", "f(a)", "wrong extension"), (".js", "function f() {\n  g(", None, "truncated"), (".json", "", "", "empty"), (".py", "x = 1\nif x:\n    y = 2\n  z = 3\n", "z", "indent"), (".py", "x = 1\ny = = 2\n", "= 2", "statement"),
        (".json", '{"a": 1, "b" 2}', "2}", "statement"), (".py", "x = 'a\ny = 1\n", "'a", "token"),
    ],
)
def test_failures(ext, text, where, cause):
    assert not (text and parser(ext).valid(text))
    at, line, found = failure(ext, text)
    assert found == cause
    if where is None:
        assert at == len(text)
    elif where == "let b = ;":
        assert text[at] == ";" and line == 2
    else:
        assert text.startswith(where, at), (at, text[at:])


SCHEMA = "file_id long, repository string, path string, status string, body string, extra int"


def test_files(spark):
    files = spark.createDataFrame(
        [(1, "r", "a.ts", "failed", VALID, 1), (2, "r", "b.TS", None, VALID[:-3], 1), (2, "r", "b.TS", None, VALID[:-3], 1), (3, None, "c.json", None, None, None), (4, "r", "d.md", None, "(", 1), (None, "r", "e.py", None, "x =", 1), (5, "r", None, None, "x =", 1), (6, "r", "f.py", None, "", 1)], SCHEMA
    )
    runs = spark.createDataFrame([], "repository string, failed long, finished_at timestamp")
    assert sorted((r.file_id for r in unparsable(files).collect()), key=str) == [2, 2, 3, None]
    rates = {(r.repository, r.language): (r.files, r.unparsable, r.recorded_failed) for r in unparsable_rates(files, runs).collect()}
    assert rates == {("r", ".ts"): (3, 2, 1), (None, ".json"): (1, 1, 0), ("r", ".py"): (2, 1, 0)}
    assert {(r.file_id, r.cause) for r in failures(files).collect()} == {(2, "truncated"), (3, "empty"), (None, "truncated")}
    assert unparsable(files.limit(0)).collect() == []
