import pytest

from loamworks.llm import vendored as v

WORDS = " ".join(f"w{i}" for i in range(80))


def of(path, body):
    return v.rule(path, body, v.without_comments(body) if body else "")


@pytest.mark.parametrize(
    ("path", "body", "found"),
    [
        ("a/vendor/x/b.js", None, "vendor directory"), ("a/vendors/b.js", "f()", None), ("src/generators/vendor.ts", "f()", None), ("a/deps-lock.json", "{}", "lock"), ("a/lockstep.json", "{}", None), ("a/resolved_index8.json", '{"lockVersion": 3, "entries": [{"module": "x", "integrity": "sha"}]}', "lock"), ("a/b.json", '{"lockVersion": 3}', None), ("a/b.ts", '{"a": [' + "1, " * 300 + "2]}", None), ("a/b.py", 'import re\n\nLONG = "' + "word " * 300 + '"\n\ndef f(x):\n    return x\n', None), ("a/b.go", 'package data\n\nconst X = "' + "ab/" * 300 + '"\n', "data"), ("a/b_pb2.py", "x = 1", "generated name"), ("a/generated_ids.py", "x = 1", None),
        ("a/b.py", "# Diese Datei wurde automatisch von x-gen erzeugt.\nx = 1", "generated header"), ("a/b.go", "// Code generated by x. DO NOT EDIT.\npackage a", "generated header"), ("a/b.ts", "/*\n * Note.\n *\n * <auto-generated>\n */\nf()", "generated header"),
        ("a/b.ts", "// not generated: written for the cursor\nf()", None), ("a/b.ts", "// ids are generated by the cursor, never typed in\nf()", None), ("a/b.ts", "// we do not edit the cursor in place\nf()", None), ("a/b.py", "x = '''\n# @generated\n'''\n", None),
        ("vendor/a.md", "x", None), ("a.txt", "", None), ("a/b.js", None, None), ("a/b.js", "", None), ("a/b.min.js", "var e={}", "minified"), ("a/min.ts", "f()", None),
        ("a/b.js", "var e={};" + "".join(f"function f{i}(a,b){{return a>b?a-{i}:b.x}}" for i in range(20)), "minified"), ("a/b.js", 'const a = "' + "word " * 200 + '";\n' + "function f() {\n  return a + 1;\n}\n" * 20, None),
        ("a/b.py", "TABLE = [\n" + "    1, 0x2f, 3.5, -4,\n" * 60 + "]\n", "data"), ("a/b.ts", 'const F = "data:font/woff2;base64,' + "ab//cd" * 100 + '";', "data"), ("a/b.json", "[" + "1," * 500 + "1]", None),
        ("a/b.js", "".join(f"function getA{i}(m) {{\n  return m[{i}];\n}}\n" for i in range(6)), "numbered members"), ("a/b.js", "function go() {\n  let a0 = 1;\n  let a1 = 2;\n  let a2 = 3;\n  let a3 = 4;\n}\n", None),
    ],
)
def test_rules(path, body, found):
    assert of(path, body) == found


def test_library_copies():
    lib = v.Library([WORDS, "short text"])
    assert lib.contained(WORDS.split()) and lib.contained(("a b c " + WORDS + " d e f").split()) and not lib.contained(WORDS.split()[:50]) and not lib.contained(["short", "text"])
    assert not v.Library([]).contained(WORDS.split())


FILES = "file_id long, repository string, path string, body string, rule string"


def test_found(spark):
    body = lambda n: "\n".join(f"do{n}_{i}(a{i}, b{i});" for i in range(40))
    rows = [
        (1, "r1", "tools/own.js", body(1)), (2, "r2", "tools/own.js", body(1)),  # one owner's
        (3, "r1", "src/a/x.js", body(2)), (4, "r3", "lib/b/y.js", "// other header\n" + body(2).replace("\n", "\r\n")),  # of different owners
        (5, "r1", "src/c.js", body(3)), (6, "r2", "src/d.js", body(3)),  # of one owner
        (7, "r4", "src/e.js", body(4) + "\nmore();\n"), (8, "r4", "src\\f.js", body(5)), (9, None, "src/g.js", body(2)), (10, "r4", None, body(2)), (11, "r4", "src/h.js", None), (12, "r4", "x.js", body(2)[:50]), (4, "r3", "lib/b/y.js", body(2)),
    ]
    files = spark.createDataFrame([(*r, "clash") for r in rows], FILES)
    lib = spark.createDataFrame([(1, "known", body(4)), (1, "known", body(4)), (2, None, None)], "lib_id int, library string, body string")
    found = sorted((r.file_id, r.reason) for r in v.not_by_hand(files, lib).collect())
    assert found == [(3, "shared subtree"), (4, "shared subtree"), (4, "shared subtree"), (7, "library copy")]
    assert {(r.repository, r.owner) for r in v.owners(v.marked_files(files, lib)).collect()} == {("r1", "r1"), ("r2", "r1"), ("r3", "r3"), ("r4", "r4")}
    assert [r.file_id for r in v.library_copies(files, lib).collect()] == [7]
    assert v.not_by_hand(files.limit(0), lib.limit(0)).collect() == []


def test_directories_are_hashed_without_names(spark):
    leaves = spark.createDataFrame([("r", "a/x", b"1"), ("r", "a/y", b"2"), ("s", "b/c/z", b"2"), ("s", "b/c/w", b"1")], "repository string, path string, leaf binary")
    found = {(r.repository, r.path): bytes(r.hash) for r in v.subtrees(leaves).collect()}
    assert found["r", "a"] == found["s", "b/c"] == found["s", "b"] and ("s", "b/c/z") in found
