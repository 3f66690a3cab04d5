"""Studies, parsing, links, text functions, the stream and the session."""

import random
from datetime import datetime as T

import pytest
from pyspark.sql import functions as F

from loamworks import session
from loamworks.functions import text
from loamworks.operators import graph, links, parsing, study
from loamworks.streaming import refresh

M = "run_id long, task string, trial int, arm string, run_condition string, correct boolean, context_bytes long, duration_ms long, setup_ms long, refresh_ms long, enrichment_ms long, recorded_at timestamp"
A, B = T(2026, 1, 1), T(2026, 1, 2)


def row(i, task, trial, arm, cost, correct=True, cond="warm", at=A):
    return (i, task, trial, arm, cond, correct, cost * 10 if cost is not None else None, cost, 0, 0, 0, at)


def test_reductions(spark):
    rows = [row(1, "t", 1, "ordinary", 100), row(2, "t", 1, "new", 50), row(3, "t", 2, "ordinary", 100), row(4, "t", 2, "new", 80), row(5, "t", 3, "ordinary", -1), row(6, "t", 3, "new", 80, False), row(7, "u", 1, "ordinary", 10), row(None, "t", 1, "new", 1), row(2, "t", 1, "new", 60, at=B), row(9, "t", 2, "new", 1), row(10, "v", None, "new", 1)]
    found = {r.task: r for r in study.reductions(spark.createDataFrame(rows, M), "new", "ordinary").collect()}
    assert set(found) == {"t"} and found["t"].pairs == 3
    assert found["t"].time_reduction == pytest.approx(0.3) and found["t"].correctness == pytest.approx(-1 / 3)


def test_schedules_and_missing_trials(spark):
    df = spark.createDataFrame([row(1, "t", 2, "a", 1), row(2, "t", 1, "b", 1), row(3, "u", 1, "a", 1, cond="cold"), row(4, None, 1, "a", 1)], M)
    assert study.schedule(df).count() == 2 * 2 * 2 + 1 * 2 * 2
    assert study.missing_trials(df).count() == 12 - 3
    assert study.schedule(df.limit(0)).collect() == []


def test_intervals():
    draw = study.xorshift("seed")
    first = [next(draw) for _ in range(1000)]
    again = study.xorshift("seed")
    assert first == [next(again) for _ in range(1000)] and 0.4 < sum(first) / 1000 < 0.6 and 0 <= min(first) and max(first) < 1
    values = [random.Random(i).gauss(5, 1) for i in range(40)]
    estimate, low, high = study.interval(values, "s")
    assert low < estimate < high and estimate == study.median(values) and study.median([1, 2, 4, 9]) == 3


def test_nearest_rank(spark):
    df = spark.createDataFrame([("a", float(i), i) for i in range(1, 101)] + [("b", 7.0, 1), ("b", None, 2)], "k string, v double, i int")
    assert {(r.k, r.n, r.v) for r in study.nearest_rank(df, ["k"], "v", 0.95, "i").collect()} == {("a", 100, 95.0), ("b", 1, 7.0)}


SOURCES = {
    ".py": "import os\nfrom .a import b\n\ndef f(x):\n    def g():\n        h()\n    return g() + os.path.join(x)\n\nclass C:\n    async def m(self):\n        self.n()\n",
    ".ts": "import { x } from './a';\nexport async function f<T>(a: T, o = { b: 1 }): Promise<void> {\n  g(a);\n}\nconst h = (a: number): number => {\n  return f(a);\n};\nclass C {\n}\n",
    ".js": "const a = require('b');\nfunction f(o = {}) {\n  const r = /[({]\"/;\n  return g(`${o} {`);\n}\n",
    ".go": "package a\nimport \"fmt\"\nfunc (c *C) M(x int) int {\n\treturn fmt.Sprint(x)\n}\ntype C struct {\n\tx int\n}\n",
    ".java": "package a;\nimport java.util.List;\nclass A {\n  // {\n  public static int f(int x) {\n    return g(x);\n  }\n}\n",
}


@pytest.mark.parametrize(
    ("ext", "symbols", "calls"),
    [
        (".py", {("f", 4, 7), ("f.g", 5, 6), ("C", 9, 11), ("C.m", 10, 11)}, {("f.g", "h"), ("f", "g"), ("f", "os.path.join"), ("C.m", "self.n")}), (".ts", {("f", 2, 4), ("h", 5, 7), ("C", 8, 9)}, {("f", "g"), ("h", "f")}), (".js", {("f", 2, 5)}, {("f", "g")}),
        (".go", {("C.M", 3, 5), ("C", 6, 8)}, {("C.M", "fmt.Sprint")}), (".java", {("A", 3, 8), ("A.f", 5, 7)}, {("A.f", "g")}),
    ],
)
def test_parsing(ext, symbols, calls):
    rows = parsing.parse(ext, SOURCES[ext])
    assert {(r[1], r[3], r[4]) for r in rows if r[0] == "symbol"} == symbols
    assert {(r[1], r[5]) for r in rows if r[0] == "call"} == calls
    assert ext == ".js" or any(r[0] == "import" for r in rows)


def test_parsed_files(spark):
    df = spark.createDataFrame([("r", "a.py", SOURCES[".py"], 1), ("r", "b.py", "def (", 1), (None, "c.ts", SOURCES[".ts"], 1), ("r", None, "x", 1), ("r", "d.md", "x", 1), ("r", "e.go", None, 1)], "repository string, path string, body string, kind int")
    assert {r.path for r in parsing.parsed(df).collect()} == {"a.py", "c.ts"} and parsing.parsed(df.limit(0)).collect() == []


def test_links(spark):
    body = "[a](b.md) ![i](c.md) [d](../e.md#x) [f](https://g.h) [j](/k%20l.md) [m](../../../n.md) [o](#p) [a](./b.md)"
    found = links.markdown_links(spark.createDataFrame([("x/y.md", body), ("z.md", None)], "path string, text string")).collect()
    assert {(r.path, r.target) for r in found} == {("x/y.md", "x/b.md"), ("x/y.md", "e.md"), ("x/y.md", "k l.md")}


def test_layers(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("z", "x"), (None, "c")], "source string, target string")
    assert {r.node: r.layer for r in graph.layers(e).collect()} == {"c": 0, "b": 1, "a": 2, "x": None, "y": None, "z": None}


def test_text_functions(spark):
    one = spark.createDataFrame([("Foo_bar fooBar x $a-b Foo_bar",)], "t string")
    r = one.select(text.query_terms(F.col("t")).alias("q"), text.identifier_parts(F.col("t")).alias("p")).first()
    assert r.q == ["foo_bar", "foobar", "$a-b"] and r.p == ["Foo", "bar", "foo", "Bar", "Foo", "bar"]
    secrets = ["ghp_" + "a" * 24, "AKIA" + "A" * 16, "api_key = 'abcdefghij'", "Bearer " + "x" * 20, "-----BEGIN PRIVATE KEY-----\nx\n-----END PRIVATE KEY-----"]
    rows = spark.createDataFrame([(s,) for s in [*secrets, "nothing here", None]], "t string").select("t", text.contains_secret(F.col("t")).alias("s"), text.redact(F.col("t")).alias("r")).collect()
    assert [x.s for x in rows] == [True] * 5 + [False, None] and all("[REDACTED]" in x.r for x in rows[:5]) and rows[5].r == "nothing here" and rows[2].r == "api_key = '[REDACTED]'".replace("'[", "[")


def test_refresh_stream(spark, tmp_path):
    schema = "row_id long, repository string, snapshot_no int, delivery int, path string, content_hash string"
    rows = [(1, "r", 1, 1, "a", "X"), (2, "r", 2, 1, "./a", "Y"), (2, "r", 2, 1, "a", "Y"), (3, "r", 1, 2, "b", None), (4, None, 1, 1, "c", "Z"), (5, "r", 1, 1, None, "Z")]
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    found = {(r.path, r.row_id, r.content_hash) for r in refresh.refresh(spark, str(tmp_path / "in")).collect()}
    assert found == {("a", 2, "y"), ("b", 3, None)}
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none"))
    assert refresh.refresh(spark, str(tmp_path / "none")).collect() == []


def test_tables_in_the_shared_folder(spark):
    df = session.materialise(spark.range(5), "a")
    more = session.materialise(df.union(df), "b", replaces=[df])
    assert more.count() == 10
    with pytest.raises(Exception):  # noqa: B017, PT011
        df.count()
    assert session.small(more, 10, limit=50) is more
