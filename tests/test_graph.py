import random

from loamworks.operators import graph, resolution, spans

E = "source string, target string"


def edges(spark, rows):
    return spark.createDataFrame(rows, E)


def brute_components(nodes, rows):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in rows:
            if a and b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def test_components(spark):
    rng = random.Random(1)
    rows = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(40)] + [(f"c{i}", f"c{i + 1}") for i in range(40)] + [(None, "n1"), ("n1", None)]
    nodes = {f"n{i}" for i in range(60)} | {f"c{i}" for i in range(41)}
    found = {r.node: r.component for r in graph.components(spark.createDataFrame([(n,) for n in nodes], "node string"), edges(spark, rows)).collect()}
    assert found == brute_components(nodes, rows)


def test_walks(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "b"), ("d", "e"), ("x", None)])
    seeds = spark.createDataFrame([("a",), (None,)], "node string")
    assert {(r.node, r.depth) for r in graph.walk(seeds, e, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {r.node for r in graph.walk(seeds, e, 9).collect()} == set("abcde")
    assert graph.walk(seeds.limit(0), e, 2).collect() == []


def test_unresolved_edges_end_a_trace(spark):
    e = spark.createDataFrame([("a", "b", "unresolved"), ("b", "c", "high"), ("a", "d", "high"), ("d", "e", None)], E + ", confidence string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {(r.source, r.target, r.depth) for r in graph.trace(seeds, e, 3).collect()} == {("a", "b", 1), ("a", "d", 1), ("d", "e", 2)}


def test_cycles(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("c", "c"), ("d", "e"), ("e", "f"), ("f", "d"), ("g", "a"), ("a", "h")] + [(f"r{i}", f"r{(i + 1) % 8}") for i in range(8)])
    assert {(r.node, r.length) for r in graph.cycle_nodes(e, 6).collect()} == {("a", 2), ("b", 2), ("c", 1), ("d", 3), ("e", 3), ("f", 3)}


def test_degrees_and_induced_edges(spark):
    e, nodes = edges(spark, [("a", "b"), ("b", "a"), ("a", "a"), ("b", "c")]), spark.createDataFrame([("a",), ("b",), ("z",)], "node string")
    assert {(r.node, r.degree) for r in graph.degrees(nodes, e).collect()} == {("a", 1), ("b", 2), ("z", 0)}
    assert {(r.source, r.target) for r in graph.induced(e, nodes).collect()} == {("a", "b"), ("b", "a"), ("a", "a")}


def test_a_second_definition_makes_a_name_unresolved(spark):
    refs = spark.createDataFrame([(1, "r", "p", "f"), (2, "r", "q", "g"), (3, "r", "q", "h")], "edge_id int, repository string, path string, name string")
    defs = spark.createDataFrame([("r", "p", "f", "p::f"), ("r", "q", "f", "q::f"), ("r", "p", "g", "p::g"), ("r", "p", "g", "p::g"), (None, "p", "h", "x")], "repository string, path string, symbol_name string, definition string")
    from pyspark.sql import functions as F

    c = F.col
    own = resolution.candidates(defs, {"repository": c("repository"), "path": c("path"), "name": c("symbol_name")}, "file")
    every = resolution.candidates(defs, {"repository": c("repository"), "name": c("symbol_name")}, "repository")
    found = {r.edge_id: (r.rung, r.definition, r.confidence) for r in resolution.ladder(refs, [("file", own, ["repository", "path", "name"]), ("repository", every, ["repository", "name"])]).collect()}
    assert found == {1: ("file", "p::f", "high"), 2: ("repository", "p::g", "high"), 3: ("none", None, "unresolved")}
    found = {r.edge_id: (r.n_candidates, r.confidence) for r in resolution.ladder(refs, [("repository", every, ["repository", "name"])]).collect()}
    assert found[1] == (2, "unresolved")


def test_an_early_refusal_is_final(spark):
    from pyspark.sql import functions as F

    c = F.col
    refs = spark.createDataFrame([(1, "r", "p", "f")], "edge_id int, repository string, path string, name string")
    defs = spark.createDataFrame([("r", "p", "f", "p::A.f"), ("r", "p", "f", "p::B.f")], "repository string, path string, symbol_name string, definition string")
    one = spark.createDataFrame([("r", "z", "f", "z::f")], "repository string, path string, symbol_name string, definition string")
    rungs = [("file", resolution.candidates(defs, {"repository": c("repository"), "path": c("path"), "name": c("symbol_name")}, "file"), ["repository", "path", "name"]), ("repository", resolution.candidates(one, {"repository": c("repository"), "name": c("symbol_name")}, "repository"), ["repository", "name"])]
    row = resolution.ladder(refs, rungs).first()
    assert (row.rung, row.definition, row.confidence) == ("file", None, "unresolved")


def test_chains(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("m", "n"), ("m", "o"), ("l0", "l1"), ("l1", "l2"), ("l2", "l3"), ("l3", "l4"), ("l4", "l5"), ("l5", "l6")])
    found = {r.origin: (r.n_ends, r.definition) for r in resolution.chain_ends(e, 5).collect()}
    assert found["a"] == (1, "c") and found["x"] == (0, None) and found["m"] == (2, None) and found["l0"] == (0, None) and found["l1"] == (1, "l6")


def test_spans(spark):
    rows = spark.createDataFrame([("p", 5), ("p", 100), ("p", 700), ("q", 1)], "path string, line int")
    s = spark.createDataFrame([("p", "outer", 1, 600), ("p", "inner", 4, 6), ("p", "late", 5, 7), ("p", "broken", 9, 8)], "path string, symbol string, start_line int, end_line int")
    assert {(r.path, r.line, r.symbol) for r in spans.enclosing(rows, s, ["path"]).collect()} == {("p", 5, "late"), ("p", 100, "outer"), ("p", 700, None), ("q", 1, None)}
    ranges = spark.createDataFrame([("p", 6, 2), ("p", 601, 3), ("p", 590, 0)], "path string, start int, count int")
    assert {(r.start, r.symbol) for r in spans.overlapping(ranges, s, ["path"]).collect()} == {(6, "outer"), (6, "inner"), (6, "late"), (601, None)}


def test_changed_ranges(spark):
    diff = "diff --git a/x b/x\n@@ -3 +3,2 @@ f\n-a\n+b\n+c\n@@ -10,0 +12,4 @@\n+d\n"
    found = spans.changed_ranges(spark.createDataFrame([("x", diff), ("y", ""), ("z", None)], "path string, diff string")).collect()
    assert [tuple(r) for r in found] == [("x", 3, 1, 3, 2), ("x", 10, 0, 12, 4)]


def test_running_sums_over_ranges(spark):
    from pyspark.sql import functions as F

    rows = [("hot" if i % 3 else None, i, i % 7) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(7)
    total, expected = {}, {}
    for k, i, v in rows:
        total[k] = total.get(k, 0) + v
        expected[i] = total[k]
    assert {r.i: r.total for r in spans.running_sum(df, ["k"], ["i"], F.col("v")).collect()} == expected
