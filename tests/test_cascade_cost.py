"""What the cascade of problem 1 does only once: reading edges for their two readings, sending records reached, mending paths."""

import re

from pyspark.sql import functions as F

from loamworks.functions.paths import canonical
from loamworks.operators import orphans
from tests.test_cascade import DAY, chain, world


def test_records_reached_are_sent_once(spark, monkeypatch):
    edges, alive = chain(12)
    edges, alive = edges + [(f"s{i}", "gone") for i in range(40)], alive + [f"s{i}" for i in range(40)]
    sent, held = [], orphans.small

    def noted(df, row_bytes, *limit):
        if df.columns == ["holder"]:
            sent.append(df.count())
        return held(df, row_bytes, *limit)

    monkeypatch.setattr(orphans, "small", noted)
    found = {r.ref_id: r.round for r in orphans.orphan_references(world(spark, edges, alive)).collect()}
    assert found == {i: 11 - i for i in range(12)} | {12 + i: 0 for i in range(40)}
    # 52 records are reached in 12 rounds; each is held against the links a few times, not in all later rounds.
    assert sum(sent) < 3 * 52


def test_edges_are_read_once_for_both_readings(spark):
    tables = world(spark, [], ["a", "b"])
    rows = [("r", "a::f"), ("r", "r::b::f"), ("q", "r::b::f"), ("q", "r::c::f"), ("r", "c::f"), (None, "r::a::f"), (None, "a::f"), ("q", "q::r::b::f")]
    edges = spark.createDataFrame([(i, r, "m::m", t, "high", DAY, None) for i, (r, t) in enumerate(rows)], tables["call_edges"].schema)
    found = orphans._direct_by_lifetime(orphans.edge_references(edges), orphans.lifetimes(tables["symbols"], orphans.symbol_key(F.col("symbol_key"))))
    assert {r.ref_id for r in found.select("ref_id").collect()} == {3, 4, 6, 7}
    leaves = found._jdf.queryExecution().optimizedPlan().collectLeaves()
    assert sum("edge_id" in leaves.apply(i).toString() for i in range(leaves.size())) == 1


def test_canonical_leaves_nothing_out(spark):
    paths = ["a/b.c", "", "/", "./a", "././a", ".//a", "a//b", "a\\b", "\\\\a\\/b", ".\\a", "a/./b", "../a", "a/", "é/./ü", ".", "./", ".a", "/./a", None]
    made = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string").select("i", canonical(F.col("p")).alias("c"), canonical(F.substring_index("p", "#", 1)).alias("d")).collect()
    expected = {i: None if p is None else re.sub(r"^(\./)+", "", re.sub(r"[\\/]+", "/", p)) for i, p in enumerate(paths)}
    assert {r.i: r.c for r in made} == expected and {r.i: r.d for r in made} == expected
