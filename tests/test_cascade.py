"""The cascade behind problem 1: p1_found runs it to its end, and its rounds equal brute force however the sides are joined."""

import random
from datetime import datetime as T

import pytest

from loamworks.operators import orphans
from loamworks.plans import data_quality
from tests.test_orphans import SCHEMAS

DAY = T(2026, 1, 1)


def world(spark, edges, alive):
    rows = {
        "call_edges": [(i, "r", f"{a}::f", f"{b}::f", "high", DAY, None) for i, (a, b) in enumerate(edges)] * 2,
        "symbols": [("r", f"{x}::f", DAY, None, None) for x in alive],
    }
    return {t: spark.createDataFrame(rows.get(t, []), s) for t, s in SCHEMAS.items()}


def chain(n):
    return [(f"n{i}", f"n{i + 1}") for i in range(n)], [f"n{i}" for i in range(n)]


def test_found_runs_the_cascade_to_its_fixpoint(spark, monkeypatch):
    edges, alive = chain(6)
    rounds, held = [], orphans.materialise

    def noted(df, name="step", replaces=()):
        out = held(df, name, replaces)
        if name == "records":
            rounds.append(out.count())
        return out

    monkeypatch.setattr(orphans, "materialise", noted)
    monkeypatch.setattr(data_quality, "_orphan_tables", lambda spark, d: world(spark, edges, alive))
    assert [tuple(r) for r in data_quality.p1_found(spark, "").collect()] == [("call_edges", 5, "n6::f")]
    assert rounds == [1] * 6 + [0]


@pytest.mark.parametrize("broadcast", [True, False])
def test_rounds_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(orphans, "MERGED", 2)
    if not broadcast:
        monkeypatch.setattr(orphans, "small", lambda df, row_bytes, limit=0: df)
    draw = random.Random(5)
    nodes = [f"n{i}" for i in range(60)]
    edges = [(draw.choice(nodes), draw.choice(nodes)) for _ in range(70)] + [(f"m{i}", f"m{i + 1}") for i in range(7)]
    alive = [x for x in nodes if draw.random() > 0.05] + [f"m{i}" for i in range(7)]
    expected = {i: 0 for i, (_, b) in enumerate(edges) if b not in alive}
    at = {}
    for i in expected:
        at[edges[i][0]] = 1
    for n in range(1, len(edges)):
        for i, (a, b) in enumerate(edges):
            if at.get(b) == n and i not in expected:
                expected[i] = n
                at.setdefault(a, n + 1)
    assert {r.ref_id: r.round for r in orphans.orphan_references(world(spark, edges, alive)).collect()} == expected and max(expected.values()) == 6
