"""Orphan references and snapshot changes against brute force on small tables."""

import hashlib
import re
from datetime import datetime as T

import pytest

from loamworks.functions.globs import glob_regex
from loamworks.operators import freshness, orphans, snapshots

DAY = [T(2026, 1, d) for d in range(1, 20)]
SCHEMAS = {
    "call_edges": "edge_id long, repository string, source_key string, target_key string, confidence string, captured_at timestamp, ref_key string",
    "symbols": "repository string, symbol_key string, added_at timestamp, removed_at timestamp, at string",
    "reader_relationships": "relation_id long, repository string, source_id string, target_id string, captured_at timestamp",
    "reader_records": "repository string, record_id string, added_at timestamp, removed_at timestamp",
    "knowledge_entries": "entry_id long, repository string, path string, sources array<string>, snapshot_no int, registered_at timestamp",
    "file_rows": "repository string, snapshot_no int, delivery int, path string, content_hash string, digest string",
    "snapshots": "repository string, snapshot_no int, delivery int, input_digest string",
}


def digest(files):
    return hashlib.sha256("\n".join(sorted(f"{p}\0{h}" for p, h in files)).encode()).hexdigest()


def tables(spark, **rows):
    return {t: spark.createDataFrame(rows.get(t, []), s) for t, s in SCHEMAS.items()}


def file_tables(snaps):
    """file_rows and snapshots of {(repository, snapshot_no, delivery): ({path: hash}, full?)}."""
    rows = [(r, n, d, p, h, None) for (r, n, d), (files, _) in snaps.items() for p, h in files.items()]
    heads = [(r, n, d, digest(files.items()).upper() if full else "0" * 64) for (r, n, d), (files, full) in snaps.items()]
    return {"file_rows": rows, "snapshots": heads}


@pytest.fixture
def world(spark):
    snaps = {
        ("r", 1, 1): ({"src/a.py": "aa", "src/b/c.ts": "bb", "d.md": "cc"}, True), ("r", 2, 1): ({"src/a.py": "aa"}, False), ("r", 3, 1): ({"src/a.py": "ab", "src/b/n.ts": "bb", "e.md": "ee"}, True), ("r", 3, 2): ({"zz": "zz"}, False),
        ("s", 1, 1): ({}, True), ("s", 2, 1): ({"x": "1"}, True),
    }
    files = file_tables(snaps)
    files["file_rows"] += [("r", 1, 1, ".\\src\\\\a.py", "AA", None), ("r", 1, 1, None, "q", None), (None, 1, 1, "q", "q", None)]
    return tables(
        spark, **files,
        symbols=[("r", "a.py::f", DAY[1], DAY[5], None), ("r", "./a.py::f", DAY[8], None, None), ("q", "b.py::g", DAY[0], None, None), ("r", None, DAY[0], None, None), ("r", "a.py::h", DAY[0], None, None)],
        call_edges=[
            (1, "r", "m::main", "a.py::f", "high", DAY[2], "x"), (1, "r", "m::main", "a.py::f", "high", DAY[2], "x"), (2, "r", "m::main", ".\\a.py::f", "high", DAY[6], "x"), (3, "r", "m::main", "q::b.py::g", "high", DAY[2], "x"), (4, "r", "m::main", "gone::f", "unresolved", DAY[2], "x"),
            (5, "r", "m::main", None, "high", DAY[2], "x"), (6, "r", "a.py::h", "gone::f", None, DAY[2], "x"), (7, "r", "top::t", "a.py::h", "high", DAY[2], "x"), (8, "r", "over::o", "top::t", "high", DAY[2], "x"), (9, "r", "m::main", "a.py::f", "high", None, "x"),
        ],
        reader_records=[("r", "k/a.md", DAY[0], None), ("r", "k/b.md", DAY[0], DAY[3])],
        reader_relationships=[(1, "r", "k/a.md", "k/b.md#part", DAY[1]), (2, "r", "k/a.md", "k/b.md", DAY[4]), (3, "r", "k/c.md", "k/a.md", DAY[4]), (4, "r", "k/a.md", None, DAY[4])],
        knowledge_entries=[(1, "r", "k/a.md", ["src/a.py", "src/*.py", "**/*.ts", "src/{b/c,x}.ts", "nope/**", None, "*.{rs,md}"], 1, DAY[1]), (2, "r", "k/d.md", ["src/a.py"], 2, DAY[1]), (3, "r", "k/e.md", None, 1, DAY[1])],
    )


def test_direct_and_inherited(spark, world):
    found = {(r.ref_table[0], r.ref_id, r.ref_key): r.round for r in orphans.orphan_references(world).collect()}
    direct = {k for k, n in found.items() if n == 0}
    assert direct == {("c", 2, ".\\a.py::f"), ("c", 6, "gone::f"), ("c", 8, "top::t"), ("c", 9, "a.py::f"), ("r", 2, "k/b.md"), ("k", 1, "nope/**"), ("k", 2, "src/a.py")}
    # a.py::h holds an orphan, so what refers to it is one too; k/a.md as well.
    assert {k: n for k, n in found.items() if n} == {("c", 7, "a.py::h"): 1, ("r", 3, "k/a.md"): 1}
    assert {(r.ref_table[0], r.ref_id) for r in orphans.orphan_references(world, max_round=0).collect()} == {k[:2] for k in direct}
    report = {(r.ref_table, r.month): (r.direct, r.inherited) for r in orphans.orphan_report(orphans.orphan_references(world)).collect()}
    assert report["call_edges", "2026-01"] == (3, 1) and report["call_edges", None] == (1, 0)


def test_circles_end(spark):
    t = tables(spark, call_edges=[(1, "r", "a::a", "b::b", "high", DAY[2], "x"), (2, "r", "b::b", "a::a", "high", DAY[2], "x"), (3, "r", "a::a", "gone::g", "high", DAY[2], "x")], symbols=[("r", "a::a", DAY[0], None, None), ("r", "b::b", DAY[0], None, None)])
    assert {(r.ref_id, r.round) for r in orphans.orphan_references(t).collect()} == {(3, 0), (2, 1), (1, 2)}


def test_empty_tables(spark):
    assert orphans.orphan_references(tables(spark)).collect() == []
    t = tables(spark)
    assert snapshots.snapshot_changes(t["file_rows"], t["snapshots"]).collect() == []


def test_hot_patterns_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(orphans, "SALTED", 7)
    paths = [f"{a}/{b}/{c}{e}" for a in ("src", "lib") for b in ("x", "y", "x/z") for c in ("foo1", "foo2", "bar") for e in (".ts", ".py", ".test.ts")] + ["top.py", "src/a.py"]
    patterns = ["**/foo*.ts", "src/**/x*.py", "**", "**/*.py", "src/*.py", "*.py", "lib/x/*.{py,zz}", "lib/**/bar.ts", "lib/**/z/*", "zzz/**", "src/*/foo?.ts", "**/b*r.test.ts", "{src,lib}/x/foo1.ts", "src/x/{z/foo1,q}.ts", "*/y/**"]
    files = spark.createDataFrame([("r", 1, p) for p in paths] + [("q", 1, "only.py")], "repository string, snapshot_no int, path string")
    wanted = spark.createDataFrame([(r, 1, p) for r in ("r", "q") for p in [*patterns, "src/a.py", "none.py"]], "repository string, snapshot_no int, key string")
    found = {(r.repository, r.key) for r in orphans.held_sources(wanted, files).collect()}
    held = {"r": paths, "q": ["only.py"]}
    expected = {(r, p) for r in ("r", "q") for p in [*patterns, "src/a.py", "none.py"] if any(x == p or (re.search(r"[*{]", p) and re.match(glob_regex(p), x)) for x in held[r])}
    assert found == expected


def test_changes(spark, world):
    found = {(r.repository, r.snapshot_no, r.path, r.change_kind) for r in snapshots.snapshot_changes(world["file_rows"], world["snapshots"]).collect()}
    assert found == {("r", 3, "src/a.py", "changed"), ("r", 3, "src/b/c.ts", "removed"), ("r", 3, "src/b/n.ts", "added"), ("r", 3, "d.md", "removed"), ("r", 3, "e.md", "added"), ("s", 2, "x", "added")}


def test_moves_and_bindings(spark, world):
    counted = snapshots.counted_snapshots(world["file_rows"], world["snapshots"])
    files = snapshots.snapshot_files(world["file_rows"], counted)
    assert {(r.path, r.state) for r in freshness.move_candidates(files).collect()} == {("src/b/c.ts", "moved"), ("d.md", "missing")}
    entries = spark.createDataFrame([(1, "r", ["src/a.py"], 1, DAY[3]), (2, "r", ["e.md"], 3, DAY[3]), (3, "r", ["e.md"], 3, None), (4, "r", ["d.md", "e.md"], 1, DAY[3]), (5, "r", ["src/**"], 1, None), (6, "r", ["lib/**"], 1, None)], "entry_id long, repository string, sources array<string>, snapshot_no int, verified_at timestamp")
    assert {(r.entry_id, r.state) for r in freshness.binding_freshness(entries, files, counted).collect()} == {(1, "stale"), (2, "fresh"), (3, "unverified"), (4, "missing")}
    changes = snapshots.snapshot_changes(world["file_rows"], world["snapshots"])
    impact = {r.entry_id: r.outcome for r in freshness.pattern_impact(entries, changes, counted).collect()}
    assert impact == {1: "update", 2: "update", 3: "update", 4: "update", 5: "update", 6: "no-op"}
    counters = {(r.repository, r.snapshot_no): (r.reused, r.changed, r.added, r.removed) for r in freshness.refresh_counters(files, changes).collect()}
    assert counters == {("r", 3): (0, 1, 2, 2), ("s", 2): (0, 0, 1, 0)}


def test_overlapping_owners(spark):
    claims = spark.createDataFrame([("r", "a", 1), ("r", "a", 1), ("r", "a/b", 2), ("r", "a/b/c", 3), ("r", "ab", 4), ("r", "a/b", 5), ("q", "a", 6)], "repository string, path string, owner int")
    found = {(r.repository, r.path): (r.owners, r.others) for r in freshness.overlapping_owners(claims).collect()}
    assert found == {("r", "a"): (1, 3), ("r", "a/b"): (2, 2), ("r", "a/b/c"): (1, 3), ("r", "ab"): (1, 0), ("q", "a"): (1, 0)}
