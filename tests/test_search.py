"""Ranked search against brute force and against the full-text engine of the standard library."""

import sqlite3
from math import log

import pytest

from loamworks.operators import search

TEXTS = {
    "a/readmeFile.md": "# Cursor notes\nThe cursor moves. The cursor stops.\nfoldBranch is called", "a/b.md": "Nothing here but a fold of a branch", "c/cursor.md": "branch cursor", "c/d.md": None, "c/e.md": "  \n", "c/f.md": "café CURSOR x", "g/h.md": "cursor-branch and branch-cursor",
}
QUERIES = {1: "cursor", 2: "branch fold", 3: "cursor-branch", 4: "cafe", 5: "", 6: "Cursor cursor CURSOR"}


def tables(spark):
    return spark.createDataFrame(list(TEXTS.items()), "path string, text string"), spark.createDataFrame(list(QUERIES.items()), "query_id int, query string")


def ranks(spark):
    files, queries = tables(spark)
    return {(r.query_id, r.path): r.rank for r in search.ranked_chunks(search.index(search.chunk_windows(files)), queries).collect()}


def test_ranks_equal_those_of_the_full_text_engine(spark):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(path, filename, symbol, heading, body, tokenize=\"unicode61 tokenchars '_$'\")")
    files, _ = tables(spark)
    paths = []
    from pyspark.sql import functions as F

    from loamworks.functions.text import lexical_body

    for r in search.chunk_windows(files).select("path", "heading", lexical_body(F.col("body")).alias("body")).collect():
        paths.append(r.path)
        db.execute("insert into t values (?, ?, ?, ?, ?)", (r.path, r.path.rsplit("/", 1)[-1], None, r.heading, r.body))
    found = ranks(spark)
    n = 0
    for q, text in ((1, '"cursor"'), (2, '"branch" OR "fold"'), (3, '"cursor-branch"'), (4, '"cafe"')):
        for path, rank in db.execute("select path, bm25(t, 2.5, 3.0, 2.0, 1.5, 1.0) from t where t match ?", (text,)):
            assert found.pop((q, path)) == pytest.approx(rank, abs=1e-6)
            n += 1
    assert n > 8 and {k[0] for k in found} == {6}
    assert log(2) > 0 and len(paths) == 5


def test_one_row_per_file_before_the_limit(spark):
    many = "\n".join("needle" for _ in range(500))
    files = spark.createDataFrame([("many.md", many), ("few.md", "needle"), ("few.md", "needle")], "path string, text string")
    queries = spark.createDataFrame([(1, "needle")], "query_id int, query string")
    best = search.best_chunks(search.ranked_chunks(search.index(search.chunk_windows(files)), queries))
    assert sorted(r.path for r in search.top(best, 2, "rank", "path").collect()) == ["few.md", "many.md"]


def test_windows(spark):
    files = spark.createDataFrame([("x", "\r\n".join(str(i) for i in range(250)))], "path string, text string")
    assert sorted((r.start_line, r.end_line) for r in search.chunk_windows(files).collect()) == [(1, 100), (81, 180), (161, 250), (241, 250)]


def test_symbol_windows(spark):
    files = spark.createDataFrame([("x", "a\nb\nc")], "path string, text string")
    symbols = spark.createDataFrame([("x", "f", 2, 3), ("x", "f", 2, 3), ("x", "g", 9, 9), ("y", "h", 1, 1)], "path string, qualname string, start_line int, end_line int")
    assert [(r.symbol, r.body) for r in search.symbol_windows(files, symbols).collect()] == [("f", "b\nc")]


def test_links_take_a_fourth_of_the_places(spark):
    found = spark.createDataFrame([(1, f"p{i:02}", -10.0 + i, i) for i in range(1, 13)], "query_id int, path string, rank double, position int")
    links = spark.createDataFrame([("p01", "x"), ("x", "p01"), ("p02", "y"), ("p02", "z"), ("p03", "p04"), ("q", "q")], "source string, target string")
    lines = spark.createDataFrame([("x",), ("y",), ("z",), ("p01",)], "path string")
    rows = sorted((r.position, r.path, r.rank, r.reason) for r in search.linked(found, links, lines, 8).collect())
    assert [r[1] for r in rows] == ["p01", "p02", "p03", "p04", "p05", "p06", "x", "y"] and rows[6][2:] == (45.0, "linked-from:p01")


def test_empty_tables(spark):
    files, queries = tables(spark)
    index = search.index(search.chunk_windows(files.limit(0)))
    assert search.ranked_chunks(index, queries).collect() == [] and search.ranked_chunks(search.index(search.chunk_windows(files)), queries.limit(0)).collect() == []
