"""Places of known items against the whole ranked search."""

import random

import pytest

from loamworks.operators import known_items, search
from loamworks.plans import retrieval

LIMIT = 3


def corpus(n, seed=3):
    draw = random.Random(seed)
    words = ["the", "scope", "of", "cursor", "branch", "fold-branch", "café", "index", "naïve", "b", "cursor-branch-fold", "cursor-cursor"]
    files = []
    for i in range(n):
        title = " ".join(draw.choices(words, weights=range(len(words), 0, -1), k=draw.randint(1, 4)))
        lines = [f"# {title}"] + [" ".join(draw.choices(words, k=draw.randint(0, 9))) for _ in range(draw.choice((1, 3, 190)))]
        files.append((f"d{i % 7}/f{i}.md", None if i % 19 == 0 else "\n".join(lines), None if i % 5 == 0 else title))
    return files + files[:5]


def tables(spark, files):
    files = spark.createDataFrame(files, "path string, text string, title string")
    relevant = files.where("title is not null").selectExpr("title as query_id", "path")
    return files, relevant.selectExpr("query_id", "query_id as query").distinct(), relevant


def positions(spark, files, limit=LIMIT):
    files, queries, relevant = tables(spark, files)
    return {r.query_id: (r.path, r.position) for r in known_items.known_item_positions(search.chunk_windows(files), queries, relevant, limit).collect()}


@pytest.mark.parametrize("limit, slice_, term_bytes", [(1, 500, 200), (3, 7, 200), (60, 500, 200), (3, 500, 1_000_000)])
def test_places_equal_those_of_the_whole_search(spark, monkeypatch, limit, slice_, term_bytes):
    monkeypatch.setattr(known_items, "SLICE", slice_)
    monkeypatch.setattr(known_items, "TERM_BYTES", term_bytes)
    files, queries, relevant = tables(spark, corpus(90))
    best = search.best_chunks(search.ranked_chunks(search.index(search.chunk_windows(files)), queries)).select("query_id", "path", "rank")
    expected = {}
    for r in search.top(best, limit, "rank", "path").join(relevant.distinct(), ["query_id", "path"]).collect():
        expected[r.query_id] = min(expected.get(r.query_id, ("", 99)), (r.path, r.position), key=lambda x: x[1])
    assert positions(spark, corpus(90), limit) == expected and expected


def test_texts_of_one_path_have_ranks_of_their_own(spark):
    rest = [(f"x{i}", "nothing to see", None) for i in range(6)]
    files = [("a.md", "needle in some long text of many words", None), ("a.md", "needle in another long text of many more words", None), ("b.md", "needle needle in some text", "needle"), *rest]
    assert positions(spark, files) == {"needle": ("b.md", 1)}


def test_nothing_to_find(spark):
    assert positions(spark, []) == {} and positions(spark, [("a", "text", "!"), ("b", None, "text of b")]) == {}


def test_pairs_of_queries_and_files_are_not_shuffled(spark, monkeypatch):
    n = 300
    files = spark.createDataFrame([(f"d/f{i}.md", f"# scope of the thing no. {i:03}\ntext", f"scope of the thing no. {i:03}", None, None) for i in range(n)], "path string, text string, title string, lang string, doc_type string")
    monkeypatch.setattr(retrieval, "documents", lambda spark, d: files)
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def written():
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() + s.outputRecords() for s in stages()}

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        every = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return [every.apply(i) for i in range(every.size())]

    before = written()
    row = retrieval.retrieval_metrics(spark, "").first()
    moved = sum(v for k, v in written().items() if k not in before)
    assert (row.n_queries, row.recall_1, row.mean_reciprocal_rank) == (n, 1.0, 1.0)
    assert 0 < moved < n * n / 5
