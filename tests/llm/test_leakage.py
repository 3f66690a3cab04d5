from loamworks.llm import leakage, tokens
from loamworks.llm.leakage import leaked

WORDS = " ".join(f"w{i}" for i in range(30))
SIGNS = "".join(chr(0x4E00 + i) for i in range(40))
ITEMS = "item_id long, lang string, passage string, text string"
DOCS = "doc_id long, text string, lang string, source string"


def tables(spark):
    docs = [
        (1, "a " + ", ".join(f"W{i}" for i in range(3, 15)) + " b", "en", "s"), (2, " ".join(f"w{i}" for i in range(3, 14)), None, "s"), (3, "x" + SIGNS[5:15] + "。\n" + SIGNS[15:25] + "y", "zh", None), (4, SIGNS[5:24], "zh", None),
        (5, None, None, None), (6, "", "en", "s"), (1, WORDS, "en", "s"), (None, WORDS, "en", "s"), (7, WORDS * 200, "en", "hot"),
    ]
    items = [(1, "en", WORDS, None), (1, "en", WORDS, None), (2, "zh-Hans", SIGNS, None), (3, None, "short", None), (4, "ja", None, None), (5, None, WORDS, None)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)


EXPECTED = [(1, 1), (1, 5), (3, 2), (7, 1), (7, 5)]


def test_found(spark):
    docs, items = tables(spark)
    assert sorted(map(tuple, leaked(docs, items).collect())) == EXPECTED
    assert leaked(docs, items.limit(0)).collect() == [] and leaked(docs.limit(0), items).collect() == []


def test_the_shuffle_finds_the_same(spark, monkeypatch):
    docs, items = tables(spark)
    monkeypatch.setattr(leakage, "ITEMS_LIMIT", 10)
    assert sorted(map(tuple, leaked(docs, items).collect())) == EXPECTED


def test_small_blocks_find_the_same(spark, monkeypatch):
    docs, items = tables(spark)
    monkeypatch.setattr(leakage, "PASSAGE_BLOCK", 50)
    assert sorted(map(tuple, leaked(docs, items).collect())) == EXPECTED


def test_ids_and_counts(spark):
    docs, _ = tables(spark)
    e = tokens.encoder(tokens.VOCABULARY)
    rows = tokens.token_ids(docs).collect()
    assert len(rows) == docs.count() and all(r.ids == e.whole(t.text or "") for r, t in zip(sorted(rows, key=lambda r: (r.doc_id or 0, len(r.ids))), sorted(docs.collect(), key=lambda t: (t.doc_id or 0, len(e.whole(t.text or "")))), strict=True))
    counts = {r.source: (r.texts, r.tokens) for r in tokens.token_counts(docs, ["source"]).collect()}
    assert counts["s"][0] == 5 and counts["hot"] == (1, len(e.whole(WORDS * 200))) and counts[None][0] == 3
    assert tokens.token_ids(docs.limit(0)).collect() == []
