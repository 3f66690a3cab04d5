"""Evaluation texts that leak into training text.

A document holds an item if at least 12 consecutive words of it are consecutive in the item's passage; for items in
Chinese or Japanese at least 20 consecutive letters or digits, whatever stands between them.

Wu-Manber search for many patterns: the patterns are all windows of 12 words (20 characters) of the passages. A window of
the text is inspected from its end: the block of the last two words (three characters) tells by the shift table how far
no pattern can end; only where the shift is zero the bucket of that block is opened, and the window is compared with the
patterns in it. The tables are made from passages only, once per worker, and are sent out in blocks of a bounded size, each
of which is a pass over all documents. Passages of more than ``ITEMS_LIMIT`` characters together are not brought to the
driver: windows of both sides then meet by a digest, in a shuffle.

Defined results: a word is a longest run of letters and digits, in lower case; null texts and passages hold nothing;
passages shorter than a window have no case; equal windows of several items count for each; repeated rows give
one row; an item's null lang is one of words; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

WORDS, CHARACTERS = 12, 20
#: Words (characters) of the block that the shift table is asked for.
WORD_BLOCK, CHARACTER_BLOCK = 2, 3
#: Characters of passages whose tables are held at once (a worker needs about 150 times as many bytes), and that are searched in passes.
PASSAGE_BLOCK, ITEMS_LIMIT = 1 << 20, 4 << 20
_RUN = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Longest runs of letters and digits in lower case."""
    if "İ" in text:  # its lower case holds a mark, which is no letter
        return [w.lower() for w in _RUN.findall(text)]
    return _RUN.findall(text.lower())


def by_characters(lang: str | None) -> bool:
    return (lang or "").lower().replace("_", "-").split("-")[0] in ("zh", "ja")


class WuManber:
    """Patterns of one length over a sequence of symbols; finds the owners of those that occur in a text."""

    def __init__(self, length: int, block: int) -> None:
        self.length, self.block, self.far = length, block, length - block + 1
        self.shift: dict = {}
        self.buckets: dict = {}

    def add(self, symbols: list[str] | str, owner: int) -> None:
        """All windows of ``symbols`` become patterns of ``owner``."""
        b = self.block
        for start in range(len(symbols) - self.length + 1):
            window = symbols[start : start + self.length]
            for end in range(b, self.length + 1):
                key = self._key(window, end)
                self.shift[key] = min(self.shift.get(key, self.far), self.length - end)
            self.buckets.setdefault(self._key(window, self.length), {}).setdefault(self._whole(window), set()).add(owner)

    def _key(self, symbols: list[str] | str, end: int) -> object:
        part = symbols[end - self.block : end]
        return part if isinstance(part, str) else tuple(part)

    @staticmethod
    def _whole(window: list[str] | str) -> object:
        return window if isinstance(window, str) else tuple(window)

    def owners(self, symbols: list[str] | str) -> set[int]:
        found: set[int] = set()
        end, n, far = self.length, len(symbols), self.far
        shift, text = self.shift.get, isinstance(symbols, str)
        b = self.block
        while end <= n:
            part = symbols[end - b : end]
            key = part if text else tuple(part)
            step = shift(key, far)
            if step:
                end += step
                continue
            window = symbols[end - self.length : end]
            found |= self.buckets[key].get(window if text else tuple(window), _NONE)
            end += 1
        return found


_NONE: frozenset[int] = frozenset()


def tables(items: Iterable[tuple[int, str | None, str | None]]) -> tuple[WuManber, WuManber]:
    of_words, of_characters = WuManber(WORDS, WORD_BLOCK), WuManber(CHARACTERS, CHARACTER_BLOCK)
    for item_id, lang, passage in items:
        if passage is not None and item_id is not None:
            if by_characters(lang):
                of_characters.add("".join(words(passage)), item_id)
            else:
                of_words.add(words(passage), item_id)
    return of_words, of_characters


def leaked_items(text: str, searched: tuple[WuManber, WuManber]) -> set[int]:
    run = words(text)
    found = searched[0].owners(run) if searched[0].buckets else set()
    if searched[1].buckets:
        found = found | searched[1].owners("".join(run))
    return found


_BUILT: dict[int, tuple[WuManber, WuManber]] = {}


def _tables_once(items: tuple[tuple, ...]) -> tuple[WuManber, WuManber]:
    """The tables of a block; a worker keeps those of one block."""
    key = hash(items)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = tables(items)
    return _BUILT[key]


def _search(items: tuple[tuple, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searched = _tables_once(items)
        schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64())])
        for batch in batches:
            rows = [(d, i) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if d is not None and (text := t.as_py()) for i in sorted(leaked_items(text, searched))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], schema=schema)

    return run


def _blocks(items: Iterable) -> Iterator[tuple[tuple, ...]]:
    """Items in blocks of at most ``PASSAGE_BLOCK`` characters (one item at least)."""
    block, size = [], 0
    for r in items:
        if block and size + len(r.passage) > PASSAGE_BLOCK:
            yield tuple(block)
            block, size = [], 0
        block.append((r.item_id, r.lang, r.passage))
        size += len(r.passage)
    if block:
        yield tuple(block)


def _digests(symbols: list[str] | str, length: int, mark: bytes) -> set[bytes]:
    join = (lambda w: w) if isinstance(symbols, str) else "\0".join
    return {hashlib.blake2b(mark + join(symbols[i : i + length]).encode("utf-8", "surrogatepass"), digest_size=16).digest() for i in range(len(symbols) - length + 1)}


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, window) of rows (id, lang, text); the lang ``both`` gives windows of words and of characters."""
    for batch in batches:
        for i, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            run, found = words(text.as_py()), set()
            if lang == "both" or not by_characters(lang):
                found |= _digests(run, WORDS, b"w")
            if lang == "both" or by_characters(lang):
                found |= _digests("".join(run), CHARACTERS, b"c")
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(found), pa.int64()), pa.array(sorted(found), pa.binary())], names=["id", "window"])


def leaked_by_shuffle(texts: DataFrame, stated: DataFrame) -> DataFrame:
    """The same rows as :func:`leaked` for passages of any size: distinct windows meet by a digest of 16 bytes, hot ones once per document."""
    of_items = stated.select("item_id", "lang", "passage").mapInArrow(_windows, "id long, window binary").select(F.col("id").alias("item_id"), "window")
    of_texts = texts.where("doc_id is not null").select("doc_id", F.lit("both"), "text").mapInArrow(_windows, "id long, window binary").select(F.col("id").alias("doc_id"), "window")
    return of_texts.join(of_items, "window").select("doc_id", "item_id").distinct()


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id), distinct: each document with each item whose passage it holds in part or whole."""
    ship(documents.sparkSession)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    stated = items.select(F.col("item_id").cast("long").alias("item_id"), "lang", "passage").where("item_id is not null and passage is not null").distinct()
    size = stated.agg(F.sum(F.length("passage"))).first()[0] or 0
    if size > ITEMS_LIMIT:
        return leaked_by_shuffle(texts, stated)
    passes = [texts.mapInArrow(_search(block), "doc_id long, item_id long") for block in _blocks(sorted(stated.collect(), key=lambda r: (r.item_id, r.lang or "", r.passage)))]
    if not passes:
        return texts.sparkSession.createDataFrame(pd.DataFrame({"doc_id": [], "item_id": []}), "doc_id long, item_id long")
    return reduce(DataFrame.unionByName, passes).distinct()


def leakage_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """Documents per item; items that leaked nowhere have 0."""
    counts = found.groupBy("item_id").agg(F.count("*").alias("documents"))
    return items.select("item_id", "task", "lang").distinct().join(counts, "item_id", "left").withColumn("documents", F.coalesce("documents", F.lit(0)))
