"""Encoding of texts with a public byte-level BPE vocabulary.

Forced-boundary splitting: a pair of bytes that occurs inside no token of the vocabulary can't be merged, so a cut
between the two is certain. A text is cut at the first such pair after every ``FRAGMENT`` characters that stands on a
border of characters which the splitting pattern leaves alone too: not after white space (its runs look ahead) and not
before an apostrophe (contractions). The fragments are encoded independently and their ids concatenated, so that no
call sees a long text as a whole, whatever it holds.

The vocabulary is a file of ranks whose path is a parameter; each Python worker reads it once.

Defined results: null and empty texts give an empty list; strings of special tokens are ordinary text; texts of any
length are encoded whole; equal texts give equal ids; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Published splitting pattern of this family of vocabularies (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space of Unicode (fixed values).
SPACES = frozenset(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
APOSTROPHE = "'"
#: Least characters of a fragment but the last.
FRAGMENT = 256


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


def share_vocabulary(spark: SparkSession, path: str) -> None:
    """Sends the file to the executors of a cluster, once; workers that have no file at its path read what was sent."""
    sc = spark.sparkContext
    if (sc.applicationId, path) not in _SHARED and not sc.master.startswith("local") and os.path.exists(path):
        sc.addFile(path)
        _SHARED.add((sc.applicationId, path))


_SHARED: set[tuple[str, str]] = set()


def free_pairs(ranks: dict[bytes, int]) -> list[bytes]:
    """For each first byte 256 flags: whether the pair with a second byte occurs inside no token."""
    free = [bytearray(b"\1" * 256) for _ in range(256)]
    for token in ranks:
        for a, b in zip(token, token[1:], strict=False):
            free[a][b] = 0
    return [bytes(x) for x in free]


def fragments(text: str, free: list[bytes], least: int = FRAGMENT) -> list[str]:
    """``text`` in parts of at least ``least`` characters, cut at certain borders only."""
    out, start, at, n = [], 0, least, len(text)
    while at < n:
        a, b = text[at - 1], text[at]
        if a not in SPACES and b != APOSTROPHE and free[a.encode("utf-8", "replace")[-1]][b.encode("utf-8", "replace")[0]]:
            out.append(text[start:at])
            start, at = at, at + least
        else:
            at += 1
    return [*out, text[start:]]


class Encoder:
    """Encodes texts by fragments; ``encode_ordinary`` of the whole text gives the same ids."""

    def __init__(self, path: str) -> None:
        import tiktoken

        ranks = read_ranks(path)
        self.free = free_pairs(ranks)
        self.whole = tiktoken.Encoding("loamworks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str | None) -> list[int]:
        return [*chain.from_iterable(map(self.whole, fragments(text, self.free)))] if text else []


@lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _encode(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            lists = [e.encode(t.as_py()) for t in batch.column(1)]
            flat = pa.array(np.fromiter(chain.from_iterable(lists), np.int32))
            offsets = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["doc_id", "ids"])

    return run


def token_ids(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every row; one pass over the two columns, no shuffle."""
    ship(documents.sparkSession)
    share_vocabulary(documents.sparkSession, vocabulary)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encode(vocabulary), "doc_id long, ids array<int>")


def _count(path: str, n_keys: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            n = pa.array([len(e.encode(t.as_py())) for t in batch.column(n_keys)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keys], n], names=[*batch.schema.names[:n_keys], "n"])

    return run


def token_counts(documents: DataFrame, by: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """Texts and tokens per group; the columns to group by go through the encoding, every row counts once."""
    ship(documents.sparkSession)
    share_vocabulary(documents.sparkSession, vocabulary)
    rows = documents.select(*by, F.col("text").cast("string").alias("text"))
    fields = ", ".join(f"`{c}` {k}" for c, k in rows.drop("text").dtypes)
    counts = rows.mapInArrow(_count(vocabulary, len(by)), f"{fields}, n long")
    return counts.groupBy(*by).agg(F.count("*").alias("texts"), F.sum("n").alias("tokens"))
