"""Places of known items in a ranked search, for as many queries as there are items.

A ranked search gives a row for each query and each file that holds one of its terms: with a query for each title that is the square of the
input. The place of a query's first relevant file needs none of those rows:

1. The windows are cut into tokens once and matched against a trie of all phrases within their task. What is kept of a window is its length
   and the weighted hits of each phrase.
2. The relevant files alone are scored, which gives each query the rank that others must beat.
3. A file that beats it must hold one of the query's terms from that on where the greatest scores of all lesser terms together stay below
   the score to beat. Only such windows are scored. A task tells of each query the files that beat its item, and is done with
   the query at ``limit`` of them, since its place lies beyond the limit then, whatever else there is.

Ranks are those of :mod:`.search` and rounded alike; ties go by path. Memory is bounded by blocks of queries, each a pass over the kept hits.

Defined results: as for the ranked search; an item that isn't among the first ``limit`` files has no row. Of one path with different texts each
text has windows of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_LIMIT, materialise, ship, small
from .search import K1, LEAST_IDF, WEIGHTS, B, field_tokens, phrases

#: Bytes of a term of a query in the tables that each worker holds.
TERM_BYTES = 200
#: Windows that are scored at once.
SLICE = 500
#: Ranks are rounded to six places: what the bounds allow for that.
SLACK = 2e-6


def _expand(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the ranges its own number, repeated, and the places that it covers."""
    own = np.repeat(np.arange(len(counts)), counts)
    return own, np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[own]


class Matcher:
    """Hits of phrases in windows of tokens."""

    def __init__(self, texts: list[list[str]]):
        self.tokens = sorted({t for x in texts for t in x})
        ids, trie, ends = {t: i for i, t in enumerate(self.tokens)}, {}, {}
        for phrase, x in enumerate(texts):
            node = 0
            for t in x:
                node = trie.setdefault((node, ids[t]), len(trie) + 1)
            ends[node] = phrase
        self.size = len(texts)
        codes = sorted((node * len(ids) + t, to) for (node, t), to in trie.items())
        self.codes, self.to = np.array([c for c, _ in codes], "int64"), np.array([n for _, n in codes], "int64")
        self.phrase = np.full(len(trie) + 1, -1, "int64")
        self.phrase[list(ends)] = list(ends.values())

    def hits(self, lists: pa.Array, weight: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, phrase, weight) of each hit in lists of tokens."""
        length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        ids = pc.fill_null(pc.index_in(lists.flatten(), value_set=pa.array(self.tokens, pa.string())), -1).to_numpy(zero_copy_only=False).astype("int64")
        row = np.repeat(np.arange(len(lists)), length)
        place, node, depth, found = np.nonzero(ids >= 0)[0], 0, 0, []
        while len(place):
            code = node * len(self.tokens) + ids[place + depth]
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            held = self.codes[at] == code
            place, node, depth = place[held], self.to[at[held]], depth + 1
            whole = self.phrase[node] >= 0
            found.append((row[place[whole]], self.phrase[node[whole]]))
            more = place + depth < len(ids)
            more[more] = (row[place[more] + depth] == row[place[more]]) & (ids[place[more] + depth] >= 0)
            place, node = place[more], node[more]
        rows, hit = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, "int64"), np.zeros(0, "int64"))
        return rows, hit, np.full(len(rows), weight)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = [self.hits(b.column(name), w) for name, w in WEIGHTS.items()] if self.size else []
            rows, hit, weight = (np.concatenate(x) for x in zip(*every)) if every else (np.zeros(0, "int64"),) * 3
            codes, which = np.unique(rows * max(self.size, 1) + hit, return_inverse=True)
            tf = np.bincount(which, weights=weight, minlength=len(codes)).astype("float64")
            ends = np.searchsorted(codes // max(self.size, 1), np.arange(b.num_rows + 1)).astype("int32")
            n_tokens = sum(pc.fill_null(pc.list_value_length(b.column(name)), 0).to_numpy(zero_copy_only=False).astype("int64") for name in WEIGHTS)
            lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array((codes % max(self.size, 1)).astype("int32")), pa.array(tf))]
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("digest"), pa.array(n_tokens), *lists], ["path", "digest", "n_tokens", "phrases", "tfs"])


class Scorer:
    """The queries' terms, by query, with what a hit of each phrase weighs."""

    def __init__(self, terms: pd.DataFrame, idf: np.ndarray, mean: float):
        """``terms``: (query_id, phrase), of which phrase is a number."""
        self.queries, q = np.unique(terms["query_id"].to_numpy(object), return_inverse=True)
        p = terms["phrase"].to_numpy("int64")
        order = np.lexsort((p, q))
        self.q, self.p, self.idf, self.mean = q[order], p[order], idf, mean
        self.starts = np.searchsorted(self.q, np.arange(len(self.queries) + 1))

    def hits(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, phrase, score) of each hit, by row and phrase."""
        lists = b.column("phrases")
        row = np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        phrase, tf = lists.flatten().to_numpy(zero_copy_only=False).astype("int64"), b.column("tfs").flatten().to_numpy(zero_copy_only=False)
        length = b.column("n_tokens").to_numpy(zero_copy_only=False)[row]
        return row, phrase, self.idf[phrase] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.mean))

    def ranks(self, row: np.ndarray, q: np.ndarray, hits: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """The rank of each pair of a row and a query; NaN without a hit."""
        size = len(self.idf)
        pair, term = _expand(self.starts[q], self.starts[q + 1] - self.starts[q])
        codes = hits[0] * size + hits[1]
        code = row[pair] * size + self.p[term]
        at = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
        held = codes[at] == code if len(codes) else np.zeros(len(code), bool)
        total = np.bincount(pair[held], weights=hits[2][at[held]], minlength=len(row))
        return np.where(np.bincount(pair[held], minlength=len(row)) > 0, np.round(-total, 6), np.nan)

    def relevant(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(query_id, path, rank) of windows that come with a query_id."""
        ids = {x: i for i, x in enumerate(self.queries)}
        for b in batches:
            q = np.array([ids.get(x, -1) for x in b.column("query_id").to_pylist()], "int64")
            rows = np.nonzero(q >= 0)[0]
            rank = self.ranks(rows, q[rows], self.hits(b))
            kept = pa.array(rows[~np.isnan(rank)])
            yield pa.RecordBatch.from_arrays([b.column("query_id").take(kept), b.column("path").take(kept), pa.array(rank[~np.isnan(rank)])], ["query_id", "path", "rank"])


class Beaten(Scorer):
    """The files that stand before a query's item, up to ``limit`` of each query from a task."""

    def __init__(self, scorer: Scorer, best: pd.DataFrame, limit: int):
        """``best``: (query_id, rank, path) to beat."""
        self.__dict__.update(scorer.__dict__)
        self.limit = limit
        at = np.searchsorted(self.queries, best["query_id"].to_numpy(object))
        self.rank, self.path = np.full(len(self.queries), np.nan), np.full(len(self.queries), "", object)
        self.rank[at], self.path[at] = best["rank"].to_numpy("float64"), best["path"].to_numpy(object)
        # By query from the least term on: what all terms before it can give together.
        most = self.idf[self.p] * (K1 + 1)
        order = np.lexsort((most, self.q))
        q, p, most = self.q[order], self.p[order], most[order]
        through = np.cumsum(most)
        through -= (through - most)[self.starts[q]]
        needed = through >= -self.rank[q] - SLACK
        order = np.argsort(p[needed], kind="stable")
        self.needed = q[needed][order], p[needed][order], (through - most)[needed][order]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[set[str]] = [set() for _ in self.queries]
        entries = self.needed
        starts = np.searchsorted(entries[1], np.arange(len(self.idf) + 1))
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE):
                b = batch.slice(begin, SLICE)
                row, phrase, score = hits = self.hits(b)
                hit, entry = _expand(starts[phrase], starts[phrase + 1] - starts[phrase])
                q = entries[0][entry]
                near = score[hit] + entries[2][entry] >= -self.rank[q] - SLACK
                pairs = np.unique(row[hit[near]] * len(self.queries) + q[near])
                if not len(pairs):
                    continue
                row, q = pairs // len(self.queries), pairs % len(self.queries)
                rank = self.ranks(row, q, hits)
                paths = np.array(b.column("path").to_pylist(), object)
                before, tied = rank < self.rank[q], np.nonzero(rank == self.rank[q])[0]
                before[tied] = paths[row[tied]] < self.path[q[tied]]
                fresh, done = [], False
                for i, path in zip(q[before].tolist(), paths[row[before]].tolist()):
                    if len(known[i]) < self.limit and path not in known[i]:
                        known[i].add(path)
                        fresh.append((self.queries[i], path))
                        done |= len(known[i]) == self.limit
                if fresh:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*fresh)], ["query_id", "path"])
                if done:
                    open_ = np.array([len(x) < self.limit for x in known])[entries[0]]
                    entries = tuple(x[open_] for x in entries)
                    starts = np.searchsorted(entries[1], np.arange(len(self.idf) + 1))


def known_item_positions(chunks: DataFrame, queries: DataFrame, relevant: DataFrame, limit: int) -> DataFrame:
    """(query_id, path, position) of each query's first relevant file, if it is among the first ``limit`` files.

    ``chunks`` are windows, ``queries`` (query_id string, query), ``relevant`` (query_id, path).
    """
    spark = chunks.sparkSession
    ship(spark)
    terms = materialise(phrases(queries).dropDuplicates(["query_id", "phrase"]), "terms")
    relevant = materialise(relevant.where("query_id is not null and path is not null").select("query_id", "path").distinct(), "relevant")
    blocks = max(1, math.ceil(terms.count() * TERM_BYTES / BROADCAST_LIMIT))
    out = None
    for k in range(blocks):
        here = F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k
        own = _block(chunks, terms.where(here), relevant.where(here), limit)
        out = own if out is None else out.unionByName(own)
    return out


def _block(chunks: DataFrame, terms: DataFrame, relevant: DataFrame, limit: int) -> DataFrame:
    rows = terms.toPandas()
    first = rows.drop_duplicates("phrase")
    ids = {p: i for i, p in enumerate(first["phrase"])}
    listed = pd.DataFrame({"query_id": rows["query_id"], "phrase": rows["phrase"].map(ids)})
    symbol = F.col("symbol") if "symbol" in chunks.columns else F.lit(None).cast("string")
    # Repeated files: the digest tells windows of one place apart.
    cut = chunks.select(F.col("path").alias("file"), F.xxhash64(symbol, "start_line", "end_line", "heading", "body").alias("digest"), *(t.alias(n) for n, t in field_tokens(chunks).items()))
    met = cut.mapInArrow(Matcher([list(x) for x in first["tokens"]]), "path string, digest long, n_tokens long, phrases array<int>, tfs array<double>")
    met = materialise(met.dropDuplicates(["path", "digest"]), "met")
    stats = met.agg(F.count("*").alias("n"), F.avg("n_tokens").alias("mean")).first()
    n, df = float(stats["n"]), np.zeros(len(ids))
    for r in met.select(F.explode("phrases").alias("phrase")).groupBy("phrase").count().collect():
        df[r["phrase"]] = r["count"]
    with np.errstate(divide="ignore", invalid="ignore"):
        idf = np.log((n - df + 0.5) / (df + 0.5))
    scorer = Scorer(listed, np.where(idf <= 0, LEAST_IDF, idf), float(stats["mean"] or 1.0))
    own = met.join(small(relevant, 150), "path").select("query_id", "path", "n_tokens", "phrases", "tfs").mapInArrow(scorer.relevant, "query_id string, path string, rank double")
    best = materialise(own.groupBy("query_id").agg(F.min(F.struct("rank", "path")).alias("s")).select("query_id", "s.*"), "best")
    before = met.select("path", "n_tokens", "phrases", "tfs").mapInArrow(Beaten(scorer, best.toPandas(), limit), "query_id string, path string")
    counts = before.distinct().groupBy("query_id").agg(F.count("*").alias("before"))
    position = F.coalesce("before", F.lit(0)) + 1
    return best.join(counts, "query_id", "left").select("query_id", "path", position.alias("position")).where(F.col("position") <= limit)
