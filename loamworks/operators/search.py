"""Ranked search over files: windows of lines, weighted BM25, one row per file, balance between scopes, links.

A file is cut into windows of lines; each window is indexed with its path, file name, symbol, heading and its text followed by the
parts of its identifiers. A query is the disjunction of its terms; a term of several tokens is a phrase. A window's rank is

    -sum over phrases of idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean length))

with tf the hits weighted by field and idf = ln((N - n + 0.5) / (n + 0.5)), at least 1e-6. Smaller is better.

The index is built once and written to the shared folder. Phrases of all queries are matched in one pass: every posting of a
token that some query uses tells where a phrase would have to begin, and a phrase is hit where all its tokens agree. Postings of
other tokens never leave their task. Hits are counted per phrase and window before they meet the queries.

Defined results: files without text have no window, blank windows neither; a query without terms has no row; ranks are rounded
to six places before rows are ordered, ties go by path; repeated files give one row; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import basename
from ..functions.text import ACCENTED, PLAIN, TOKEN, lexical_body, lines, query_terms, tokens
from ..session import materialise, small

#: Lines of a window and from one window's start to the next.
WINDOW, STEP = 100, 80
# The weights of the fields and the constants of the formula.
WEIGHTS = {"path": 2.5, "filename": 3.0, "symbol": 2.0, "heading": 1.5, "body": 1.0}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
CANDIDATES_LEAST, CANDIDATES_MOST = 20, 1000


def chunk_windows(files: DataFrame) -> DataFrame:
    """(path, start_line, end_line, heading, body) of each window that isn't blank, of files with (path, text)."""
    cut = files.where("path is not null and text is not null").select("path", lines(F.col("text")).alias("all"))
    starts = F.sequence(F.lit(0), F.size("all") - 1, F.lit(STEP))
    part = cut.select("path", "all", F.explode(starts).alias("start")).select("path", (F.col("start") + 1).alias("start_line"), F.least(F.size("all"), F.col("start") + WINDOW).alias("end_line"), F.slice("all", F.col("start") + 1, WINDOW).alias("lines"))
    heading = F.regexp_replace(F.get(F.filter("lines", lambda x: x.rlike(r"^#{1,6}\s")), F.lit(0)), r"^#+\s*", "")
    return part.select("path", "start_line", "end_line", heading.alias("heading"), F.array_join("lines", "\n").alias("body")).where(F.col("body").rlike(r"\S"))


def symbol_windows(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """One more window per symbol: the lines of its definition; ``symbols`` has (path, qualname, start_line, end_line)."""
    cut = files.where("path is not null and text is not null").select("path", lines(F.col("text")).alias("all"))
    span = symbols.select("path", F.col("qualname").alias("symbol"), "start_line", "end_line").where("start_line >= 1 and end_line >= start_line").distinct()
    body = F.array_join(F.slice("all", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    return cut.join(span, "path").where(F.col("start_line") <= F.size("all")).select("path", "symbol", "start_line", "end_line", F.lit(None).cast("string").alias("heading"), body.alias("body"))


def field_tokens(chunks: DataFrame) -> dict[str, Column]:
    """The tokens of each field of a window."""
    symbol = F.col("symbol") if "symbol" in chunks.columns else F.lit(None).cast("string")
    texts = {"path": F.col("path"), "filename": basename(F.col("path")), "symbol": symbol, "heading": F.col("heading"), "body": lexical_body(F.col("body"))}
    return {n: F.coalesce(tokens(t), F.array().cast("array<string>")) for n, t in texts.items()}


def index(chunks: DataFrame) -> DataFrame:
    """(path, start_line, end_line, n_tokens, fields): the tokens of each window by field. Materialised: all that a search reads."""
    symbol = F.col("symbol") if "symbol" in chunks.columns else F.lit(None).cast("string")
    fields = F.array(*(F.struct(F.lit(WEIGHTS[n]).alias("weight"), t.alias("tokens")) for n, t in field_tokens(chunks).items()))
    out = chunks.distinct().select("path", symbol.alias("symbol"), "start_line", "end_line", fields.alias("fields"))
    return materialise(out.withColumn("n_tokens", F.aggregate("fields", F.lit(0), lambda n, f: n + F.size(f["tokens"]))), "index")


def phrases(queries: DataFrame) -> DataFrame:
    """(query_id, phrase, tokens) of each distinct term of each query that has tokens."""
    term = queries.where("query_id is not null").select("query_id", F.explode(query_terms(F.col("query"))).alias("term"))
    split = F.regexp_extract_all(F.translate("term", ACCENTED, PLAIN), F.lit(TOKEN), 0)
    return term.select("query_id", split.alias("tokens")).where(F.size("tokens") > 0).select("query_id", F.array_join("tokens", " ").alias("phrase"), "tokens")


CHUNK = ["path", "symbol", "start_line", "end_line"]


def phrase_hits(indexed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(chunk, n_tokens, phrase, tf): weighted hits of each distinct (phrase, tokens) of ``wanted`` in each window."""
    need = wanted.select("phrase", F.size("tokens").alias("n_parts"), F.posexplode("tokens").alias("part", "token")).distinct()
    need = small(materialise(need, "phrases"), 200)
    fields = indexed.select(*CHUNK, "n_tokens", F.posexplode("fields").alias("field", "f"))
    postings = fields.select(*CHUNK, "n_tokens", "field", F.col("f.weight").alias("weight"), F.posexplode("f.tokens").alias("pos", "token"))
    met = postings.join(need, "token").withColumn("begin", F.col("pos") - F.col("part"))
    # A phrase of one token needs no second look.
    one = met.where("n_parts = 1").select(*CHUNK, "n_tokens", "phrase", "weight")
    more = met.where("n_parts > 1").groupBy(*CHUNK, "n_tokens", "phrase", "weight", "field", "begin", "n_parts").agg(F.count_distinct("part").alias("found")).where("found = n_parts").select(*CHUNK, "n_tokens", "phrase", "weight")
    return one.unionByName(more).groupBy(*CHUNK, "n_tokens", "phrase").agg(F.sum("weight").alias("tf"))


def ranked_chunks(indexed: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, chunk, rank) of every window that holds a term of the query; ``queries`` has (query_id, query)."""
    terms = materialise(phrases(queries).dropDuplicates(["query_id", "phrase"]), "terms")
    hits = materialise(phrase_hits(indexed, terms.select("phrase", "tokens").distinct()), "hits")
    stats = indexed.agg(F.count("*").alias("n"), F.avg("n_tokens").alias("mean")).first()
    n, mean = float(stats["n"]), float(stats["mean"] or 1.0)
    spread = hits.groupBy("phrase").agg(F.count("*").alias("df"))
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = terms.select("query_id", "phrase").join(spread, "phrase").select("query_id", "phrase", F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf).alias("idf"))
    score = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_tokens") / mean))
    scored = hits.join(small(materialise(weights, "weights"), 200), "phrase")
    return scored.groupBy("query_id", *CHUNK).agg(F.round(-F.sum(score), 6).alias("rank"))


def best_chunks(ranked: DataFrame) -> DataFrame:
    """The best window of each file: one row per (query_id, path)."""
    w = Window.partitionBy("query_id", "path").orderBy("rank", "start_line", "end_line", F.col("symbol").asc_nulls_first())
    return ranked.withColumn("file_row", F.row_number().over(w)).where("file_row = 1").drop("file_row")


def top(rows: DataFrame, limit: int, *order: str | Column, by: str = "query_id") -> DataFrame:
    """The first ``limit`` rows of each query with their ``position``; limits are taken in every task before the shuffle."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


def candidates(limit: int) -> int:
    """How many rows a search of ``limit`` looks at before links are followed."""
    return min(CANDIDATES_MOST, max(CANDIDATES_LEAST, 3 * limit))


def balanced(best: DataFrame, scope: Column, limit: int) -> DataFrame:
    """Rows of different scopes take turns: those with the exact title first, then the best of each scope, then the second best."""
    w = Window.partitionBy("query_id", "scope").orderBy(F.col("title_match").desc(), "rank", "path")
    rows = best.withColumn("scope", scope).withColumn("scope_row", F.row_number().over(w))
    return top(rows, limit, F.col("title_match").desc(), "scope_row", "rank", "path")


def linked(found: DataFrame, links: DataFrame, first_lines: DataFrame, limit: int) -> DataFrame:
    """Neighbours of the first 20 hits join the result: (query_id, position, path, rank, reason).

    ``found`` has (query_id, path, rank, position) of all candidates, ``links`` (source, target), read both ways, ``first_lines`` the
    paths that have a window. A neighbour that is no hit itself gets the rank max(1, 5 |rank|) of the first hit it is linked from. A
    fourth of the places is theirs, at least one, if there are any.
    """
    both = links.select(F.col("source").alias("path"), F.col("target").alias("other")).unionByName(links.select(F.col("target").alias("path"), F.col("source").alias("other"))).where("path != other").distinct()
    seeds = found.where("position <= 20")
    near = seeds.join(both, "path").select("query_id", F.col("path").alias("seed"), "rank", F.col("position").alias("seed_position"), F.col("other").alias("path"))
    near = near.join(found.select("query_id", "path"), ["query_id", "path"], "left_anti").join(first_lines.select("path").distinct(), "path", "left_semi")
    first = near.groupBy("query_id", "path").agg(F.min(F.struct("seed_position", "seed", "rank")).alias("s"))
    extra = first.select("query_id", "path", F.greatest(F.lit(1.0), 5 * F.abs("s.rank")).alias("rank"), F.concat(F.lit("linked-from:"), F.col("s.seed")).alias("reason"), F.col("s.seed_position").alias("at"))
    w = Window.partitionBy("query_id").orderBy("at", "path")
    extra = extra.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= min(20, limit))
    slots = extra.groupBy("query_id").agg(F.count("*").alias("n")).select("query_id", F.least("n", F.lit(max(1, limit // 4))).alias("slots") if limit > 1 else F.lit(0).alias("slots"))
    direct = found.join(slots, "query_id", "left").where(F.col("position") <= limit - F.coalesce("slots", F.lit(0))).select("query_id", "position", "path", "rank", F.lit("match").alias("reason"))
    taken = direct.groupBy("query_id").agg(F.max("position").alias("last"))
    more = extra.join(slots, "query_id").where("nth <= slots").join(taken, "query_id").select("query_id", (F.col("last") + F.col("nth")).alias("position"), "path", "rank", "reason")
    return direct.unionByName(more)


def retrieval_metrics(positions: DataFrame, relevant: DataFrame) -> DataFrame:
    """recall@1/5/10 and mean reciprocal rank over the queries that have something relevant.

    ``positions`` (query_id, path, position) of the results, ``relevant`` (query_id, path).
    """
    best = relevant.select("query_id", "path").distinct().join(positions, ["query_id", "path"], "left").groupBy("query_id").agg(F.min("position").alias("best"))
    at = [F.avg(F.when(F.col("best") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in (1, 5, 10)]
    return best.agg(F.count("*").alias("n_queries"), *at, F.avg(F.coalesce(1 / F.col("best"), F.lit(0.0))).alias("mean_reciprocal_rank"))


def explanation_scores(explanations: DataFrame, queries: DataFrame) -> DataFrame:
    """How many of a query's terms each explanation's words contain: (query_id, explanation_id, score, rank), score above 0."""
    terms = small(materialise(queries.where("query_id is not null").select("query_id", F.explode(query_terms(F.col("query"))).alias("term")), "terms"), 200)
    # A term may lie anywhere in a word: the parts of the distinct words that are as long as some term are looked up among the terms.
    sizes = sorted(r.n for r in terms.select(F.length("term").alias("n")).distinct().collect())
    words = explanations.select("explanation_id", F.explode(F.array_distinct(F.split(F.lower("words"), r"\s+"))).alias("word")).where("word != ''")
    part = F.flatten(F.transform(F.array(*map(F.lit, sizes)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("word") - n + 1, F.lit(1))), lambda i: F.substring(F.col("word"), i, n)))) if sizes else F.array().cast("array<string>")
    holds = words.select("word").distinct().select("word", F.explode(F.array_distinct(part)).alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    found = words.join(materialise(holds, "holds"), "word").select("explanation_id", "term").distinct()
    return found.join(terms, "term").groupBy("query_id", "explanation_id").agg(F.count("*").alias("score")).withColumn("rank", F.lit(1e6) - F.col("score"))
