"""Queries of ranked retrieval over the documents' texts: the passages of ``eval_items`` and titles are the queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import canonical, in_scope
from ..functions.text import identifier_parts, query_terms
from ..operators import known_items, search
from ..session import materialise
from ..sources.tables import table
from . import common

Query = Callable[[SparkSession, str], DataFrame]
LIMIT = 10
SCOPES = ("docs/tools", "docs/surface", "docs/engine")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(canonical(F.col("path")).alias("path"), "text", "title", "lang", "doc_type")


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("passage").alias("query"))


def best_of(files: DataFrame, queries: DataFrame) -> DataFrame:
    return search.best_chunks(search.ranked_chunks(search.index(search.chunk_windows(files)), queries)).select("query_id", "path", "start_line", "rank")


@common.wide
def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    return search.chunk_windows(documents(spark, d)).select("path", "start_line", "end_line", "heading", (F.col("end_line") - F.col("start_line") + 1).alias("n_lines"))


@common.wide
def query_terms_of_items(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("query_id", F.posexplode(query_terms(F.col("query"))).alias("position", "term")).withColumn("position", F.col("position") + 1)


def lexical_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Parts of the distinct names of symbols."""
    return table(spark, d, "symbols").where("qualname is not null").select("qualname").distinct().select("qualname", F.array_join(identifier_parts(F.col("qualname")), " ").alias("parts"))


def postings_stats(spark: SparkSession, d: str) -> DataFrame:
    return search.index(search.chunk_windows(documents(spark, d))).select("path", "start_line", F.col("n_tokens").cast("long").alias("n_tokens"))


@common.wide
def ranked_search(spark: SparkSession, d: str) -> DataFrame:
    return search.top(best_of(documents(spark, d), items(spark, d)), LIMIT, "rank", "path").select("query_id", "position", "path", "start_line", "rank")


@common.wide
def best_chunk_per_file(spark: SparkSession, d: str) -> DataFrame:
    return best_of(documents(spark, d), items(spark, d))


@common.wide
def scoped_search(spark: SparkSession, d: str) -> DataFrame:
    """The scope filters before files are ranked against each other, but the statistics are those of the whole index."""
    best = best_of(documents(spark, d), items(spark, d))
    held = in_scope(F.col("path"), SCOPES[0])
    for s in SCOPES[1:]:
        held = held | in_scope(F.col("path"), s)
    return search.top(best.where(held), LIMIT, "rank", "path").select("query_id", "position", "path", "rank")


@common.wide
def language_filtered_search(spark: SparkSession, d: str) -> DataFrame:
    files = documents(spark, d)
    best = best_of(files, items(spark, d)).join(files.where("lower(lang) like 'en%'").select("path"), "path", "left_semi")
    return search.top(best, LIMIT, "rank", "path").select("query_id", "position", "path", "rank")


def _title_matches(best: DataFrame, files: DataFrame, queries: DataFrame) -> DataFrame:
    titled = queries.select("query_id", F.lower(F.trim("query")).alias("t")).join(files.select("path", F.lower("title").alias("t")), "t").select("query_id", "path").distinct().withColumn("title_match", F.lit(1))
    return best.join(titled, ["query_id", "path"], "left").withColumn("title_match", F.coalesce("title_match", F.lit(0)))


@common.wide
def balanced_search(spark: SparkSession, d: str) -> DataFrame:
    """Scopes are the directories two levels deep."""
    files, queries = documents(spark, d), items(spark, d)
    rows = search.balanced(_title_matches(best_of(files, queries), files, queries), F.regexp_extract("path", "^([^/]+/[^/]+)/", 1), LIMIT)
    return rows.select("query_id", "position", "path", "scope", F.col("scope_row").cast("long").alias("scope_row"), "rank")


def _titles(files: DataFrame) -> DataFrame:
    return files.where("title is not null and doc_type is not null").groupBy(F.col("doc_type").alias("query_id")).agg(F.min("title").alias("query"))


@common.wide
def title_boost_search(spark: SparkSession, d: str) -> DataFrame:
    """One title per type of document is the query; documents with exactly that title come first."""
    files = documents(spark, d)
    queries = materialise(_titles(files), "titles")
    rows = search.top(_title_matches(best_of(files, queries), files, queries), LIMIT, F.col("title_match").desc(), "rank", "path")
    return rows.select("query_id", "position", "path", F.col("title_match").cast("long").alias("title_match"), "rank")


def _record_files(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws("/", "repository", canonical(F.substring_index("record_id", "#", 1)))
    return table(spark, d, "reader_records").where("repository is not null and record_id is not null").groupBy(key.alias("path")).agg(F.max("title").alias("text"))


def _record_links(spark: SparkSession, d: str) -> DataFrame:
    key = lambda c: F.concat_ws("/", "repository", canonical(F.substring_index(c, "#", 1)))
    return table(spark, d, "reader_relationships").where("repository is not null and source_id is not null and target_id is not null").select(key("source_id").alias("source"), key("target_id").alias("target")).distinct()


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "knowledge_entries").where("evidence is not null").select(F.col("evidence").alias("query_id"), F.col("evidence").alias("query")).distinct()


def linked_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Reader records by title; records related to the first hits get a fourth of the places."""
    files = materialise(_record_files(spark, d), "records")
    best = best_of(files, materialise(_evidence(spark, d), "evidence"))
    found = materialise(search.top(best, search.candidates(LIMIT), "rank", "path"), "found")
    return search.linked(found, _record_links(spark, d), files.where("text rlike '\\\\S'"), LIMIT).select("query_id", F.col("position").cast("long").alias("position"), "path", "rank", "reason")


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Known-item search: each title is a query, the documents that have it are relevant."""
    files = documents(spark, d)
    relevant = files.where("title is not null").select(F.col("title").alias("query_id"), "path")
    queries = relevant.select("query_id", F.col("query_id").alias("query")).distinct()
    found = known_items.known_item_positions(search.chunk_windows(files), queries, relevant, LIMIT)
    m = search.retrieval_metrics(found, relevant)
    return m.select("n_queries", *(F.round(c, 6).alias(c) for c in ("recall_1", "recall_5", "recall_10", "mean_reciprocal_rank")))


def explanation_score(spark: SparkSession, d: str) -> DataFrame:
    words = _record_files(spark, d).select(F.col("path").alias("explanation_id"), F.concat_ws(" ", "path", "text").alias("words"))
    return search.explanation_scores(words, _evidence(spark, d)).select("query_id", "explanation_id", "score")


QUERIES: dict[str, Query] = {
    "chunk_windows": chunk_windows, "query_terms": query_terms_of_items, "lexical_expansion": lexical_expansion, "postings_stats": postings_stats, "ranked_search": ranked_search, "best_chunk_per_file": best_chunk_per_file,
    "scoped_search": scoped_search, "language_filtered_search": language_filtered_search, "balanced_search": balanced_search, "title_boost_search": title_boost_search, "linked_expansion": linked_expansion,
    "retrieval_metrics": retrieval_metrics, "explanation_score": explanation_score,
}

FILES_SQL = f"files AS (SELECT {common.canon('path')} AS path, text, title, lang, doc_type FROM documents)"
_ITEMS = "queries AS (SELECT item_id AS query_id, passage AS query FROM eval_items)"
_SEARCH = f"WITH {FILES_SQL}, {_ITEMS}, {common.bm25('files', 'queries')}"
_KEY = "repository || '/' || {0}"
_RECORDS = f"files AS (SELECT repository || '/' || {common.canon("split_part(record_id, '#', 1)")} AS path, max(title) AS text FROM reader_records WHERE repository IS NOT NULL AND record_id IS NOT NULL GROUP BY 1)"
_EVIDENCE = "queries AS (SELECT DISTINCT evidence AS query_id, evidence AS query FROM knowledge_entries WHERE evidence IS NOT NULL)"


def _first(rows: str, order: str, columns: str) -> str:
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS position FROM {rows}) WHERE position <= {LIMIT}"


_TITLED = "titled AS (SELECT b.*, CASE WHEN lower(f.title) = lower(trim(q.query)) THEN 1 ELSE 0 END AS title_match FROM best b JOIN files f USING (path) JOIN queries q USING (query_id))"
_IN = " OR ".join(f"path = '{s}' OR starts_with(path, '{s}/')" for s in SCOPES)

ORACLE: dict[str, str] = {
    "chunk_windows": f"WITH {FILES_SQL}, {common.windows('files')} SELECT path, start_line, end_line, heading, end_line - start_line + 1 AS n_lines FROM chunks",
    "query_terms": f"WITH {_ITEMS}, {common.terms('queries')} SELECT query_id, term, position FROM terms",
    "lexical_expansion": f"SELECT DISTINCT qualname, array_to_string({common.lexical('qualname')}, ' ') AS parts FROM symbols WHERE qualname IS NOT NULL",
    "postings_stats": f"{_SEARCH} SELECT path, start_line, n_tokens::BIGINT AS n_tokens FROM lengths",
    "ranked_search": f"{_SEARCH} {_first('best', 'rank, path', 'query_id, position, path, start_line, rank')}",
    "best_chunk_per_file": f"{_SEARCH} SELECT query_id, path, start_line, rank FROM best",
    "scoped_search": f"{_SEARCH} {_first(f'(SELECT * FROM best WHERE {_IN})', 'rank, path', 'query_id, position, path, rank')}",
    "language_filtered_search": f"{_SEARCH} {_first("(SELECT * FROM best WHERE path IN (SELECT path FROM files WHERE lower(lang) LIKE 'en%'))", 'rank, path', 'query_id, position, path, rank')}",
    "balanced_search": f"""{_SEARCH}, {_TITLED},
scoped AS (SELECT *, row_number() OVER (PARTITION BY query_id, scope ORDER BY title_match DESC, rank, path) AS scope_row FROM (SELECT *, regexp_extract(path, '^([^/]+/[^/]+)/', 1) AS scope FROM titled))
{_first('scoped', 'title_match DESC, scope_row, rank, path', 'query_id, position, path, scope, scope_row, rank')}""",
    "title_boost_search": f"""WITH {FILES_SQL}, queries AS (SELECT doc_type AS query_id, min(title) AS query FROM files WHERE title IS NOT NULL AND doc_type IS NOT NULL GROUP BY 1), {common.bm25('files', 'queries')}, {_TITLED}
{_first('titled', 'title_match DESC, rank, path', 'query_id, position, path, title_match::BIGINT AS title_match, rank')}""",
    "linked_expansion": f"""WITH {_RECORDS}, {_EVIDENCE}, {common.bm25('files', 'queries')},
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, path) AS position FROM best) WHERE position <= 30),
raw AS (SELECT DISTINCT repository || '/' || {common.canon("split_part(source_id, '#', 1)")} AS s, repository || '/' || {common.canon("split_part(target_id, '#', 1)")} AS t FROM reader_relationships
        WHERE repository IS NOT NULL AND source_id IS NOT NULL AND target_id IS NOT NULL),
link AS (SELECT s AS path, t AS other FROM raw WHERE s <> t UNION SELECT t, s FROM raw WHERE s <> t),
near AS (SELECT f.query_id, f.path AS seed, f.rank, f.position, l.other AS path FROM found f JOIN link l USING (path) WHERE f.position <= 20
         AND l.other IN (SELECT path FROM chunks) AND NOT EXISTS (SELECT 1 FROM found g WHERE g.query_id = f.query_id AND g.path = l.other)),
firsts AS (SELECT query_id, path, min(position) AS at FROM near GROUP BY 1, 2),
extra AS (SELECT * FROM (SELECT n.query_id, n.path, greatest(1.0, 5 * abs(n.rank)) AS rank, 'linked-from:' || n.seed AS reason, row_number() OVER (PARTITION BY n.query_id ORDER BY n.position, n.path) AS nth
          FROM near n JOIN firsts f ON f.query_id = n.query_id AND f.path = n.path AND f.at = n.position) WHERE nth <= 10),
slots AS (SELECT query_id, least(count(*), 2) AS slots FROM extra GROUP BY 1),
direct AS (SELECT f.query_id, f.position, f.path, f.rank, 'match' AS reason FROM found f LEFT JOIN slots s USING (query_id) WHERE f.position <= 10 - coalesce(s.slots, 0))
SELECT * FROM direct UNION ALL
SELECT e.query_id, d.n + e.nth, e.path, e.rank, e.reason FROM extra e JOIN slots s USING (query_id) JOIN (SELECT query_id, max(position) AS n FROM direct GROUP BY 1) d USING (query_id) WHERE e.nth <= s.slots""",
    "retrieval_metrics": f"""WITH {FILES_SQL}, queries AS (SELECT DISTINCT title AS query_id, title AS query FROM files WHERE title IS NOT NULL), {common.bm25('files', 'queries')},
found AS ({_first('best', 'rank, path', 'query_id, position, path')}),
hit AS (SELECT f.title AS query_id, min(position) AS p FROM files f LEFT JOIN found r ON r.query_id = f.title AND r.path = f.path WHERE f.title IS NOT NULL GROUP BY 1)
SELECT count(*) AS n_queries, round(avg(CASE WHEN p <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN p <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_5,
       round(avg(CASE WHEN p <= 10 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_10, round(avg(coalesce(1.0::DOUBLE / p, 0)), 6) AS mean_reciprocal_rank FROM hit""",
    "explanation_score": f"""WITH {_RECORDS}, {_EVIDENCE}, {common.terms('queries')}
SELECT query_id, path AS explanation_id, count(*) AS score FROM terms, files WHERE contains(lower(path || coalesce(' ' || text, '')), term) GROUP BY 1, 2""",
}
