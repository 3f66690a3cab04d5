"""Queries that are one relational operation each: joins, unions, differences and counts over the repository tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import basename, canonical, dirname, in_scope
from ..operators import graph
from ..sources.tables import table
from . import common, retrieval, structure

Query = Callable[[SparkSession, str], DataFrame]
SCOPES = ("src", "packages")


def symbols_per_file(spark: SparkSession, d: str) -> DataFrame:
    """Files with their symbols counted; files without any stay."""
    files = structure._map_files(spark, d).select("repository", "path")
    s = structure._symbols(spark, d).where("removed_at is null").select("repository", canonical(F.col("path")).alias("path"), "node").distinct()
    return files.join(s, ["repository", "path"], "left").groupBy("repository", "path").agg(F.count("node").alias("symbols"))


def distinct_packages(spark: SparkSession, d: str) -> DataFrame:
    return structure._map_files(spark, d).select("repository", F.regexp_extract("path", "^packages/([^/]+)/", 1).alias("package")).where("package != ''").distinct()


def distinct_callers(spark: SparkSession, d: str) -> DataFrame:
    """How many symbols call each resolved target; pairs are made distinct first, so that a hot target is counted in parts."""
    e = structure.call_edges(spark, d).where("not (confidence <=> 'unresolved')").select("source", "target").distinct()
    return e.groupBy("target").agg(F.count("*").alias("callers"))


def same_directory_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls whose target lies in the caller's own directory, that exists in the repository."""
    links = structure._map_links(spark, d).where("not (confidence <=> 'unresolved') and repository is not null").select("repository", "source_path", "target_path").distinct()
    known = structure._map_files(spark, d).select("repository", F.col("path").alias("target_path"))
    return links.where(dirname(F.col("source_path")) == dirname(F.col("target_path"))).join(known, ["repository", "target_path"], "left_semi").select("repository", "source_path", "target_path")


def link_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The distinct records that each record refers to or is referred to by."""
    return graph.undirected(structure.record_edges(spark, d)).select(F.col("source").alias("record"), F.col("target").alias("neighbour"))


def suffix_matches(spark: SparkSession, d: str) -> DataFrame:
    """Unresolved targets by their last part, with the live symbols of that name anywhere in the repository, letter case aside."""
    e = table(spark, d, "call_edges").where("confidence = 'unresolved' and target_key is not null and repository is not null").select("edge_id", "repository", F.lower(F.substring_index("target_key", ".", -1)).alias("name")).distinct()
    s = structure._symbols(spark, d).where("removed_at is null").select("repository", F.lower("symbol_name").alias("name"), "node").distinct().groupBy("repository", "name").agg(F.count("*").alias("n"))
    return e.join(s, ["repository", "name"], "left").select("edge_id", "name", F.coalesce("n", F.lit(0).cast("long")).alias("symbols"))


def scope_filter(spark: SparkSession, d: str) -> DataFrame:
    """Files in any of the scopes by literal prefix, per scope."""
    files = structure._map_files(spark, d)
    parts = [files.where(in_scope(F.col("path"), s)).groupBy("repository").agg(F.count("*").alias("files")).withColumn("scope", F.lit(s)) for s in SCOPES]
    return parts[0].unionByName(parts[1])


def source_only_filter(spark: SparkSession, d: str) -> DataFrame:
    """Live symbols whose file exists and is source: a semi-join."""
    source = structure._map_files(spark, d).where("language in ('.py', '.ts', '.js', '.go', '.java')").select("repository", "path")
    s = structure._symbols(spark, d).where("removed_at is null").withColumn("path", canonical(F.col("path")))
    return s.join(source, ["repository", "path"], "left_semi").groupBy("repository", "kind").agg(F.count_distinct("node").alias("symbols"))


def documentation_only_filter(spark: SparkSession, d: str) -> DataFrame:
    """Documents that a search for documentation looks at: Markdown, but no index and no log."""
    p = F.lower("path")
    kept = retrieval.documents(spark, d).where(p.rlike(r"\.mdx?$") & ~basename(p).isin("index.md", "log.md"))
    return kept.groupBy("doc_type").agg(F.count("*").alias("documents"))


def edge_precision_recall(spark: SparkSession, d: str) -> DataFrame:
    """Each origin's edges held against those that any other origin is sure of."""
    e = table(spark, d, "call_edges").where("repository is not null and source_key is not null and target_key is not null and origin is not null and not (confidence <=> 'unresolved')").select("repository", "source_key", "target_key", "origin", "confidence").distinct()
    key = ["repository", "source_key", "target_key"]
    sure = e.where("confidence = 'high'").groupBy(*key).agg(F.count_distinct("origin").alias("n"), F.min("origin").alias("only"))
    met = e.select(*key, "origin").distinct().join(sure, key, "left")
    other = F.col("n").isNotNull() & ((F.col("n") > 1) | (F.col("only") != F.col("origin")))
    return met.groupBy("origin").agg(F.count("*").alias("found"), F.count_if(other).alias("confirmed"), F.round(F.avg(F.when(other, 1.0).otherwise(0.0)), 9).alias("precision"))


def metadata_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Recommended fields that a document lacks."""
    c = F.col
    missing = {"title": c("title").isNull() | (F.trim("title") == ""), "lang": c("lang").isNull(), "doc_type": c("doc_type").isNull(), "text": c("text").isNull() | ~c("text").rlike(r"\S"), "updated_at": c("updated_at").isNull()}
    found = F.filter(F.array(*(F.when(F.coalesce(x, F.lit(True)), F.lit(n)) for n, x in missing.items())), lambda x: x.isNotNull())
    return table(spark, d, "documents").select("doc_id", F.array_join(found, ",").alias("missing")).where("missing != ''")


def call_resolution_states(spark: SparkSession, d: str) -> DataFrame:
    """Edges of each repository by what became of them: resolved to a live symbol, to one that is gone, to none, or left as text."""
    e = structure.call_edges(spark, d)
    s = structure._symbols(spark, d).groupBy(F.col("node").alias("target")).agg(F.max(F.col("removed_at").isNull().cast("int")).alias("live"))
    state = F.when(F.col("confidence").eqNullSafe("unresolved"), "text").when(F.col("live") == 1, "live").when(F.col("live") == 0, "gone").otherwise("unknown")
    return e.join(s, "target", "left").groupBy(F.substring_index("source", "::", 1).alias("repository"), state.alias("state")).agg(F.count("*").alias("edges"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (symbols_per_file, distinct_packages, distinct_callers, same_directory_calls, link_neighbours, suffix_matches, scope_filter, source_only_filter, documentation_only_filter, edge_precision_recall, metadata_warnings, call_resolution_states)}

_C, _D = common.canon, common.dirname
_FILES = f"files AS (SELECT DISTINCT repository, {_C('path')} AS path FROM source_files WHERE repository IS NOT NULL AND path IS NOT NULL)"
_EXT = r"lower(regexp_extract(path, '(\.[^./]+)$', 1))"

ORACLE: dict[str, str] = {
    "symbols_per_file": f"WITH {_FILES}, {structure._SYMBOLS} SELECT f.repository, f.path, count(DISTINCT s.node) AS symbols FROM files f LEFT JOIN syms s ON s.repository = f.repository AND {_C('s.path')} = f.path AND s.removed_at IS NULL GROUP BY 1, 2",
    "distinct_packages": f"WITH {_FILES} SELECT DISTINCT repository, regexp_extract(path, '^packages/([^/]+)/', 1) AS package FROM files WHERE regexp_extract(path, '^packages/([^/]+)/', 1) <> ''",
    "distinct_callers": f"WITH {structure._EDGES} SELECT target, count(DISTINCT source) AS callers FROM sure GROUP BY 1",
    "same_directory_calls": f"WITH {_FILES} SELECT DISTINCT e.repository, {_C('e.path')} AS source_path, {_C('e.target_path')} AS target_path FROM call_edges e JOIN files f ON f.repository = e.repository AND f.path = {_C('e.target_path')} WHERE e.confidence IS DISTINCT FROM 'unresolved' AND e.path IS NOT NULL AND {_D(_C('e.path'))} = {_D(_C('e.target_path'))}",
    "link_neighbours": f"WITH {structure._rel()} SELECT source AS record, target AS neighbour FROM twoway",
    "suffix_matches": f"WITH {structure._SYMBOLS}, e AS (SELECT DISTINCT edge_id, repository, lower(split_part(target_key, '.', -1)) AS name FROM call_edges WHERE confidence = 'unresolved' AND target_key IS NOT NULL AND repository IS NOT NULL) SELECT e.edge_id, e.name, (SELECT count(DISTINCT node) FROM syms s WHERE s.removed_at IS NULL AND s.repository = e.repository AND lower(s.symbol_name) = e.name) AS symbols FROM e",
    "scope_filter": f"WITH {_FILES} SELECT repository, count(*) AS files, s AS scope FROM files, (VALUES ('src'), ('packages')) v(s) WHERE path = s OR starts_with(path, s || '/') GROUP BY 1, 3",
    "source_only_filter": f"WITH {_FILES}, {structure._SYMBOLS} SELECT s.repository, s.kind, count(DISTINCT s.node) AS symbols FROM syms s WHERE removed_at IS NULL AND EXISTS (SELECT 1 FROM files WHERE files.repository = s.repository AND files.path = {_C('s.path')} AND {_EXT.replace('path', 'files.path')} IN ('.py', '.ts', '.js', '.go', '.java')) GROUP BY 1, 2",
    "documentation_only_filter": f"WITH {retrieval.FILES_SQL} SELECT doc_type, count(*) AS documents FROM files WHERE regexp_matches(lower(path), '\\.mdx?$') AND NOT regexp_matches(lower(path), '(^|/)(index|log)\\.md$') GROUP BY 1",
    "edge_precision_recall": """WITH e AS (SELECT DISTINCT repository, source_key, target_key, origin FROM call_edges WHERE repository IS NOT NULL AND source_key IS NOT NULL AND target_key IS NOT NULL AND origin IS NOT NULL AND confidence IS DISTINCT FROM 'unresolved'),
m AS (SELECT e.*, EXISTS (SELECT 1 FROM call_edges c WHERE c.repository = e.repository AND c.source_key = e.source_key AND c.target_key = e.target_key AND c.confidence = 'high' AND c.origin <> e.origin) AS ok FROM e)
SELECT origin, count(*) AS found, count(*) FILTER (ok) AS confirmed, round(avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0 END), 9) AS "precision" FROM m GROUP BY 1""",
    "metadata_warnings": r"SELECT doc_id, missing FROM (SELECT doc_id, array_to_string(list_filter([CASE WHEN coalesce(trim(title), '') = '' THEN 'title' END, CASE WHEN lang IS NULL THEN 'lang' END, CASE WHEN doc_type IS NULL THEN 'doc_type' END, CASE WHEN NOT regexp_matches(coalesce(text, ''), '\S') THEN 'text' END, CASE WHEN updated_at IS NULL THEN 'updated_at' END], lambda x: x IS NOT NULL), ',') AS missing FROM documents) WHERE missing <> ''",
    "call_resolution_states": f"""WITH {structure._EDGES}, {structure._SYMBOLS}, l AS (SELECT node, max(CASE WHEN removed_at IS NULL THEN 1 ELSE 0 END) AS live FROM syms GROUP BY 1)
SELECT split_part(source, '::', 1) AS repository, CASE WHEN confidence IS NOT DISTINCT FROM 'unresolved' THEN 'text' WHEN live = 1 THEN 'live' WHEN live = 0 THEN 'gone' ELSE 'unknown' END AS state, count(*) AS edges FROM edges LEFT JOIN l ON l.node = edges.target GROUP BY 1, 2""",
}
