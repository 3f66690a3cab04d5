"""Queries of the call graph, of the files' structure and of the graph of records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import canonical, dirname, extension
from ..functions.text import lines
from ..operators import graph, search
from ..operators.orphans import symbol_key
from ..session import materialise
from ..sources.tables import table
from . import common

Query = Callable[[SparkSession, str], DataFrame]
DEPTH = 2
TOP = 40


def symbol_node(repository: Column, key: Column) -> Column:
    return F.concat(repository, F.lit("::"), symbol_key(key))


def call_edges(spark: SparkSession, d: str) -> DataFrame:
    """(source, target, confidence): nodes are ``repository::path::qualname``; a target of three parts names its repository itself."""
    e = table(spark, d, "call_edges").where("repository is not null and source_key is not null and target_key is not null")
    rest = F.expr("substring(target_key, length(substring_index(target_key, '::', 1)) + 3)")
    resolved = F.when(rest.contains("::"), symbol_node(F.substring_index("target_key", "::", 1), rest)).otherwise(symbol_node(F.col("repository"), F.col("target_key")))
    unresolved = F.col("confidence").eqNullSafe("unresolved")
    return e.select(symbol_node(F.col("repository"), F.col("source_key")).alias("source"), F.when(unresolved, F.col("target_key")).otherwise(resolved).alias("target"), "confidence").distinct()


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "symbols").where("repository is not null and symbol_key is not null").withColumn("node", symbol_node(F.col("repository"), F.col("symbol_key")))


def _removed(spark: SparkSession, d: str) -> DataFrame:
    return _symbols(spark, d).where("removed_at is not null").select("node").distinct()


def _sure(edges: DataFrame) -> DataFrame:
    return edges.where("not (confidence <=> 'unresolved')")


def _reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"))


def trace_callees(spark: SparkSession, d: str) -> DataFrame:
    """What removed symbols call, two calls deep."""
    return graph.walk(_removed(spark, d), _sure(call_edges(spark, d)), DEPTH)


def trace_callers(spark: SparkSession, d: str) -> DataFrame:
    """What calls removed symbols, two calls deep."""
    return graph.walk(_removed(spark, d), _reverse(_sure(call_edges(spark, d))), DEPTH)


def trace_unresolved_boundary(spark: SparkSession, d: str) -> DataFrame:
    """The edges met on the way down from removed symbols; unresolved targets end it."""
    return graph.trace(_removed(spark, d), call_edges(spark, d), DEPTH)


def change_impact(spark: SparkSession, d: str) -> DataFrame:
    """Callers of every symbol of the files that the last pass recorded as failed; each row keeps the symbol it began at."""
    failed = table(spark, d, "source_files").where("status = 'failed'").select("repository", canonical(F.col("path")).alias("path")).distinct()
    seeds = _symbols(spark, d).withColumn("path", canonical(F.col("path"))).join(failed, ["repository", "path"], "left_semi").select(F.col("node").alias("seed"), "node")
    return graph.walk(seeds, _reverse(_sure(call_edges(spark, d))), DEPTH, ("seed",)).where("depth > 0")


def _map_files(spark: SparkSession, d: str) -> DataFrame:
    """(repository, path, language, symbol_count), one row per file."""
    f = table(spark, d, "source_files").where("repository is not null and path is not null")
    return f.groupBy("repository", canonical(F.col("path")).alias("path")).agg(F.max("symbol_count").alias("symbol_count")).withColumn("language", extension(F.col("path")))


def _map_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "call_edges").select("repository", canonical(F.col("path")).alias("source_path"), canonical(F.col("target_path")).alias("target_path"), "confidence").where("source_path is not null and target_path is not null")


def hotspots(spark: SparkSession, d: str) -> DataFrame:
    return graph.coupling(_map_files(spark, d), _map_links(spark, d)).where("coupling > 0").select("repository", "path", "incoming_files", "outgoing_files", "coupling", F.col("symbol_count").cast("long").alias("symbol_count"))


def clusters(spark: SparkSession, d: str) -> DataFrame:
    return graph.clusters(_map_files(spark, d), _map_links(spark, d))


def repository_totals(spark: SparkSession, d: str) -> DataFrame:
    """Files, symbols, edges and windows of each repository."""
    files = table(spark, d, "source_files").where("repository is not null and path is not null").select("repository", canonical(F.col("path")).alias("path"), "body")
    n_lines = F.size(lines(F.col("body")))
    per_file = files.groupBy("repository", "path").agg(F.max(F.ceil(n_lines / search.STEP)).alias("n"))
    parts = [
        per_file.select("repository", F.lit(1).alias("files"), F.lit(0).alias("symbols"), F.lit(0).alias("edges"), F.coalesce("n", F.lit(0)).alias("windows")),
        _symbols(spark, d).select("repository", "node").distinct().select("repository", F.lit(0).alias("files"), F.lit(1).alias("symbols"), F.lit(0).alias("edges"), F.lit(0).alias("windows")),
        table(spark, d, "call_edges").where("repository is not null").select("repository", "edge_id").distinct().select("repository", F.lit(0).alias("files"), F.lit(0).alias("symbols"), F.lit(1).alias("edges"), F.lit(0).alias("windows")),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("repository").agg(*(F.sum(c).cast("long").alias(c) for c in ("files", "symbols", "edges", "windows")))


def _record(c: str) -> Column:
    return F.concat(F.col("repository"), F.lit("/"), canonical(F.substring_index(c, "#", 1)))


def records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reader_records").where("repository is not null and record_id is not null").select(_record("record_id").alias("node")).distinct()


def record_edges(spark: SparkSession, d: str, verb: str | None = None, certainty: str | None = None) -> DataFrame:
    """Relationships between records that exist."""
    r = table(spark, d, "reader_relationships").where("repository is not null and source_id is not null and target_id is not null")
    r = r.where(F.col("verb") == verb) if verb else r
    r = r.where(F.col("certainty") == certainty) if certainty else r
    known = records(spark, d)
    edges = r.select(_record("source_id").alias("source"), _record("target_id").alias("target")).distinct()
    return edges.join(known.withColumnRenamed("node", "source"), "source", "left_semi").join(known.withColumnRenamed("node", "target"), "target", "left_semi").select("source", "target")


def components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(records(spark, d), record_edges(spark, d))


def orphans(spark: SparkSession, d: str) -> DataFrame:
    """Records without a declared relationship to another record."""
    return graph.degrees(records(spark, d), record_edges(spark, d, certainty="declared")).where("degree = 0").select("node")


def _top_nodes(spark: SparkSession, d: str, n: int) -> DataFrame:
    """The nodes of the greatest degree of each repository."""
    deg = graph.degrees(records(spark, d), record_edges(spark, d)).withColumn("repository", F.substring_index("node", "/", 1))
    return search.top(deg, n, F.col("degree").desc(), "node", by="repository")


def focus_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    """Around the record of the greatest degree of each repository, two steps in either direction."""
    focus = _top_nodes(spark, d, 1).select(F.col("node").alias("focus"), "node")
    return graph.walk(focus, graph.undirected(record_edges(spark, d)), DEPTH, ("focus",))


def induced_edges(spark: SparkSession, d: str) -> DataFrame:
    """Relationships among the 40 records of the greatest degree of each repository."""
    return graph.induced(record_edges(spark, d), materialise(_top_nodes(spark, d, TOP).select("node"), "nodes"))


def cycle_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Records that depend on themselves in at most six steps."""
    return graph.cycle_nodes(record_edges(spark, d, "depends-on"), 6)


def area_report(spark: SparkSession, d: str) -> DataFrame:
    """Directories that a change of the failed files reaches: how many files, the first and the last of them."""
    failed = table(spark, d, "source_files").where("status = 'failed' and repository is not null").select("repository", canonical(F.col("path")).alias("path")).where("path is not null").distinct()
    links = _map_links(spark, d).where("not (confidence <=> 'unresolved')").select("repository", "source_path", "target_path").distinct()
    callers = links.join(failed.withColumnRenamed("path", "target_path"), ["repository", "target_path"], "left_semi").select("repository", F.col("source_path").alias("path"))
    return failed.unionByName(callers).distinct().groupBy("repository", dirname(F.col("path")).alias("directory")).agg(F.count("*").alias("files"), F.min("path").alias("first_file"), F.max("path").alias("last_file"))


def index_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Concepts in and below each directory."""
    r = table(spark, d, "reader_records").where("repository is not null and record_id is not null and kind = 'concept'").select("repository", canonical(F.col("record_id")).alias("path")).distinct()
    return r.select("repository", "path", F.explode(graph.ancestors(F.col("path"))).alias("directory")).groupBy("repository", "directory").agg(F.count("*").alias("below"), F.count_if(dirname(F.col("path")) == F.col("directory")).alias("inside"))


def longest_prefix_scope(spark: SparkSession, d: str) -> DataFrame:
    """Each file's nearest scope; scopes are the directories that hold at least five files themselves, ``.`` is the rest."""
    files = _map_files(spark, d).select("repository", "path")
    scopes = files.groupBy("repository", dirname(F.col("path")).alias("scope")).count().where("count >= 5 and scope != ''").select("repository", "scope")
    above = files.select("repository", "path", F.explode(graph.ancestors(F.col("path"))).alias("scope"))
    held = above.join(scopes, ["repository", "scope"]).groupBy("repository", "path").agg(F.max_by("scope", F.length("scope")).alias("scope"))
    return files.join(held, ["repository", "path"], "left").select("repository", "path", F.coalesce("scope", F.lit(".")).alias("scope"))


def cross_root_walk(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of other repositories that calls from removed symbols lead to, with the symbol each walk began at."""
    seeds = _removed(spark, d).select(F.col("node").alias("seed"), "node")
    reached = graph.walk(seeds, _sure(call_edges(spark, d)), DEPTH + 1, ("seed",))
    return reached.where(F.substring_index("seed", "::", 1) != F.substring_index("node", "::", 1)).select("seed", "node", "depth")


QUERIES: dict[str, Query] = {f.__name__: f for f in (cross_root_walk, trace_callees, trace_callers, trace_unresolved_boundary, change_impact, hotspots, clusters, repository_totals, components, orphans, focus_neighbourhood, induced_edges, cycle_nodes, area_report, index_rollup, longest_prefix_scope)}

_C, _D = common.canon, common.dirname


def _key(x: str) -> str:
    return f"{_C(f"split_part({x}, '::', 1)")} || substr({x}, length(split_part({x}, '::', 1)) + 1)"


_REST = "substr(target_key, length(split_part(target_key, '::', 1)) + 3)"
_EDGES = f"""edges AS (SELECT DISTINCT repository || '::' || {_key("source_key")} AS source,
    CASE WHEN confidence IS NOT DISTINCT FROM 'unresolved' THEN target_key WHEN contains({_REST}, '::') THEN split_part(target_key, '::', 1) || '::' || {_key(_REST)}
         ELSE repository || '::' || {_key("target_key")} END AS target, confidence FROM call_edges WHERE repository IS NOT NULL AND source_key IS NOT NULL AND target_key IS NOT NULL),
sure AS (SELECT DISTINCT source, target FROM edges WHERE confidence IS DISTINCT FROM 'unresolved')"""
_SYMBOLS = f"syms AS (SELECT *, repository || '::' || {_key('symbol_key')} AS node FROM symbols WHERE repository IS NOT NULL AND symbol_key IS NOT NULL)"
_SEEDS = "seeds AS (SELECT DISTINCT node FROM syms WHERE removed_at IS NOT NULL)"
_WALK = "WITH RECURSIVE {ctes}, walk AS (SELECT node, 0 AS depth FROM seeds UNION SELECT e.{to}, w.depth + 1 FROM walk w JOIN sure e ON e.{at} = w.node WHERE w.depth < {depth}), least AS (SELECT node, min(depth) AS depth FROM walk GROUP BY 1)"


def _walk(at: str, to: str, depth: int = DEPTH) -> str:
    return _WALK.format(ctes=f"{_EDGES}, {_SYMBOLS}, {_SEEDS}", at=at, to=to, depth=depth)


_MAP = f"""files AS (SELECT repository, {_C("path")} AS path, max(symbol_count) AS symbol_count, lower(regexp_extract({_C("path")}, '(\\.[^./]+)$', 1)) AS language FROM source_files WHERE repository IS NOT NULL AND path IS NOT NULL GROUP BY 1, 2, 4),
links AS (SELECT DISTINCT repository, {_C("path")} AS s, {_C("target_path")} AS t, confidence FROM call_edges WHERE path IS NOT NULL AND target_path IS NOT NULL),
high AS (SELECT DISTINCT l.repository, s, t FROM links l JOIN files a ON a.repository = l.repository AND a.path = s JOIN files b ON b.repository = l.repository AND b.path = t WHERE confidence = 'high'),
each AS (SELECT f.*, (SELECT count(*) FROM high h WHERE h.repository = f.repository AND h.t = f.path AND h.s <> h.t) AS incoming_files, (SELECT count(*) FROM high h WHERE h.repository = f.repository AND h.s = f.path AND h.s <> h.t) AS outgoing_files FROM files f)"""
_RECORDS = f"recs AS (SELECT DISTINCT repository || '/' || {_C("split_part(record_id, '#', 1)")} AS node FROM reader_records WHERE repository IS NOT NULL AND record_id IS NOT NULL)"


def _rel(where: str = "true") -> str:
    return f"""{_RECORDS}, raw AS (SELECT DISTINCT repository || '/' || {_C("split_part(source_id, '#', 1)")} AS source, repository || '/' || {_C("split_part(target_id, '#', 1)")} AS target FROM reader_relationships
WHERE repository IS NOT NULL AND source_id IS NOT NULL AND target_id IS NOT NULL AND {where}),
rel AS (SELECT * FROM raw WHERE source IN (SELECT node FROM recs) AND target IN (SELECT node FROM recs)),
twoway AS (SELECT source, target FROM rel WHERE source <> target UNION SELECT target, source FROM rel WHERE source <> target),
deg AS (SELECT node, (SELECT count(*) FROM twoway b WHERE b.source = node) AS degree FROM recs),
tops AS (SELECT *, row_number() OVER (PARTITION BY split_part(node, '/', 1) ORDER BY degree DESC, node) AS r FROM deg)"""


ORACLE: dict[str, str] = {
    "trace_callees": f"{_walk('source', 'target')} SELECT node, depth FROM least",
    "trace_callers": f"{_walk('target', 'source')} SELECT node, depth FROM least",
    "trace_unresolved_boundary": f"{_walk('source', 'target', DEPTH - 1)} SELECT e.source, e.target, e.confidence, l.depth + 1 AS depth FROM least l JOIN edges e ON e.source = l.node",
    "change_impact": f"""WITH RECURSIVE {_EDGES}, {_SYMBOLS},
seeds AS (SELECT DISTINCT s.node FROM syms s JOIN source_files f ON f.repository = s.repository AND {_C("f.path")} = {_C("s.path")} WHERE f.status = 'failed'),
walk AS (SELECT node AS seed, node, 0 AS depth FROM seeds UNION SELECT w.seed, e.source, w.depth + 1 FROM walk w JOIN sure e ON e.target = w.node WHERE w.depth < {DEPTH})
SELECT seed, node, min(depth) AS depth FROM walk GROUP BY 1, 2 HAVING min(depth) > 0""",
    "cross_root_walk": f"""WITH RECURSIVE {_EDGES}, {_SYMBOLS}, {_SEEDS}, walk AS (SELECT node AS seed, node, 0 AS depth FROM seeds UNION SELECT w.seed, e.target, w.depth + 1 FROM walk w JOIN sure e ON e.source = w.node WHERE w.depth < {DEPTH + 1})
SELECT seed, node, min(depth) AS depth FROM walk WHERE split_part(seed, '::', 1) <> split_part(node, '::', 1) GROUP BY 1, 2""",
    "hotspots": f"WITH {_MAP} SELECT repository, path, incoming_files, outgoing_files, incoming_files + outgoing_files AS coupling, symbol_count::BIGINT AS symbol_count FROM each WHERE incoming_files + outgoing_files > 0",
    "clusters": f"""WITH {_MAP}, placed AS (SELECT *, {_D("path")} AS directory, row_number() OVER (PARTITION BY repository, {_D("path")} ORDER BY incoming_files + outgoing_files DESC, coalesce(symbol_count, 0) DESC, path) AS r FROM each),
outs AS (SELECT repository, {_D("s")} AS directory, count(DISTINCT {_D("t")}) AS n FROM high WHERE {_D("s")} <> {_D("t")} GROUP BY 1, 2)
SELECT p.repository, p.directory, count(*) AS files, sum(coalesce(symbol_count, 0))::BIGINT AS symbols, array_to_string(list_sort(list(DISTINCT language)), ',') AS languages, string_agg(path, ',' ORDER BY r) FILTER (r <= 3) AS hubs, coalesce(any_value(o.n), 0) AS outgoing_directories
FROM placed p LEFT JOIN outs o ON o.repository = p.repository AND o.directory = p.directory GROUP BY 1, 2""",
    "repository_totals": f"""WITH f AS (SELECT repository, {_C("path")} AS path, max(ceil(len(string_split_regex(body, '\\r?\\n')) / 80)) AS n FROM source_files WHERE repository IS NOT NULL AND path IS NOT NULL GROUP BY 1, 2),
{_SYMBOLS}, r AS (SELECT DISTINCT repository FROM f UNION SELECT repository FROM syms UNION SELECT repository FROM call_edges WHERE repository IS NOT NULL)
SELECT repository, (SELECT count(*) FROM f WHERE f.repository = r.repository) AS files, (SELECT count(DISTINCT node) FROM syms s WHERE s.repository = r.repository) AS symbols,
       (SELECT count(DISTINCT edge_id) FROM call_edges c WHERE c.repository = r.repository) AS edges, (SELECT coalesce(sum(n), 0)::BIGINT FROM f WHERE f.repository = r.repository) AS windows FROM r""",
    "components": f"WITH RECURSIVE {_rel()}, reach AS (SELECT node, node AS other FROM recs UNION SELECT r.node, b.target FROM reach r JOIN twoway b ON b.source = r.other) SELECT node, min(other) AS component FROM reach GROUP BY 1",
    "orphans": f"WITH {_rel("certainty = 'declared'")} SELECT node FROM deg WHERE degree = 0",
    "focus_neighbourhood": f"""WITH RECURSIVE {_rel()}, walk AS (SELECT node AS focus, node, 0 AS depth FROM tops WHERE r = 1 UNION SELECT w.focus, b.target, w.depth + 1 FROM walk w JOIN twoway b ON b.source = w.node WHERE w.depth < {DEPTH})
SELECT focus, node, min(depth) AS depth FROM walk GROUP BY 1, 2""",
    "induced_edges": f"WITH {_rel()} SELECT source, target FROM rel WHERE source IN (SELECT node FROM tops WHERE r <= {TOP}) AND target IN (SELECT node FROM tops WHERE r <= {TOP})",
    "cycle_nodes": f"""WITH RECURSIVE {_rel("verb = 'depends-on'")}, walk AS (SELECT source AS origin, target AS node, 1 AS length FROM rel UNION SELECT w.origin, e.target, w.length + 1 FROM walk w JOIN rel e ON e.source = w.node WHERE w.length < 6)
SELECT origin AS node, min(length) AS length FROM walk WHERE origin = node GROUP BY 1""",
    "area_report": f"""WITH failed AS (SELECT DISTINCT repository, {_C("path")} AS path FROM source_files WHERE status = 'failed' AND repository IS NOT NULL AND path IS NOT NULL),
hit AS (SELECT * FROM failed UNION SELECT e.repository, {_C("e.path")} FROM call_edges e JOIN failed f ON f.repository = e.repository AND f.path = {_C("e.target_path")} WHERE e.path IS NOT NULL AND e.confidence IS DISTINCT FROM 'unresolved')
SELECT repository, {_D("path")} AS directory, count(*) AS files, min(path) AS first_file, max(path) AS last_file FROM hit GROUP BY 1, 2""",
    "index_rollup": f"""WITH r AS (SELECT DISTINCT repository, {_C("record_id")} AS path FROM reader_records WHERE repository IS NOT NULL AND record_id IS NOT NULL AND kind = 'concept'),
dirs AS (SELECT DISTINCT repository, array_to_string(p[1:n], '/') AS directory FROM (SELECT repository, p, unnest(range(1, len(p))) AS n FROM (SELECT repository, string_split(path, '/') AS p FROM r)))
SELECT d.repository, d.directory, count(*) AS below, count(*) FILTER ({_D("r.path")} = d.directory) AS inside FROM dirs d JOIN r ON r.repository = d.repository AND starts_with(r.path, d.directory || '/') GROUP BY 1, 2""",
    "longest_prefix_scope": f"""WITH f AS (SELECT DISTINCT repository, {_C("path")} AS path FROM source_files WHERE repository IS NOT NULL AND path IS NOT NULL),
s AS (SELECT repository, {_D("path")} AS scope FROM f GROUP BY 1, 2 HAVING count(*) >= 5 AND {_D("path")} <> '')
SELECT f.repository, f.path, coalesce(arg_max(s.scope, length(s.scope)), '.') AS scope FROM f LEFT JOIN s ON s.repository = f.repository AND starts_with(f.path, s.scope || '/') GROUP BY 1, 2""",
}
