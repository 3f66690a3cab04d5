"""Further queries of records and repositories: claims, hand-overs, drift, order of work, changed names, search in code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import canonical
from ..functions.text import lines
from ..operators import freshness, graph, search, snapshots
from ..session import materialise
from ..sources.tables import table
from . import common, knowledge, scans, structure
from .data_quality import COUNTED
from .knowledge import NOW, STALE_DAYS, counted_files, pattern_impact, trust_signals

Query = Callable[[SparkSession, str], DataFrame]
LIMIT, NAMES = 10, 100


def claim_bindings(spark: SparkSession, d: str) -> DataFrame:
    """Where the content that an entry's plain source had at its snapshot is in the last one: in place, moved, at several places or nowhere."""
    counted, files = counted_files(spark, d)
    plain = freshness.entry_sources(table(spark, d, "knowledge_entries")).where("not contains(key, '*') and not contains(key, '{')").select("entry_id", "repository", "snapshot_no", "key").distinct()
    last = counted.groupBy("repository").agg(F.max("snapshot_no").alias("last_no"))
    digest = files.groupBy("repository", "snapshot_no", F.col("path").alias("key")).agg(F.max("content_hash").alias("digest"))
    now = digest.join(last.withColumnRenamed("last_no", "snapshot_no"), ["repository", "snapshot_no"], "left_semi").select("repository", "key", "digest")
    bound = plain.join(digest, ["repository", "snapshot_no", "key"], "left").withColumnRenamed("digest", "then")
    here = now.withColumnRenamed("digest", "now")
    places = now.groupBy("repository", F.col("digest").alias("then")).agg(F.count("*").alias("places"))
    each = bound.join(here, ["repository", "key"], "left").join(places, ["repository", "then"], "left")
    state = F.when(F.col("then").isNull(), "unsupported").when(F.col("now") == F.col("then"), "exact").when(F.coalesce("places", F.lit(0)) == 0, "missing").when(F.col("places") == 1, "moved-candidate").otherwise("ambiguous")
    return each.select("entry_id", "key", state.alias("state"))


def claim_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Per entry: current if all is in place, unresolved if something can't be told, else to be reviewed."""
    s = F.col("state")
    return claim_bindings(spark, d).groupBy("entry_id").agg(F.when(F.bool_and(s == "exact"), "current").when(F.bool_or(s.isin("unsupported", "ambiguous", "missing")), "unresolved").otherwise("review-needed").alias("verdict"))


def handoff_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Of a source's hand-overs the last one is active until it expires."""
    h = table(spark, d, "documents").where("doc_type = 'handoff' and source is not null and updated_at is not null").select("doc_id", "source", F.col("updated_at").cast("timestamp").alias("updated_at"))
    last = h.groupBy("source").agg(F.max(F.struct("updated_at", "doc_id")).alias("l")).select("source", F.col("l.doc_id").alias("last_id"))
    expired = F.col("updated_at") + F.expr(f"interval {STALE_DAYS} days") <= F.to_timestamp(F.lit(NOW))
    return h.join(last, "source").select("doc_id", "source", F.when(F.col("doc_id") != F.col("last_id"), "superseded").when(expired, "expired").otherwise("active").alias("state"))


def artifact_drift(spark: SparkSession, d: str) -> DataFrame:
    """Every snapshot_no next to the counted one before it: identical, drifted, or not to be told."""
    counted, files = counted_files(spark, d)
    every = table(spark, d, "snapshots").where("repository is not null and snapshot_no is not null").select("repository", F.col("snapshot_no").cast("int").alias("snapshot_no")).distinct()
    n = freshness.refresh_counters(files, snapshots.snapshot_changes(table(spark, d, "file_rows"), table(spark, d, "snapshots")))
    n = n.select("repository", "snapshot_no", (F.col("changed") + F.col("added") + F.col("removed")).alias("dirty"))
    out = every.join(counted.select("repository", "snapshot_no", F.lit(True).alias("full")), ["repository", "snapshot_no"], "left").join(n, ["repository", "snapshot_no"], "left")
    state = F.when(F.col("full").isNull(), "incomplete").when(F.col("dirty").isNull(), "baseline").when(F.col("dirty") == 0, "identical-artifacts").otherwise("artifact-drift")
    return out.select("repository", "snapshot_no", state.alias("state"), F.coalesce("dirty", F.lit(0).cast("long")).alias("dirty_paths"))


def work_order(spark: SparkSession, d: str) -> DataFrame:
    """Layers of records by what they depend on; null: part of a circle, or depends on one."""
    return graph.layers(structure.record_edges(spark, d, "depends-on"))


def changed_symbol_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of the symbols that runs of lines with remarks touch, per file, the first hundred."""
    hits = scans.diff_impact_overlap(spark, d).where("symbol is not null").select("repository", "path", F.substring_index("symbol", "::", -1).alias("name")).distinct()
    return hits.groupBy("repository", "path").agg(F.count("*").alias("names"), F.array_join(F.slice(F.sort_array(F.collect_list("name")), 1, NAMES), ",").alias("first_names"))


def workspace_map(spark: SparkSession, d: str) -> DataFrame:
    """What each repository holds, by kind, with the least and the greatest identity."""
    r = F.col("repository")
    t = lambda n: table(spark, d, n).where("repository is not null")
    kinds = {
        "file": t("source_files").select(r, canonical(F.col("path")).alias("identity")), "symbol": t("symbols").where("removed_at is null").select(r, F.col("symbol_key").alias("identity")), "edge": t("call_edges").select(r, F.col("edge_id").cast("string").alias("identity")),
        "record": t("reader_records").where("removed_at is null").select(r, canonical(F.col("record_id")).alias("identity")), "relationship": t("reader_relationships").select(r, F.col("relation_id").cast("string").alias("identity")),
    }
    parts = [df.withColumn("kind", F.lit(k)) for k, df in kinds.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.where("identity is not null").distinct().groupBy("repository", "kind").agg(F.count("*").alias("items"), F.min("identity").alias("first_item"), F.max("identity").alias("last_item"))


def bundle_roots(spark: SparkSession, d: str) -> DataFrame:
    """The nearest directory above each record that holds a concept of its own."""
    rows = table(spark, d, "reader_records").where("repository is not null and record_id is not null").select("repository", canonical(F.col("record_id")).alias("path"), "kind").distinct()
    roots = rows.where("kind = 'concept' and contains(path, '/')").select("repository", F.regexp_replace("path", "/[^/]*/[^/]*$", "").alias("root")).where("not contains(root, '.md')").distinct()
    return graph.nearest_above(rows.select("repository", "path").distinct(), roots)


def code_search(spark: SparkSession, d: str) -> DataFrame:
    """Names of removed symbols looked for in the files' text and in their definitions, which so count twice."""
    key = F.concat(F.col("repository"), F.lit("/"), canonical(F.col("path")))
    files = table(spark, d, "source_files").where("repository is not null and path is not null").groupBy(key.alias("path")).agg(F.max("body").alias("text"))
    symbols = table(spark, d, "symbols").where("repository is not null and path is not null and removed_at is null").select(key.alias("path"), "qualname", "start_line", "end_line")
    gone = table(spark, d, "symbols").where("removed_at is not null and symbol_name is not null").select(F.col("symbol_name").alias("query_id"), F.col("symbol_name").alias("query")).distinct()
    chunks = search.chunk_windows(files).withColumn("symbol", F.lit(None).cast("string")).unionByName(search.symbol_windows(files, symbols))
    best = search.best_chunks(search.ranked_chunks(search.index(chunks), materialise(gone, "names")))
    return search.top(best, LIMIT, "rank", "path").select("query_id", F.col("position").cast("long").alias("position"), "path", "rank")


def quote_check(spark: SparkSession, d: str) -> DataFrame:
    """Do the lines that each live symbol states still hold its name? Symbols and states per repository."""
    key = ["repository", "path"]
    files = table(spark, d, "source_files").where("repository is not null and path is not null").select("repository", canonical(F.col("path")).alias("path"), lines(F.col("body")).alias("l")).dropDuplicates(key)
    s = table(spark, d, "symbols").where("removed_at is null and repository is not null and path is not null").select("repository", canonical(F.col("path")).alias("path"), "symbol_key", "symbol_name", "start_line", "end_line").distinct()
    quoted = F.array_join(F.slice("l", F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))), "\n")
    state = F.when(F.col("l").isNull(), "missing").when((F.col("start_line") < 1) | (F.col("end_line") > F.size("l")), "out of range").when(quoted.contains(F.col("symbol_name")), "quoted").otherwise("moved")
    return s.join(files, key, "left").groupBy("repository", state.alias("state")).agg(F.count("*").alias("symbols"))


def documentation_assess(spark: SparkSession, d: str) -> DataFrame:
    """What a repository's last changes ask of each entry: nothing, an update, or a decision where a person vouched for it."""
    impact, trust = pattern_impact(spark, d), trust_signals(spark, d)
    outcome = F.when(F.col("outcome") == "no-op", "no-op").when(F.col("trust") == "human-reviewed", "decision-required").otherwise("update")
    return impact.join(trust, "entry_id").select("entry_id", outcome.alias("outcome"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (quote_check, documentation_assess, claim_bindings, claim_verdicts, handoff_lifecycle, artifact_drift, work_order, changed_symbol_names, workspace_map, bundle_roots, code_search)}

_C = common.canon
_BOUND = f"""WITH {COUNTED}, src AS (SELECT DISTINCT entry_id, repository, snapshot_no, {_C("source")} AS key FROM (SELECT entry_id, repository, snapshot_no, unnest(sources) AS source FROM knowledge_entries) WHERE source IS NOT NULL AND entry_id IS NOT NULL AND repository IS NOT NULL AND NOT contains(source, '*') AND NOT contains(source, '{{')),
last AS (SELECT repository, max(snapshot_no) AS n FROM counted GROUP BY 1), now AS (SELECT h.repository, h.path, h.hash FROM held h JOIN last l ON l.repository = h.repository AND l.n = h.snapshot_no),
m AS (SELECT s.entry_id, s.key, t.hash AS then_hash, n.hash AS now_hash, (SELECT count(*) FROM now x WHERE x.repository = s.repository AND x.hash = t.hash) AS places FROM src s
LEFT JOIN held t ON t.repository = s.repository AND t.snapshot_no = s.snapshot_no AND t.path = s.key LEFT JOIN now n ON n.repository = s.repository AND n.path = s.key),
b AS (SELECT entry_id, key, CASE WHEN then_hash IS NULL THEN 'unsupported' WHEN now_hash = then_hash THEN 'exact' WHEN places = 0 THEN 'missing' WHEN places = 1 THEN 'moved-candidate' ELSE 'ambiguous' END AS state FROM m)"""
_PARTS = [f"SELECT repository, 'file' AS kind, {_C('path')} AS identity FROM source_files", "SELECT repository, 'symbol', symbol_key FROM symbols WHERE removed_at IS NULL", "SELECT repository, 'edge', edge_id::VARCHAR FROM call_edges", f"SELECT repository, 'record', {_C('record_id')} FROM reader_records WHERE removed_at IS NULL", "SELECT repository, 'relationship', relation_id::VARCHAR FROM reader_relationships"]
_KEYED = f"repository || '/' || {_C('path')}"

ORACLE: dict[str, str] = {
    "quote_check": rf"""WITH f AS (SELECT repository, {_C("path")} AS path, string_split_regex(any_value(body), '\r?\n') AS l FROM source_files WHERE repository IS NOT NULL AND path IS NOT NULL GROUP BY 1, 2),
s AS (SELECT DISTINCT repository, {_C("path")} AS path, symbol_key, symbol_name, start_line, end_line FROM symbols WHERE removed_at IS NULL AND repository IS NOT NULL AND path IS NOT NULL)
SELECT s.repository, CASE WHEN f.l IS NULL THEN 'missing' WHEN start_line < 1 OR end_line > len(f.l) THEN 'out of range' WHEN contains(array_to_string(f.l[start_line:end_line], chr(10)), symbol_name) THEN 'quoted' ELSE 'moved' END AS state, count(*) AS symbols FROM s LEFT JOIN f ON f.repository = s.repository AND f.path = s.path GROUP BY 1, 2""",
    "documentation_assess": f"WITH i AS ({knowledge.ORACLE['pattern_impact']}), t AS ({knowledge.ORACLE['trust_signals']}) SELECT entry_id, CASE WHEN outcome = 'no-op' THEN 'no-op' WHEN trust = 'human-reviewed' THEN 'decision-required' ELSE 'update' END AS outcome FROM i JOIN t USING (entry_id)",
    "claim_bindings": f"{_BOUND} SELECT entry_id, key, state FROM b",
    "claim_verdicts": f"{_BOUND} SELECT entry_id, CASE WHEN bool_and(state = 'exact') THEN 'current' WHEN bool_or(state IN ('unsupported', 'ambiguous', 'missing')) THEN 'unresolved' ELSE 'review-needed' END AS verdict FROM b GROUP BY 1",
    "handoff_lifecycle": f"WITH h AS (SELECT doc_id, source, updated_at, row_number() OVER (PARTITION BY source ORDER BY updated_at DESC, doc_id DESC) AS r FROM documents WHERE doc_type = 'handoff' AND source IS NOT NULL AND updated_at IS NOT NULL) SELECT doc_id, source, CASE WHEN r > 1 THEN 'superseded' WHEN updated_at + INTERVAL {STALE_DAYS} DAY <= TIMESTAMP '{NOW}' THEN 'expired' ELSE 'active' END AS state FROM h",
    "artifact_drift": f"""WITH {COUNTED}, every AS (SELECT DISTINCT repository, snapshot_no FROM snapshots WHERE repository IS NOT NULL AND snapshot_no IS NOT NULL),
p AS (SELECT b.repository, b.snapshot_no, a.snapshot_no AS before_no FROM counted b JOIN counted a ON a.repository = b.repository AND a.idx = b.idx - 1),
o AS (SELECT p.repository, p.snapshot_no, h.path, h.hash FROM p JOIN held h ON h.repository = p.repository AND h.snapshot_no = p.before_no), n AS (SELECT p.repository, p.snapshot_no, h.path, h.hash FROM p JOIN held h ON h.repository = p.repository AND h.snapshot_no = p.snapshot_no),
dirt AS (SELECT repository, snapshot_no, count(*) FILTER (o.hash IS DISTINCT FROM n.hash) AS dirty FROM o FULL JOIN n USING (repository, snapshot_no, path) GROUP BY 1, 2)
SELECT e.repository, e.snapshot_no, CASE WHEN c.idx IS NULL THEN 'incomplete' WHEN d.dirty IS NULL THEN 'baseline' WHEN d.dirty = 0 THEN 'identical-artifacts' ELSE 'artifact-drift' END AS state, coalesce(d.dirty, 0) AS dirty_paths
FROM every e LEFT JOIN counted c USING (repository, snapshot_no) LEFT JOIN dirt d USING (repository, snapshot_no)""",
    "work_order": f"""WITH RECURSIVE {structure._rel("verb = 'depends-on'")}, reach AS (SELECT source AS a, target AS b FROM rel UNION SELECT r.a, e.target FROM reach r JOIN rel e ON e.source = r.b),
bad AS (SELECT DISTINCT a AS node FROM reach WHERE a = b UNION SELECT r.a FROM reach r JOIN (SELECT a FROM reach WHERE a = b) c ON c.a = r.b),
n AS (SELECT source AS node FROM rel UNION SELECT target FROM rel),
up AS (SELECT node, 0 AS layer FROM n WHERE node NOT IN (SELECT node FROM bad) UNION SELECT e.source, u.layer + 1 FROM up u JOIN rel e ON e.target = u.node WHERE e.source NOT IN (SELECT node FROM bad))
SELECT n.node, max(u.layer) AS layer FROM n LEFT JOIN up u ON u.node = n.node GROUP BY 1""",
    "changed_symbol_names": f"WITH o AS ({scans.ORACLE['diff_impact_overlap']}), s AS (SELECT DISTINCT repository, path, split_part(symbol, '::', -1) AS name FROM o WHERE symbol IS NOT NULL) SELECT repository, path, count(*) AS names, array_to_string(list_sort(list(name))[1:{NAMES}], ',') AS first_names FROM s GROUP BY 1, 2",
    "workspace_map": f"SELECT repository, kind, count(DISTINCT identity) AS items, min(identity) AS first_item, max(identity) AS last_item FROM ({' UNION ALL '.join(_PARTS)}) WHERE repository IS NOT NULL AND identity IS NOT NULL GROUP BY 1, 2",
    "bundle_roots": f"""WITH r AS (SELECT DISTINCT repository, {_C("record_id")} AS path, kind FROM reader_records WHERE repository IS NOT NULL AND record_id IS NOT NULL), roots AS (SELECT DISTINCT repository, regexp_replace(path, '/[^/]*/[^/]*$', '') AS root FROM r WHERE kind = 'concept' AND contains(path, '/')),
p AS (SELECT DISTINCT repository, path FROM r) SELECT p.repository, p.path, coalesce(arg_max(o.root, length(o.root)), '.') AS root FROM p LEFT JOIN roots o ON o.repository = p.repository AND NOT contains(o.root, '.md') AND starts_with(p.path, o.root || '/') GROUP BY 1, 2""",
    "code_search": f"""WITH files AS (SELECT {_KEYED} AS path, max(body) AS text FROM source_files WHERE repository IS NOT NULL AND path IS NOT NULL GROUP BY 1),
queries AS (SELECT DISTINCT symbol_name AS query_id, symbol_name AS query FROM symbols WHERE removed_at IS NOT NULL AND symbol_name IS NOT NULL), {common.bm25("files", "queries", f"SELECT {_KEYED} AS path, qualname, start_line, end_line FROM symbols WHERE repository IS NOT NULL AND path IS NOT NULL AND removed_at IS NULL")}
SELECT query_id, position, path, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, path) AS position FROM best) WHERE position <= {LIMIT}""",
}
