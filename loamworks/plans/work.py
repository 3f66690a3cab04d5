"""Queries of name resolution, of several repositories together, of documentation to revise, of studies, parsing and the refresh stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import canonical, dirname
from ..functions.text import identifier_parts
from ..operators import parsing, resolution, search, snapshots, study
from ..session import materialise
from ..sources.tables import table
from ..streaming import refresh
from . import common, retrieval, structure
from .data_quality import COUNTED

Query = Callable[[SparkSession, str], DataFrame]
ARM, BASE = "runtime", "ordinary"
PATHS, DOCUMENTS, TERMS = 20, 12, 20
ROOT_LIMIT, LIMIT, RANK_BASE = 20, 20, 60
# Words that say nothing about what a file is for.
STOP = "the and for with from this that src lib test tests docs examples scripts packages services const return function import export class def let var new not null true false public static void int string number package example".split()


def _live(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbols").where("repository is not null and symbol_key is not null and path is not null and removed_at is null")
    return s.select("repository", "symbol_name", "qualname", canonical(F.col("path")).alias("path"), structure.symbol_node(F.col("repository"), F.col("symbol_key")).alias("definition"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Unresolved targets: the last part of the text is the name."""
    e = table(spark, d, "call_edges").where("confidence = 'unresolved' and target_key is not null and repository is not null and edge_id is not null")
    return e.select("edge_id", "repository", canonical(F.substring_index("source_key", "::", 1)).alias("path"), F.expr("substring_index(source_key, '::', -1)").alias("owner"), F.substring_index("target_key", ".", -1).alias("name")).distinct()


def unique_name_resolution(spark: SparkSession, d: str) -> DataFrame:
    found = resolution.candidates(_live(spark, d), {"repository": F.col("repository"), "name": F.col("symbol_name")}, "repository")
    return resolution.ladder(_texts(spark, d), [("repository", found, ["repository", "name"])]).select("edge_id", "name", "n_candidates", "definition", "confidence")


def nearest_scope_binding(spark: SparkSession, d: str) -> DataFrame:
    """Own class, own file, own directory, repository: the first scope that knows the name decides."""
    live = _live(spark, d).withColumn("directory", dirname(F.col("path")))
    c = F.col
    refs = _texts(spark, d).withColumn("directory", dirname(c("path"))).withColumn("class_name", F.when(c("owner").contains("."), F.concat(F.regexp_replace("owner", r"\.[^.]*$", "."), c("name"))))
    rungs = [
        ("class", resolution.candidates(live, {"repository": c("repository"), "path": c("path"), "class_name": c("qualname")}, "class"), ["repository", "path", "class_name"]),
        ("file", resolution.candidates(live, {"repository": c("repository"), "path": c("path"), "name": c("symbol_name")}, "file"), ["repository", "path", "name"]),
        ("directory", resolution.candidates(live, {"repository": c("repository"), "directory": c("directory"), "name": c("symbol_name")}, "directory"), ["repository", "directory", "name"]),
        ("repository", resolution.candidates(live, {"repository": c("repository"), "name": c("symbol_name")}, "repository"), ["repository", "name"]),
    ]
    return resolution.ladder(refs, rungs).select("edge_id", "rung", "n_candidates", "definition", "confidence")


def reexport_closure(spark: SparkSession, d: str) -> DataFrame:
    """What a superseded record is called now: at most five steps, and only if there is one end."""
    e = structure.record_edges(spark, d, "supersedes")
    return resolution.chain_ends(e.select(F.col("target").alias("source"), F.col("source").alias("target")), 5)


def doc_discovery_merge(spark: SparkSession, d: str) -> DataFrame:
    """Documents to look at after a change of the failed files: the first 20 files by kind are queries, hits are merged."""
    p = F.col("path")
    kind = F.when(p.rlike(r"(?i)\.mdx?$"), 3).when(p.rlike(r"(?i)(^|/)(tests?|scripts)/"), 1).when(p.rlike(r"(?i)\.(py|ts|js|go|java)$"), 0).otherwise(2)
    failed = table(spark, d, "source_files").where("status = 'failed' and repository is not null and path is not null").select("repository", canonical(p).alias("path")).distinct().orderBy(kind, "repository", "path").limit(PATHS)
    failed = materialise(failed, "changed")
    names = _live(spark, d).groupBy("repository", "path").agg(F.array_join(F.sort_array(F.collect_set("symbol_name")), " ").alias("names"))
    text = F.concat_ws(" ", F.coalesce("names", F.lit("")), F.regexp_replace("path", r"\.[^./]+$", ""))
    words = F.filter(F.array_distinct(F.transform(identifier_parts(text), F.lower)), lambda w: (F.length(w) > 2) & ~w.isin(*STOP))
    queries = failed.join(names, ["repository", "path"], "left").select(F.concat_ws("::", "repository", "path").alias("query_id"), F.array_join(F.slice(words, 1, TERMS), " ").alias("query"))
    best = retrieval.best_of(retrieval.documents(spark, d), materialise(queries, "queries")).where("path rlike '(?i)[.]mdx?$'")
    hits = search.top(best, DOCUMENTS + 1, "rank", "path")
    merged = hits.groupBy("path").agg(F.count("*").alias("changed_paths"), F.min("rank").alias("rank")).withColumn("all", F.lit(1))
    return search.top(merged, DOCUMENTS, F.col("changed_paths").desc(), "rank", "path", by="all").select("path", "changed_paths", "rank", F.col("position").cast("long").alias("position"))


def federated_find(spark: SparkSession, d: str) -> DataFrame:
    """Each source is a root: its first 20 documents count by their place there, and roots take turns."""
    files, items = retrieval.documents(spark, d), retrieval.items(spark, d)
    roots = table(spark, d, "documents").where("source is not null").select(canonical(F.col("path")).alias("path"), "source")
    best = retrieval.best_of(files, items).join(roots, "path").withColumn("key", F.struct("query_id", "source"))
    local = search.top(best, ROOT_LIMIT, "rank", "path", by="key").withColumnRenamed("position", "root_position")
    scored = local.withColumn("score", F.round(F.lit(1.0) / (RANK_BASE + F.col("root_position")), 8))
    return search.top(scored, LIMIT, "root_position", "source", "path").select("query_id", "source", "path", F.col("root_position").cast("long").alias("root_position"), "score", F.col("position").cast("long").alias("position"))


def _current(spark: SparkSession, d: str) -> DataFrame:
    """(repository, current): does the latest snapshot_no count?"""
    s = table(spark, d, "snapshots")
    last = s.where("repository is not null").groupBy("repository").agg(F.max(F.col("snapshot_no").cast("int")).alias("last_no"))
    counted = snapshots.counted_snapshots(table(spark, d, "file_rows"), s).groupBy("repository").agg(F.max("snapshot_no").alias("counted_no"))
    return last.join(counted, "repository", "left").select("repository", F.coalesce(F.col("last_no") == F.col("counted_no"), F.lit(False)).alias("current"))


def federated_withhold(spark: SparkSession, d: str) -> DataFrame:
    """Calls into other repositories; those into one whose latest snapshot doesn't count are withheld."""
    e = table(spark, d, "call_edges").where("not (confidence <=> 'unresolved')").select("edge_id", "repository", "target_key").where("target_key is not null").distinct()
    rest = F.expr("substring(target_key, length(substring_index(target_key, '::', 1)) + 3)")
    cross = e.where(rest.contains("::")).select("edge_id", "repository", F.substring_index("target_key", "::", 1).alias("root"), "target_key").where("root != repository")
    now = _current(spark, d).withColumnRenamed("repository", "root")
    held = F.coalesce("current", F.lit(False))
    return cross.join(now, "root", "left").select("edge_id", "root", F.when(held, F.col("target_key")).alias("target"), F.when(held, "current").when(F.col("current").isNull(), "unknown-root").otherwise("withheld").alias("status"))


def federated_completeness(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "source_files").where("repository is not null").groupBy("repository").agg(F.count_if(F.col("status").isin("failed", "partial", "unsupported") | F.col("status").isNull()).alias("omitted"))
    return _current(spark, d).join(files, "repository", "left").select("repository", "current", F.coalesce("omitted", F.lit(0).cast("long")).alias("omitted"), (F.col("current") & (F.coalesce("omitted", F.lit(0)) == 0)).alias("complete"))


def dependency_ladder(spark: SparkSession, d: str) -> DataFrame:
    """The first reason why a relationship is no more than a candidate."""
    known = structure.records(spark, d)
    key = lambda c: F.concat(F.col("repository"), F.lit("/"), canonical(F.substring_index(c, "#", 1)))
    r = table(spark, d, "reader_relationships").where("relation_id is not null").select("relation_id", "certainty", "provenance", key("source_id").alias("s"), key("target_id").alias("t")).distinct()
    r = r.join(known.select(F.col("node").alias("s"), F.lit(1).alias("s_known")), "s", "left").join(known.select(F.col("node").alias("t"), F.lit(1).alias("t_known")), "t", "left")
    reason = (
        F.when(F.col("t").isNull(), "no-target").when(F.col("s_known").isNull(), "unknown-source").when(F.col("t_known").isNull(), "unknown-target").when(F.col("s") == F.col("t"), "self").when(F.coalesce("certainty", F.lit("candidate")) == "candidate", "candidate")
        .when(F.coalesce("provenance", F.lit("")) != "canonical", "not-canonical").otherwise("qualified")
    )
    return r.select("relation_id", reason.alias("reason"))


def _measurements(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "measurements")


@common.wide
def trial_schedule(spark: SparkSession, d: str) -> DataFrame:
    return study.schedule(_measurements(spark, d))


@common.wide
def missing_trials(spark: SparkSession, d: str) -> DataFrame:
    return study.missing_trials(_measurements(spark, d))


def paired_report(spark: SparkSession, d: str) -> DataFrame:
    r = study.reductions(_measurements(spark, d), ARM, BASE)
    return r.select("task", "run_condition", *(F.round(c, 9).alias(c) for c in ("time_reduction", "context_reduction", "correctness")), "pairs")


def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    tasks = study.reductions(_measurements(spark, d), ARM, BASE)
    return study.bootstrap_intervals(tasks, "run_condition", "time_reduction", f"{ARM}:time")


def study_checks(spark: SparkSession, d: str) -> DataFrame:
    m = _measurements(spark, d).where("run_id is not null").groupBy("run_id").agg(F.max(F.struct("recorded_at", "arm", "run_condition", "status", "safety_failures", "mandatory_checks_passed")).alias("s")).select("s.*")
    return m.groupBy("arm", "run_condition").agg(F.count("*").alias("runs"), F.sum("safety_failures").alias("safety_failures"), F.bool_and("mandatory_checks_passed").alias("mandatory"), F.count_if(F.col("status") != "completed").alias("failures"))


def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean and 95th percentile of the refresh passes of each repository."""
    runs = table(spark, d, "refresh_runs").where("repository is not null")
    return study.nearest_rank(runs, ["repository"], "elapsed_ms", 0.95, "run_id").select("repository", "n", F.round("mean", 6).alias("mean"), F.col("elapsed_ms").alias("p95"))


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return parsing.parsed(table(spark, d, "source_files"))


def parse_symbols(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).where("row_kind = 'symbol'").drop("row_kind", "target")


def parse_edges(spark: SparkSession, d: str) -> DataFrame:
    """Calls and imports of each file by the definition they stand in."""
    return _parsed(spark, d).where("row_kind != 'symbol'").groupBy("repository", "path", "qualname", "row_kind", "target").agg(F.count("*").alias("n"), F.min("start_line").alias("first_line"))


def file_api(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of each file that parsing found or that are recorded: where each of them comes from."""
    found = parse_symbols(spark, d).where("repository is not null").select("repository", "path", "qualname", F.lit(1).alias("parsed")).distinct()
    known = table(spark, d, "symbols").where("removed_at is null and repository is not null").select("repository", canonical(F.col("path")).alias("path"), "qualname", F.lit(1).alias("recorded")).distinct()
    files = table(spark, d, "source_files").where("repository is not null and path is not null").select("repository", canonical(F.col("path")).alias("path")).distinct()
    every = found.join(known, ["repository", "path", "qualname"], "full").join(files, ["repository", "path"], "left_semi")
    mode = F.when(F.col("parsed").isNull(), "recorded").when(F.col("recorded").isNull(), "parser").otherwise("parser+recorded")
    return every.groupBy("repository", mode.alias("mode")).agg(F.count("*").alias("symbols"), F.count_distinct("path").alias("files"))


def refresh_stream(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of each path, read as a stream of files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/file_rows.parquet")
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    return refresh.refresh(spark, f"{d}/file_rows.parquet") if whole else refresh.refresh(spark, d, "file_rows.parquet")



QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        unique_name_resolution, nearest_scope_binding, reexport_closure, doc_discovery_merge, federated_find, federated_withhold, federated_completeness, dependency_ladder, trial_schedule, missing_trials,
        paired_report, bootstrap_interval, study_checks, latency_summary, parse_symbols, parse_edges, file_api, refresh_stream,
    )
}

_C, _D = common.canon, common.dirname
_LIVE = f"live AS (SELECT DISTINCT repository, symbol_name, qualname, {_C('path')} AS path, {_D(_C('path'))} AS directory, repository || '::' || {structure._key('symbol_key')} AS definition FROM symbols WHERE repository IS NOT NULL AND symbol_key IS NOT NULL AND path IS NOT NULL AND removed_at IS NULL)"
_TEXTS = f"""refs AS (SELECT DISTINCT edge_id, repository, {_C("split_part(source_key, '::', 1)")} AS path, {_D(_C("split_part(source_key, '::', 1)"))} AS directory, split_part(source_key, '::', -1) AS owner, split_part(target_key, '.', -1) AS name
FROM call_edges WHERE confidence = 'unresolved' AND target_key IS NOT NULL AND repository IS NOT NULL AND edge_id IS NOT NULL)"""


def _count(where: str) -> str:
    return f"(SELECT count(DISTINCT definition) FROM live l WHERE l.repository = r.repository AND {where})", f"(SELECT min(definition) FROM live l WHERE l.repository = r.repository AND {where})"


_RUNGS = {"class": _count("l.path = r.path AND contains(r.owner, '.') AND l.qualname = regexp_replace(r.owner, '\\.[^.]*$', '.') || r.name"), "file": _count("l.path = r.path AND l.symbol_name = r.name"), "directory": _count("l.directory = r.directory AND l.symbol_name = r.name"), "repository": _count("l.symbol_name = r.name")}
_DOCS = retrieval.FILES_SQL
_CURRENT = f"{COUNTED}, cur AS (SELECT s.repository, coalesce(max(s.snapshot_no) = (SELECT max(c.snapshot_no) FROM counted c WHERE c.repository = s.repository), false) AS current FROM snapshots s WHERE repository IS NOT NULL GROUP BY 1)"
_REST = structure._REST
_ONCE = "once AS (SELECT s.* FROM (SELECT run_id, max((recorded_at, task, trial, arm, run_condition, correct, context_bytes, CASE WHEN duration_ms >= 0 THEN duration_ms END + CASE WHEN setup_ms >= 0 THEN setup_ms END + CASE WHEN refresh_ms >= 0 THEN refresh_ms END + CASE WHEN enrichment_ms >= 0 THEN enrichment_ms END)) AS m FROM measurements WHERE run_id IS NOT NULL GROUP BY 1) q, LATERAL (SELECT q.run_id, m[2] AS task, m[3] AS trial, m[4] AS arm, m[5] AS run_condition, m[6] AS correct, m[7] AS context_bytes, m[8] AS cost) s)"
_PLAN = "plan AS (SELECT task, trial, a.arm, c.run_condition FROM (SELECT task, unnest(range(1, max(trial) + 1)) AS trial FROM measurements WHERE task IS NOT NULL AND trial >= 1 GROUP BY task), (SELECT DISTINCT arm FROM measurements WHERE arm IS NOT NULL) a, (SELECT DISTINCT run_condition FROM measurements WHERE run_condition IS NOT NULL) c)"

ORACLE: dict[str, str] = {
    "unique_name_resolution": f"WITH {_LIVE}, {_TEXTS}, n AS (SELECT r.edge_id, r.name, count(DISTINCT l.definition) AS n_candidates, min(l.definition) AS d FROM refs r LEFT JOIN live l ON l.repository = r.repository AND l.symbol_name = r.name GROUP BY r.edge_id, r.repository, r.path, r.owner, r.name) SELECT edge_id, name, n_candidates, CASE WHEN n_candidates = 1 THEN d END AS definition, CASE WHEN n_candidates = 1 THEN 'high' ELSE 'unresolved' END AS confidence FROM n",
    "nearest_scope_binding": f"""WITH {_LIVE}, {_TEXTS}, n AS (SELECT r.edge_id, {", ".join(f"{a} AS n_{k}, {b} AS d_{k}" for k, (a, b) in _RUNGS.items())} FROM refs r),
p AS (SELECT edge_id, CASE {" ".join(f"WHEN n_{k} > 0 THEN '{k}'" for k in _RUNGS)} ELSE 'none' END AS rung, CASE {" ".join(f"WHEN n_{k} > 0 THEN n_{k}" for k in _RUNGS)} ELSE 0 END AS n_candidates, CASE {" ".join(f"WHEN n_{k} > 0 THEN d_{k}" for k in _RUNGS)} END AS d FROM n)
SELECT edge_id, rung, n_candidates, CASE WHEN n_candidates = 1 THEN d END AS definition, CASE WHEN n_candidates = 1 THEN 'high' ELSE 'unresolved' END AS confidence FROM p""",
    "reexport_closure": f"""WITH RECURSIVE {structure._rel("verb = 'supersedes'")}, e AS (SELECT target AS source, source AS target FROM rel WHERE source <> target),
walk AS (SELECT source AS origin, target AS node, 1 AS depth FROM e UNION SELECT w.origin, e.target, w.depth + 1 FROM walk w JOIN e ON e.source = w.node WHERE w.depth < 5),
ends AS (SELECT origin, node FROM walk WHERE node <> origin AND node NOT IN (SELECT source FROM e) GROUP BY 1, 2)
SELECT o.source AS origin, count(ends.node) AS n_ends, CASE WHEN count(ends.node) = 1 THEN min(ends.node) END AS definition FROM (SELECT DISTINCT source FROM e) o LEFT JOIN ends ON ends.origin = o.source GROUP BY 1""",
    "doc_discovery_merge": rf"""WITH {_DOCS}, {_LIVE},
failed AS (SELECT * FROM (SELECT DISTINCT repository, {_C("path")} AS path FROM source_files WHERE status = 'failed' AND repository IS NOT NULL AND path IS NOT NULL)
ORDER BY CASE WHEN regexp_matches(path, '(?i)\.mdx?$') THEN 3 WHEN regexp_matches(path, '(?i)(^|/)(tests?|scripts)/') THEN 1 WHEN regexp_matches(path, '(?i)\.(py|ts|js|go|java)$') THEN 0 ELSE 2 END, repository, path LIMIT {PATHS}),
names AS (SELECT repository, path, string_agg(DISTINCT symbol_name, ' ' ORDER BY symbol_name) AS names FROM live GROUP BY 1, 2),
texts AS (SELECT repository || '::' || path AS query_id, coalesce(names, '') || ' ' || regexp_replace(path, '\.[^./]+$', '') AS t FROM failed LEFT JOIN names USING (repository, path)),
words AS (SELECT query_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT query_id, {common.lexical("t")} AS l FROM texts)),
firsts AS (SELECT query_id, lower(w) AS w, row_number() OVER (PARTITION BY query_id ORDER BY min(i)) AS n FROM words WHERE length(w) > 2 AND lower(w) NOT IN ({", ".join(f"'{s}'" for s in STOP)}) GROUP BY 1, 2),
queries AS (SELECT t.query_id, coalesce(string_agg(w, ' ' ORDER BY n) FILTER (n <= {TERMS}), '') AS query FROM texts t LEFT JOIN firsts f USING (query_id) GROUP BY 1),
{common.bm25("files", "queries")},
first_docs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, path) AS n FROM best WHERE regexp_matches(path, '(?i)[.]mdx?$')) WHERE n <= {DOCUMENTS + 1}),
merged AS (SELECT path, count(*) AS changed_paths, min(rank) AS rank FROM first_docs GROUP BY 1)
SELECT * FROM (SELECT *, row_number() OVER (ORDER BY changed_paths DESC, rank, path) AS position FROM merged) WHERE position <= {DOCUMENTS}""",
    "federated_find": f"""WITH {_DOCS}, queries AS (SELECT item_id AS query_id, passage AS query FROM eval_items), {common.bm25("files", "queries")},
local AS (SELECT * FROM (SELECT b.*, d.source, row_number() OVER (PARTITION BY query_id, d.source ORDER BY rank, b.path) AS root_position FROM best b JOIN documents d ON {_C("d.path")} = b.path WHERE d.source IS NOT NULL) WHERE root_position <= {ROOT_LIMIT})
SELECT query_id, source, path, root_position, round(1.0::DOUBLE / ({RANK_BASE} + root_position), 8) AS score, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY root_position, source, path) AS position FROM local) WHERE position <= {LIMIT}""",
    "federated_withhold": f"""WITH {_CURRENT}, x AS (SELECT DISTINCT edge_id, repository, split_part(target_key, '::', 1) AS root, target_key FROM call_edges WHERE target_key IS NOT NULL AND confidence IS DISTINCT FROM 'unresolved' AND contains({_REST}, '::') AND split_part(target_key, '::', 1) <> repository)
SELECT edge_id, root, CASE WHEN current THEN target_key END AS target, CASE WHEN current THEN 'current' WHEN current IS NULL THEN 'unknown-root' ELSE 'withheld' END AS status FROM x LEFT JOIN cur ON cur.repository = x.root""",
    "federated_completeness": f"""WITH {_CURRENT}, f AS (SELECT repository, count(*) FILTER (status IS NULL OR status IN ('failed', 'partial', 'unsupported')) AS omitted FROM source_files WHERE repository IS NOT NULL GROUP BY 1)
SELECT repository, current, coalesce(omitted, 0) AS omitted, current AND coalesce(omitted, 0) = 0 AS complete FROM cur LEFT JOIN f USING (repository)""",
    "dependency_ladder": f"""WITH {structure._RECORDS}, r AS (SELECT DISTINCT relation_id, certainty, provenance, repository || '/' || {_C("split_part(source_id, '#', 1)")} AS s, repository || '/' || {_C("split_part(target_id, '#', 1)")} AS t FROM reader_relationships WHERE relation_id IS NOT NULL)
SELECT relation_id, CASE WHEN t IS NULL THEN 'no-target' WHEN s IS NULL OR s NOT IN (SELECT node FROM recs) THEN 'unknown-source' WHEN t NOT IN (SELECT node FROM recs) THEN 'unknown-target' WHEN s = t THEN 'self' WHEN coalesce(certainty, 'candidate') = 'candidate' THEN 'candidate'
WHEN coalesce(provenance, '') <> 'canonical' THEN 'not-canonical' ELSE 'qualified' END AS reason FROM r""",
    "trial_schedule": f"WITH {_PLAN} SELECT * FROM plan",
    "missing_trials": f"WITH {_PLAN} SELECT * FROM plan p WHERE NOT EXISTS (SELECT 1 FROM measurements m WHERE m.task = p.task AND m.trial = p.trial AND m.arm = p.arm AND m.run_condition = p.run_condition)",
    "study_checks": "WITH m AS (SELECT run_id, max((recorded_at, arm, run_condition, status, safety_failures, mandatory_checks_passed)) AS s FROM measurements WHERE run_id IS NOT NULL GROUP BY 1) SELECT s[2] AS arm, s[3] AS run_condition, count(*) AS runs, sum(s[5])::BIGINT AS safety_failures, bool_and(s[6]) AS mandatory, count(*) FILTER (s[4] <> 'completed') AS failures FROM m GROUP BY 1, 2",
    "paired_report": f"""WITH {_ONCE}, t AS (SELECT * FROM once WHERE task IS NOT NULL AND trial IS NOT NULL AND arm IS NOT NULL AND run_condition IS NOT NULL QUALIFY row_number() OVER (PARTITION BY task, trial, arm, run_condition ORDER BY run_id) = 1),
p AS (SELECT o.task, o.run_condition, CASE WHEN o.cost > 0 THEN 1 - t.cost::DOUBLE / o.cost END AS tr, CASE WHEN o.context_bytes > 0 THEN 1 - t.context_bytes::DOUBLE / o.context_bytes END AS cr, t.correct::INT - o.correct::INT AS d
FROM t o JOIN t ON t.task = o.task AND t.trial = o.trial AND t.run_condition = o.run_condition WHERE o.arm = '{BASE}' AND t.arm = '{ARM}')
SELECT task, run_condition, round(median(tr), 9) AS time_reduction, round(median(cr), 9) AS context_reduction, round(avg(d), 9) AS correctness, count(*) AS pairs FROM p GROUP BY 1, 2""",
    "latency_summary": "WITH r AS (SELECT repository, elapsed_ms, row_number() OVER (PARTITION BY repository ORDER BY elapsed_ms, run_id) AS k, count(*) OVER (PARTITION BY repository) AS n, avg(elapsed_ms) OVER (PARTITION BY repository) AS mean FROM refresh_runs WHERE repository IS NOT NULL AND elapsed_ms IS NOT NULL) SELECT repository, n, round(mean, 6) AS mean, elapsed_ms AS p95 FROM r WHERE k = ceil(n * 0.95::DOUBLE)",
    "refresh_stream": f"""WITH f AS (SELECT repository, {_C("path")} AS path, max((snapshot_no, delivery, row_id, lower(content_hash))) AS s FROM file_rows WHERE repository IS NOT NULL AND path IS NOT NULL GROUP BY 1, 2) SELECT repository, path, s[1] AS snapshot_no, s[2] AS delivery, s[3] AS row_id, s[4] AS content_hash FROM f""",
}
