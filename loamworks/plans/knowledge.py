"""Queries of snapshots, of what is known about files, and of the events of work on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import canonical
from ..operators import freshness, search, snapshots
from ..sources.tables import table
from . import common
from .data_quality import CHANGES, COUNTED, GLOB

Query = Callable[[SparkSession, str], DataFrame]
NOW, STALE_DAYS = "2026-07-01 00:00:00", 14
MATURE = 50
OPENS, CLOSES = "error", "purchase"
LAST, OWNERS = 20, 3


def counted_files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    counted = snapshots.counted_snapshots(table(spark, d, "file_rows"), table(spark, d, "snapshots"))
    return counted, snapshots.snapshot_files(table(spark, d, "file_rows"), counted)


def _changes(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, d, "file_rows"), table(spark, d, "snapshots"))


def snapshot_digest(spark: SparkSession, d: str) -> DataFrame:
    """What each delivery's rows hash to, and whether its declaration says the same."""
    key = ["repository", "snapshot_no", "delivery"]
    declared = table(spark, d, "snapshots").select("repository", F.col("snapshot_no").cast("int").alias("snapshot_no"), F.col("delivery").cast("int").alias("delivery"), F.lower("input_digest").alias("declared")).where("repository is not null").groupBy(*key).agg(F.max("declared").alias("declared"))
    return snapshots.delivery_digests(table(spark, d, "file_rows")).join(declared, key, "left").withColumn("full", F.coalesce(F.col("digest") == F.col("declared"), F.lit(False)))


def snapshot_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Files reused, changed, added and removed, next to what the pass believed."""
    _, files = counted_files(spark, d)
    n = freshness.refresh_counters(files, _changes(spark, d))
    runs = table(spark, d, "refresh_runs").where("repository is not null").groupBy("repository", F.col("snapshot_no").cast("int").alias("snapshot_no")).agg(F.max_by("changed", F.struct("finished_at", "run_id")).alias("believed_changed"))
    return n.join(runs, ["repository", "snapshot_no"], "left")


def move_candidates(spark: SparkSession, d: str) -> DataFrame:
    return freshness.move_candidates(counted_files(spark, d)[1])


def binding_freshness(spark: SparkSession, d: str) -> DataFrame:
    counted, files = counted_files(spark, d)
    return freshness.binding_freshness(table(spark, d, "knowledge_entries"), files, counted)


def pattern_impact(spark: SparkSession, d: str) -> DataFrame:
    return freshness.pattern_impact(table(spark, d, "knowledge_entries"), _changes(spark, d), counted_files(spark, d)[0])


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """One row per entry."""
    e = table(spark, d, "knowledge_entries").where("entry_id is not null")
    return e.groupBy("entry_id").agg(F.max("repository").alias("repository"), F.max("evidence").alias("evidence"), F.max("verified_at").alias("verified_at"))


def trust_signals(spark: SparkSession, d: str) -> DataFrame:
    """How each entry is vouched for, and whether that is too long ago."""
    trust = F.when(F.col("evidence").startswith("reviewed"), "human-reviewed").when(F.col("verified_at").isNotNull(), "machine-confirmed").otherwise("unverified")
    stale = F.col("verified_at").cast("timestamp") + F.expr(f"interval {STALE_DAYS} days") <= F.to_timestamp(F.lit(NOW))
    return _entries(spark, d).select("entry_id", trust.alias("trust"), F.coalesce(stale, F.lit(False)).alias("declared_stale"))


def bootstrap_state(spark: SparkSession, d: str) -> DataFrame:
    """Per repository: no, partial or mature knowledge."""
    repos = table(spark, d, "source_files").where("repository is not null").select("repository").distinct()
    n = _entries(spark, d).groupBy("repository").agg(F.count("*").alias("entries"))
    out = repos.join(n, "repository", "left").withColumn("entries", F.coalesce("entries", F.lit(0).cast("long")))
    return out.withColumn("state", F.when(F.col("entries") == 0, "no").when(F.col("entries") < MATURE, "partial").otherwise("mature"))


def latest_active(spark: SparkSession, d: str) -> DataFrame:
    """Of a record's lifetimes the last one is active while it isn't over; the others are superseded."""
    r = table(spark, d, "reader_records").where("repository is not null and record_id is not null and added_at is not null").select("repository", canonical(F.col("record_id")).alias("record_id"), "added_at", "removed_at").distinct()
    last = r.groupBy("repository", "record_id").agg(F.max("added_at").alias("last"))
    state = F.when(F.col("added_at") < F.col("last"), "superseded").when(F.col("removed_at").isNull(), "active").otherwise("removed")
    return r.join(last, ["repository", "record_id"]).groupBy(state.alias("state")).agg(F.count("*").alias("lifetimes"), F.count_distinct("repository", "record_id").alias("records"))


def outstanding_gates(spark: SparkSession, d: str) -> DataFrame:
    """Errors that no later purchase of the same user settles."""
    e = table(spark, d, "events").where("user_id is not null and ts is not null").select("event_id", "user_id", "ts", "event_type")
    closed = e.where(F.col("event_type") == CLOSES).groupBy("user_id").agg(F.max("ts").alias("closed"))
    return e.where(F.col("event_type") == OPENS).join(closed, "user_id", "left").where("closed is null or closed <= ts").select("event_id", "user_id")


def owner_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The first three distinct among the last 20 users of each kind of event; the 20 are taken in every task first."""
    e = table(spark, d, "events").where("user_id is not null and event_type is not null").select("event_type", "user_id", "ts", "event_id")
    recent = search.top(e, LAST, F.col("ts").desc(), F.col("event_id").desc(), by="event_type")
    first = recent.groupBy("event_type", "user_id").agg(F.min("position").alias("seen"))
    return search.top(first, OWNERS, "seen", by="event_type").select("event_type", "user_id", F.col("position").cast("long").alias("position"))


def trace_accounting(spark: SparkSession, d: str) -> DataFrame:
    """Per kind of event: how many, how many users, the sum of a measure that is null if any part of it is missing."""
    e = table(spark, d, "events").where("event_type is not null").withColumn("k", F.get_json_object("props", "$.k").try_cast("long"))
    return e.groupBy("event_type").agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"), F.sum(F.octet_length("props")).cast("long").alias("bytes"), F.when(F.count("*") == F.count("k"), F.sum("k")).alias("total"))


def overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Paths that several entries claim, themselves or through a path above or below."""
    s = freshness.entry_sources(table(spark, d, "knowledge_entries"))
    prefix = F.regexp_replace(F.regexp_extract("key", r"^([^*{]*)", 1), "/[^/]*$", "")
    path = F.when(F.col("key").contains("*") | F.col("key").contains("{"), prefix).otherwise(F.col("key"))
    return freshness.overlapping_owners(s.select("repository", path.alias("path"), F.col("entry_id").alias("owner")).where("path != ''")).where("owners + others > 1")


def uncovered_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of each repository that no entry names, and whether all are named."""
    files = table(spark, d, "source_files").where("repository is not null and path is not null").select("repository", canonical(F.col("path")).alias("path")).distinct()
    named = freshness.entry_sources(table(spark, d, "knowledge_entries")).select("repository", F.col("key").alias("path"), F.lit(1).alias("named")).distinct()
    return files.join(named, ["repository", "path"], "left").groupBy("repository").agg(F.count("*").alias("files"), F.count("named").alias("covered"), F.bool_and(F.col("named").isNotNull()).alias("complete"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (snapshot_digest, snapshot_refresh, move_candidates, binding_freshness, pattern_impact, trust_signals, bootstrap_state, latest_active, outstanding_gates, owner_candidates, trace_accounting, overlap_pairs, uncovered_files)}

_C = common.canon
_SOURCES = f"src AS (SELECT DISTINCT entry_id, repository, snapshot_no, verified_at, {_C('source')} AS key FROM (SELECT entry_id, repository, snapshot_no, verified_at, unnest(sources) AS source FROM knowledge_entries) WHERE source IS NOT NULL AND entry_id IS NOT NULL AND repository IS NOT NULL)"
_GLOBBED = "(contains(key, '*') OR contains(key, '{'))"
_ENTRIES = "e AS (SELECT entry_id, max(repository) AS repository, max(evidence) AS evidence, max(verified_at) AS verified_at FROM knowledge_entries WHERE entry_id IS NOT NULL GROUP BY 1)"
_LAST = "last AS (SELECT repository, max(snapshot_no) AS last_no FROM counted GROUP BY 1)"

ORACLE: dict[str, str] = {
    "snapshot_digest": f"WITH {COUNTED}, dec AS (SELECT repository, snapshot_no, delivery, max(lower(input_digest)) AS declared FROM snapshots WHERE repository IS NOT NULL GROUP BY 1, 2, 3) SELECT g.repository, g.snapshot_no, g.delivery, g.digest, d.declared, coalesce(g.digest = d.declared, false) AS \"full\" FROM digests g LEFT JOIN dec d USING (repository, snapshot_no, delivery) WHERE g.repository IS NOT NULL",
    "snapshot_refresh": f"""{CHANGES}, n AS (SELECT repository, snapshot_no, count(DISTINCT path) AS files FROM held WHERE idx > 1 GROUP BY 1, 2),
k AS (SELECT repository, snapshot_no, count(*) FILTER (change_kind = 'changed') AS changed, count(*) FILTER (change_kind = 'added') AS added, count(*) FILTER (change_kind = 'removed') AS removed FROM changes GROUP BY 1, 2),
r AS (SELECT repository, snapshot_no, arg_max(changed, (finished_at, run_id)) AS believed_changed FROM refresh_runs WHERE repository IS NOT NULL GROUP BY 1, 2)
SELECT repository, snapshot_no, coalesce(changed, 0) AS changed, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed, coalesce(files, 0) - coalesce(changed, 0) - coalesce(added, 0) AS reused, believed_changed
FROM n FULL JOIN k USING (repository, snapshot_no) LEFT JOIN r USING (repository, snapshot_no)""",
    "move_candidates": f"""{CHANGES}, gone AS (SELECT c.repository, c.snapshot_no, c.path, o.hash FROM changes c JOIN old o USING (repository, snapshot_no, path) WHERE change_kind = 'removed'),
n AS (SELECT g.repository, g.snapshot_no, g.path, count(w.path) AS candidates FROM gone g LEFT JOIN new w ON w.repository = g.repository AND w.snapshot_no = g.snapshot_no AND w.hash = g.hash GROUP BY 1, 2, 3)
SELECT *, CASE WHEN candidates = 1 THEN 'moved' WHEN candidates > 1 THEN 'ambiguous' ELSE 'missing' END AS state FROM n""",
    "binding_freshness": f"""WITH {COUNTED}, {_SOURCES}, {_LAST}, m AS (SELECT s.entry_id, s.verified_at, t.hash AS then_hash, n.hash AS now_hash FROM src s LEFT JOIN last l USING (repository)
LEFT JOIN held t ON t.repository = s.repository AND t.snapshot_no = s.snapshot_no AND t.path = s.key LEFT JOIN held n ON n.repository = s.repository AND n.snapshot_no = l.last_no AND n.path = s.key WHERE NOT {_GLOBBED.replace('key', 's.key')})
SELECT entry_id, CASE WHEN bool_or(now_hash IS NULL) THEN 'missing' WHEN max(verified_at) IS NULL THEN 'unverified' WHEN bool_or(now_hash IS DISTINCT FROM then_hash) THEN 'stale' ELSE 'fresh' END AS state FROM m GROUP BY 1""",
    "pattern_impact": f"""{CHANGES}, {_SOURCES}, {_LAST}, late AS (SELECT DISTINCT c.repository, c.path FROM changes c JOIN last l ON l.repository = c.repository AND l.last_no = c.snapshot_no)
SELECT s.entry_id, CASE WHEN bool_or(EXISTS (SELECT 1 FROM late h WHERE h.repository = s.repository AND (h.path = s.key OR ({_GLOBBED.replace('key', 's.key')} AND regexp_full_match(h.path, {GLOB}))))) THEN 'update' ELSE 'no-op' END AS outcome
FROM src s JOIN last l ON l.repository = s.repository GROUP BY 1""",
    "trust_signals": f"WITH {_ENTRIES} SELECT entry_id, CASE WHEN starts_with(evidence, 'reviewed') THEN 'human-reviewed' WHEN verified_at IS NOT NULL THEN 'machine-confirmed' ELSE 'unverified' END AS trust, coalesce(verified_at + INTERVAL {STALE_DAYS} DAY <= TIMESTAMP '{NOW}', false) AS declared_stale FROM e",
    "bootstrap_state": f"WITH {_ENTRIES}, r AS (SELECT DISTINCT repository FROM source_files WHERE repository IS NOT NULL), n AS (SELECT r.repository, count(e.entry_id) AS entries FROM r LEFT JOIN e USING (repository) GROUP BY 1) SELECT *, CASE WHEN entries = 0 THEN 'no' WHEN entries < {MATURE} THEN 'partial' ELSE 'mature' END AS state FROM n",
    "latest_active": f"""WITH r AS (SELECT DISTINCT repository, {_C('record_id')} AS record_id, added_at, removed_at FROM reader_records WHERE repository IS NOT NULL AND record_id IS NOT NULL AND added_at IS NOT NULL),
s AS (SELECT *, CASE WHEN added_at < max(added_at) OVER (PARTITION BY repository, record_id) THEN 'superseded' WHEN removed_at IS NULL THEN 'active' ELSE 'removed' END AS state FROM r) SELECT state, count(*) AS lifetimes, count(DISTINCT (repository, record_id)) AS records FROM s GROUP BY 1""",
    "outstanding_gates": f"SELECT event_id, user_id FROM events o WHERE event_type = '{OPENS}' AND user_id IS NOT NULL AND ts IS NOT NULL AND NOT EXISTS (SELECT 1 FROM events c WHERE c.event_type = '{CLOSES}' AND c.user_id = o.user_id AND c.ts > o.ts)",
    "owner_candidates": f"""WITH r AS (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL),
f AS (SELECT event_type, user_id, min(n) AS n FROM r WHERE n <= {LAST} GROUP BY 1, 2), p AS (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY n) AS position FROM f) SELECT * FROM p WHERE position <= {OWNERS}""",
    "trace_accounting": """WITH e AS (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type IS NOT NULL) SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users, sum(strlen(props))::BIGINT AS bytes, CASE WHEN count(*) = count(k) THEN sum(k)::BIGINT END AS total FROM e GROUP BY 1""",
    "overlap_pairs": f"""WITH {_SOURCES}, c AS (SELECT DISTINCT repository, CASE WHEN {_GLOBBED} THEN regexp_replace(regexp_extract(key, '^([^*{{]*)', 1), '/[^/]*$', '') ELSE key END AS path, entry_id AS owner FROM src), d AS (SELECT * FROM c WHERE path <> ''),
own AS (SELECT repository, path, count(*) AS owners FROM d GROUP BY 1, 2),
n AS (SELECT o.repository, o.path, any_value(o.owners) AS owners, count(DISTINCT d.owner) AS every FROM own o JOIN d ON d.repository = o.repository AND (d.path = o.path OR starts_with(d.path, o.path || '/') OR starts_with(o.path, d.path || '/')) GROUP BY 1, 2)
SELECT repository, path, owners, every - owners AS others FROM n WHERE every > 1""",
    "uncovered_files": f"""WITH {_SOURCES}, f AS (SELECT DISTINCT repository, {_C('path')} AS path FROM source_files WHERE repository IS NOT NULL AND path IS NOT NULL), m AS (SELECT f.*, EXISTS (SELECT 1 FROM src s WHERE s.repository = f.repository AND s.key = f.path) AS named FROM f)
SELECT repository, count(*) AS files, count(*) FILTER (named) AS covered, bool_and(named) AS complete FROM m GROUP BY 1""",
}
