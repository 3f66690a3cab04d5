"""Queries of the general training-data problems: orphan references and snapshot changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import orphans, snapshots
from ..sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
ORPHAN_TABLES = ("call_edges", "symbols", "reader_relationships", "reader_records", "knowledge_entries", "file_rows", "snapshots")


def _orphan_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {t: table(spark, d, t) for t in ORPHAN_TABLES}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The direct orphans: what the cascade, run to its fixpoint, has in round 0."""
    return orphans.orphan_references(_orphan_tables(spark, d)).where("round = 0").select(*orphans.REFERENCE).distinct()


def p1_cascade(spark: SparkSession, d: str) -> DataFrame:
    found = orphans.orphan_references(_orphan_tables(spark, d))
    return found.groupBy(*orphans.REFERENCE).agg(F.min("round").cast("long").alias("round"), F.when(F.min("round") == 0, "direct").otherwise("inherited").alias("orphan_kind"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(orphans.orphan_references(_orphan_tables(spark, d)))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, d, "file_rows"), table(spark, d, "snapshots"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Changes per repository and snapshot."""
    return p2_found(spark, d).groupBy("repository", "snapshot_no").agg(*(F.count_if(F.col("change_kind") == k).alias(k) for k in ("added", "changed", "removed")))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_cascade, p1_report, p2_found, p2_report)}

_CANON = r"regexp_replace(regexp_replace({0}, '[\\/]+', '/', 'g'), '^(\./)+', '')"


def _canon(x: str) -> str:
    return _CANON.format(x)


def _key(x: str) -> str:
    return f"{_canon(f"split_part({x}, '::', 1)")} || substr({x}, length(split_part({x}, '::', 1)) + 1)"


COUNTED = f"""
lines AS (SELECT DISTINCT repository, snapshot_no, delivery, {_canon("path")} AS path, lower(content_hash) AS hash FROM file_rows
          WHERE path IS NOT NULL AND content_hash IS NOT NULL),
digests AS (SELECT repository, snapshot_no, delivery, sha256(string_agg(path || chr(0) || hash, chr(10) ORDER BY path || chr(0) || hash)) AS digest
            FROM lines GROUP BY ALL),
counted AS (SELECT s.repository, s.snapshot_no, max(s.delivery) AS delivery,
                   row_number() OVER (PARTITION BY s.repository ORDER BY s.snapshot_no) AS idx
            FROM snapshots s LEFT JOIN digests g USING (repository, snapshot_no, delivery)
            WHERE coalesce(g.digest, '{snapshots.EMPTY_DIGEST}') = lower(s.input_digest) GROUP BY 1, 2),
held AS (SELECT c.repository, c.snapshot_no, c.idx, l.path, max(l.hash) AS hash FROM counted c JOIN lines l USING (repository, snapshot_no, delivery) GROUP BY ALL)
"""

CHANGES = f"""
WITH {COUNTED},
pairs AS (SELECT b.repository, b.snapshot_no, a.snapshot_no AS before_no FROM counted b JOIN counted a ON a.repository = b.repository AND a.idx = b.idx - 1),
old AS (SELECT p.repository, p.snapshot_no, h.path, h.hash FROM pairs p JOIN held h ON h.repository = p.repository AND h.snapshot_no = p.before_no),
new AS (SELECT p.repository, p.snapshot_no, h.path, h.hash FROM pairs p JOIN held h ON h.repository = p.repository AND h.snapshot_no = p.snapshot_no),
changes AS (SELECT repository, snapshot_no, path,
                   CASE WHEN old.hash IS NULL THEN 'added' WHEN new.hash IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
            FROM old FULL JOIN new USING (repository, snapshot_no, path) WHERE old.hash IS DISTINCT FROM new.hash)
"""

# A pattern becomes an expression step by step; the marks \x01-\x04 stand for what was read already.
GLOB = "s.key"
for _old, _new in (
    (r"([.+^$()|\[\]\\?])", r"\\\1"), (r"^\*\*$", "\x02"), (r"/\*\*$", "/\x02"), (r"(^|/)\*\*/", "\\1\x01"), (r"(^|/)\*\*/", "\\1\x01"), (r"\*+", "\x03"),
    ("\x01", r"(?:[^/]+/)*"), ("\x02", r"[^/]+(?:/[^/]+)*"), ("\x03", r"[^/]*"), (r"\{", "(?:"), (r"\}", ")"), (",", "|"),
):
    GLOB = f"regexp_replace({GLOB}, '{_old}', '{_new}', 'g')"

_DIRECT = f"""
WITH {COUNTED},
lives AS (SELECT DISTINCT repository, {_key("symbol_key")} AS key, added_at, removed_at FROM symbols),
records AS (SELECT DISTINCT repository, {_canon("record_id")} AS key, added_at, removed_at FROM reader_records),
edges AS (SELECT DISTINCT edge_id, target_key, captured_at, repository AS own, {_key("target_key")} AS own_key,
                 split_part(target_key, '::', 1) AS other, substr(target_key, length(split_part(target_key, '::', 1)) + 3) AS rest
          FROM call_edges WHERE target_key IS NOT NULL AND confidence IS DISTINCT FROM 'unresolved'),
relations AS (SELECT DISTINCT relation_id, target_id, captured_at, repository, {_canon("split_part(target_id, '#', 1)")} AS key FROM reader_relationships WHERE target_id IS NOT NULL),
sources AS (SELECT *, {_canon("source")} AS key FROM (SELECT DISTINCT entry_id, repository, snapshot_no, registered_at, unnest(sources) AS source FROM knowledge_entries) WHERE source IS NOT NULL),
found AS (
SELECT 'call_edges' AS ref_table, edge_id AS ref_id, target_key AS ref_key, captured_at AS seen_at FROM edges e
WHERE NOT EXISTS (SELECT 1 FROM lives l WHERE l.repository = e.own AND l.key = e.own_key AND e.captured_at >= l.added_at AND (l.removed_at IS NULL OR e.captured_at < l.removed_at))
  AND NOT EXISTS (SELECT 1 FROM lives l WHERE contains(e.rest, '::') AND l.repository = e.other AND l.key = {_key("e.rest")}
                  AND e.captured_at >= l.added_at AND (l.removed_at IS NULL OR e.captured_at < l.removed_at))
UNION
SELECT 'reader_relationships', relation_id, target_id, captured_at FROM relations r
WHERE NOT EXISTS (SELECT 1 FROM records l WHERE l.repository = r.repository AND l.key = r.key AND r.captured_at >= l.added_at AND (l.removed_at IS NULL OR r.captured_at < l.removed_at))
UNION
SELECT 'knowledge_entries', entry_id, source, registered_at FROM sources s
WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.repository = s.repository AND h.snapshot_no = s.snapshot_no AND h.path = s.key)
  AND NOT EXISTS (SELECT 1 FROM held h WHERE h.repository = s.repository AND h.snapshot_no = s.snapshot_no
                  AND (contains(s.key, '*') OR contains(s.key, '{{')) AND regexp_full_match(h.path, {GLOB})))
"""

_CASCADE = f"""{_DIRECT.replace("WITH ", "WITH RECURSIVE ", 1)},
refs AS (
SELECT 'call_edges' AS ref_table, edge_id AS ref_id, target_key AS ref_key, captured_at AS seen_at, 'symbol' || chr(0) || repository || chr(0) || {_key("source_key")} AS holder,
       'symbol' || chr(0) || repository || chr(0) || {_key("target_key")} AS target FROM call_edges WHERE target_key IS NOT NULL AND confidence IS DISTINCT FROM 'unresolved'
UNION SELECT 'call_edges', edge_id, target_key, captured_at, 'symbol' || chr(0) || repository || chr(0) || {_key("source_key")},
       'symbol' || chr(0) || split_part(target_key, '::', 1) || chr(0) || {_key("substr(target_key, length(split_part(target_key, '::', 1)) + 3)")}
      FROM call_edges WHERE confidence IS DISTINCT FROM 'unresolved' AND contains(substr(target_key, length(split_part(target_key, '::', 1)) + 3), '::')
UNION SELECT 'reader_relationships', relation_id, target_id, captured_at, 'record' || chr(0) || repository || chr(0) || {_canon("split_part(source_id, '#', 1)")},
       'record' || chr(0) || repository || chr(0) || {_canon("split_part(target_id, '#', 1)")} FROM reader_relationships WHERE target_id IS NOT NULL
UNION SELECT 'knowledge_entries', entry_id, source, registered_at, 'record' || chr(0) || repository || chr(0) || {_canon("path")}, NULL
      FROM (SELECT entry_id, repository, path, registered_at, unnest(sources) AS source FROM knowledge_entries) WHERE source IS NOT NULL),
links AS (SELECT DISTINCT r.target, r.holder FROM refs r ANTI JOIN found f USING (ref_table, ref_id, ref_key) WHERE r.target IS NOT NULL AND r.holder IS NOT NULL),
walk(holder, round) USING KEY (holder) AS (SELECT DISTINCT r.holder, 1 AS round FROM refs r SEMI JOIN found f USING (ref_table, ref_id, ref_key) WHERE r.holder IS NOT NULL
         UNION SELECT DISTINCT l.holder, w.round + 1 FROM walk w JOIN links l ON l.target = w.holder WHERE NOT EXISTS (SELECT 1 FROM recurring.walk r WHERE r.holder = l.holder)),
reached AS (SELECT holder, min(round) AS round FROM walk GROUP BY 1),
orphans AS (SELECT ref_table, ref_id, ref_key, seen_at, 0 AS round FROM found
            UNION ALL SELECT r.ref_table, r.ref_id, r.ref_key, r.seen_at, min(w.round) FROM refs r ANTI JOIN found f USING (ref_table, ref_id, ref_key) JOIN reached w ON w.holder = r.target GROUP BY ALL)
"""

ORACLE: dict[str, str] = {
    "p1_found": f"{_DIRECT} SELECT DISTINCT ref_table, ref_id, ref_key FROM found",
    "p1_cascade": f"{_CASCADE} SELECT ref_table, ref_id, ref_key, CAST(min(round) AS BIGINT) AS round, CASE WHEN min(round) = 0 THEN 'direct' ELSE 'inherited' END AS orphan_kind FROM orphans GROUP BY 1, 2, 3",
    "p1_report": f"{_CASCADE} SELECT ref_table, strftime(seen_at, '%Y-%m') AS month, count(*) FILTER (round = 0) AS direct, count(*) FILTER (round > 0) AS inherited, count(DISTINCT CASE WHEN round = 0 THEN ref_key END) AS missing_keys FROM orphans GROUP BY 1, 2",
    "p2_found": f"{CHANGES} SELECT repository, snapshot_no, path, change_kind FROM changes",
    "p2_report": f"{CHANGES} SELECT repository, snapshot_no, count(*) FILTER (change_kind = 'added') AS added, count(*) FILTER (change_kind = 'changed') AS changed, count(*) FILTER (change_kind = 'removed') AS removed FROM changes GROUP BY 1, 2",
}
