"""Queries of the language-model problems and the SQL that some of them must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import invalid, leakage, quantiles, sentences, tokens, vendored

Query = Callable[[SparkSession, str], DataFrame]


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.measured_percentiles(table(spark, d, "measurements"))


def p3_days(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.measured_percentiles(table(spark, d, "measurements"), by_day=True)


def p3_combined_days(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.combined_days(table(spark, d, "measurements"))


def p3_bound(spark: SparkSession, d: str) -> DataFrame:
    """Is the stated error kept?"""
    return quantiles.bound_holds(table(spark, d, "measurements"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return vendored.not_by_hand(table(spark, d, "source_files"), table(spark, d, "upstream_files")).select("file_id")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Files per repository and reason."""
    found = vendored.not_by_hand(table(spark, d, "source_files"), table(spark, d, "upstream_files"))
    return found.groupBy("repository", "reason").agg(F.count("*").alias("files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return invalid.unparsable(table(spark, d, "source_files"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return invalid.unparsable_rates(table(spark, d, "source_files"), table(spark, d, "refresh_runs"))


def p5_failures(spark: SparkSession, d: str) -> DataFrame:
    """Place and cause of each failure."""
    return invalid.failures(table(spark, d, "source_files")).drop("status")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(table(spark, d, "documents"))


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """Texts and tokens per source."""
    return tokens.token_counts(table(spark, d, "documents"), ["source"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items")
    return leakage.leakage_report(leakage.leaked(table(spark, d, "documents"), items), items)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p3_percentiles, p3_days, p3_combined_days, p3_bound, p4_found, p4_report, p5_found, p5_failures, p5_report, p6_ids, p6_counts, p7_found, p7_report, p8_found)}
_SHARES = ", ".join(f"({q}::DOUBLE)" for q in quantiles.QUANTILES)
_WINDOWS = r"""d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, split_part(replace(lower(coalesce(lang, '')), '_', '-'), '-', 1) IN ('zh', 'ja') AS by_char, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE passage IS NOT NULL),
dw AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
iw AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE NOT by_char)),
ic AS (SELECT DISTINCT item_id, substr(s, k, 20) AS g FROM (SELECT item_id, s, unnest(range(1, length(s) - 18)) AS k FROM (SELECT item_id, array_to_string(w, '') AS s FROM i WHERE by_char))),
dc AS (SELECT DISTINCT doc_id, substr(s, k, 20) AS g FROM (SELECT doc_id, s, unnest(range(1, length(s) - 18)) AS k FROM (SELECT doc_id, array_to_string(w, '') AS s FROM d))),
found AS (SELECT doc_id, item_id FROM dw JOIN iw USING (g) UNION SELECT doc_id, item_id FROM dc JOIN ic USING (g))"""
ORACLE: dict[str, str] = {
    "p7_found": f"WITH {_WINDOWS} SELECT doc_id, item_id FROM found",
    "p7_report": f"WITH {_WINDOWS} SELECT e.item_id, e.task, e.lang, count(f.doc_id) AS documents FROM (SELECT DISTINCT item_id, task, lang FROM eval_items) e LEFT JOIN found f USING (item_id) GROUP BY 1, 2, 3",
    # Exact ranks: the bound is kept, or the rows differ.
    "p3_bound": f"""WITH one AS (SELECT s[2] AS arm, s[3] AS run_condition, s[4] AS duration_ms, s[5] AS tool_calls FROM (SELECT max((recorded_at, arm, run_condition, duration_ms, tool_calls)) AS s FROM measurements WHERE run_id IS NOT NULL GROUP BY run_id)),
m AS (SELECT 'duration_ms' AS metric, arm, run_condition, duration_ms AS x FROM one UNION ALL SELECT 'tool_calls', arm, run_condition, tool_calls FROM one),
n AS (SELECT metric, arm, run_condition, count(*) AS n_values FROM m WHERE x >= 0 GROUP BY 1, 2, 3)
SELECT metric, arm, run_condition, q AS quantile, n_values, true AS within_bound FROM n, (VALUES {_SHARES}) v(q)""",
}
