"""Queries over files and lines: inventory, coverage, gates, regular expressions, hygiene, spans, budgets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.paths import basename, canonical, dirname, extension
from ..operators import search, spans
from ..sources.tables import table
from . import common

Query = Callable[[SparkSession, str], DataFrame]
PATTERN = r"\b(throw new|raise|panic)\b"
TODO = r"\b(TODO|workaround|careful)\b"
#: Bytes that a source's documents may take together, and one excerpt's lines and bytes.
BUDGET = 20_000
EXCERPT_LINES, EXCERPT_BYTES = 200, 1 << 10
KEYS = ["repository", "path"]

# Parts of paths that are passed over, names that hold credentials, extensions that are text or have a grammar.
EXCLUDED = ".git node_modules .venv venv dist build coverage .pytest_cache .ruff_cache __pycache__ .ssh .aws .azure .gnupg .terraform".split()
SENSITIVE = r"^(\.env|\.git-credentials|\.netrc|\.npmrc|\.pypirc|application_default_credentials\.json|credentials\.json|id_dsa|id_ed25519|id_rsa|id_ecdsa|\.env\..*|(credentials|secrets?)(\.[^/]*)?)$|\.(key|p12|pem|pfx|tfstate)$"
SOURCE = ".py .ts .js .go .java".split()
TEXTS = ".md .txt .json".split()
BYTE_LIMIT = 1 << 20


def source_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").where("repository is not null and path is not null").select("file_id", "repository", canonical(F.col("path")).alias("path"), F.col("body").alias("text"), "status")


def file_inventory(spark: SparkSession, d: str) -> DataFrame:
    return source_texts(spark, d).select("file_id", "repository", "path", extension(F.col("path")).alias("language"), F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("digest"))


def file_status_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per repository: files, those that are not available to searches, and whether it is complete."""
    status = F.coalesce("status", F.lit("unknown"))
    n = source_texts(spark, d).groupBy("repository").agg(F.count("*").alias("total"), *(F.count_if(status == s).alias(s) for s in ("parsed", "partial", "failed", "unsupported", "unknown")))
    out = n.withColumn("unavailable", F.col("partial") + F.col("failed") + F.col("unsupported"))
    return out.withColumn("complete", (F.col("unavailable") == 0) & (F.col("unknown") == 0))


def excluded(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    return F.arrays_overlap(parts, F.array(*map(F.lit, EXCLUDED))) | F.lower(basename(path)).rlike(SENSITIVE)


def path_gates(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each file of a scan: the first gate that keeps it out, or ``indexed``."""
    f, ext = source_texts(spark, d), extension(F.col("path"))
    gate = (
        F.when(excluded(F.col("path")), "excluded").when(~ext.isin(*SOURCE, *TEXTS), "unsupported").when(F.col("text").isNull(), "missing").when(F.octet_length("text") > BYTE_LIMIT, "too large")
        .when(F.instr("text", "\0") > 0, "binary").when(T.contains_secret(F.col("text")), "sensitive").otherwise("indexed")
    )
    return f.groupBy("repository", gate.alias("gate")).agg(F.count("*").alias("files"))


def dissection(spark: SparkSession, d: str) -> DataFrame:
    """Paths by what they look like: entry points, packages, tests, documents."""
    p = F.lower("path")
    flags = {"entry_points": p.rlike(r"(^|/)(main|index|app|cli|server)\.[a-z]+$"), "tests": p.rlike(r"(^|/)(tests?|__tests__|spec)/|[._](test|spec)\.[a-z]+$"), "documents": p.rlike(r"\.(md|mdx|txt)$"), "packages": p.rlike(r"(^|/)(package\.json|go\.mod|pyproject\.toml|cargo\.toml|pom\.xml|build\.gradle(\.kts)?)$")}
    return source_texts(spark, d).groupBy("repository").agg(*(F.count_if(c).alias(n) for n, c in flags.items()))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbols").where("repository is not null and path is not null and removed_at is null")
    return s.select("repository", canonical(F.col("path")).alias("path"), F.col("symbol_key").alias("symbol"), "start_line", "end_line").distinct()


@common.wide
def regex_find_all(spark: SparkSession, d: str) -> DataFrame:
    """Lines that match, the symbol around them, and how many distinct symbols call it."""
    hits = spans.enclosing(spans.find_lines(source_texts(spark, d), PATTERN, *KEYS), _spans(spark, d), KEYS)
    calls = table(spark, d, "call_edges").where("not (confidence <=> 'unresolved')").select("repository", F.col("target_key").alias("symbol"), "source_key").where("symbol is not null and source_key is not null").distinct()
    callers = calls.groupBy("repository", "symbol").agg(F.count("*").alias("callers"))
    return hits.join(callers, ["repository", "symbol"], "left").select("repository", "path", "line", "symbol", F.coalesce("callers", F.lit(0).cast("long")).alias("callers"), "text")


@common.wide
def match_groups(spark: SparkSession, d: str) -> DataFrame:
    """Matching lines by file and symbol."""
    hits = spans.enclosing(spans.find_lines(source_texts(spark, d), PATTERN, *KEYS), _spans(spark, d), KEYS)
    return hits.groupBy("repository", "path", "symbol").agg(F.count("*").alias("matches"), F.min("line").alias("first_line"), F.max("line").alias("last_line"))


@common.wide
def enclosing_span(spark: SparkSession, d: str) -> DataFrame:
    """The symbol around each line with a remark."""
    return spans.enclosing(spans.find_lines(source_texts(spark, d), TODO, *KEYS), _spans(spark, d), KEYS).select(*KEYS, "line", "symbol")


@common.wide
def diff_impact_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Runs of lines with remarks and the symbols they touch; null: module level."""
    ranges = spans.runs_of_lines(spans.find_lines(source_texts(spark, d), TODO, *KEYS), KEYS)
    return spans.overlapping(ranges, _spans(spark, d), KEYS).select(*KEYS, "start", F.col("count").alias("n_lines"), "symbol")


@common.wide
def hygiene_scan(spark: SparkSession, d: str) -> DataFrame:
    """The first line of each kind that should not be published, per document."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    kinds = {"email_line": F.col("text").rlike(T.EMAIL), "hex_line": F.col("text").rlike(T.HEX_TOKEN), "local_path_line": F.col("text").rlike(T.LOCAL_PATH), "secret_line": T.contains_secret(F.col("text"))}
    found = spans.file_lines(docs, "doc_id").groupBy("doc_id").agg(*(F.min(F.when(c, F.col("line"))).alias(n) for n, c in kinds.items()))
    return found.where(" or ".join(f"{n} is not null" for n in kinds))


def redact_text(spark: SparkSession, d: str) -> DataFrame:
    """Each text with its secrets taken out, as a digest."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(T.redact(F.concat(F.col("text"), F.lit("\npassword = 'correct-horse-"), F.col("doc_id").cast("string"), F.lit("'\ntoken: Bearer abcdefghijklmnop1234\n"))), 256).alias("digest"))


def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each source that fit into its byte budget, in order of their paths."""
    docs = table(spark, d, "documents").where("source is not null and text is not null").select("source", "path", "doc_id", F.octet_length("text").cast("long").alias("bytes"))
    return spans.running_sum(docs, ["source"], ["path", "doc_id"], F.col("bytes")).where(F.col("total") <= BUDGET).select("source", "doc_id", "total")


def excerpt_budget(spark: SparkSession, d: str) -> DataFrame:
    """How many lines of each file fit into an excerpt of so many lines and bytes."""
    size = F.transform(F.slice(T.lines(F.col("text")), 1, EXCERPT_LINES), lambda x: F.octet_length(x) + 1)
    step = F.aggregate(size, F.struct(F.lit(0).alias("kept"), F.lit(0).alias("bytes"), F.lit(True).alias("open")), lambda a, x: F.struct(F.when(a["open"] & (a["bytes"] + x <= EXCERPT_BYTES), a["kept"] + 1).otherwise(a["kept"]).alias("kept"), F.when(a["open"] & (a["bytes"] + x <= EXCERPT_BYTES), a["bytes"] + x).otherwise(a["bytes"]).alias("bytes"), (a["open"] & (a["bytes"] + x <= EXCERPT_BYTES)).alias("open")))
    return source_texts(spark, d).where("text is not null").select("file_id", step.alias("s")).select("file_id", F.col("s.kept").cast("long").alias("kept_lines"), F.col("s.bytes").cast("long").alias("kept_bytes"))


def directory_listing(spark: SparkSession, d: str) -> DataFrame:
    return source_texts(spark, d).groupBy("repository", dirname(F.col("path")).alias("directory")).agg(F.count_distinct("path").alias("files"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).cast("long").alias("bytes"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (file_inventory, file_status_coverage, path_gates, dissection, regex_find_all, match_groups, enclosing_span, diff_impact_overlap, hygiene_scan, redact_text, budget_prefix, excerpt_budget, directory_listing)}

_C = common.canon
_FILES = f"files AS (SELECT file_id, repository, {_C('path')} AS path, body AS text, status FROM source_files WHERE repository IS NOT NULL AND path IS NOT NULL)"
_EXT = r"lower(regexp_extract(path, '(\.[^./]+)$', 1))"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _secret(x: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {_quoted(p)})" for p, _ in T.SECRETS) + ")"


def _redacted(x: str) -> str:
    for p, r in T.SECRETS:
        x = f"regexp_replace({x}, {_quoted(p)}, {_quoted(r.replace('$1', '\\1').replace('$2', '\\2'))}, 'g')"
    return x


def _hits(pattern: str) -> str:
    return rf"""{_FILES}, cut AS (SELECT repository, path, unnest(l) AS text, generate_subscripts(l, 1) AS line FROM (SELECT repository, path, string_split_regex(text, '\r?\n') AS l FROM files WHERE text IS NOT NULL)),
hits AS (SELECT repository, path, line, substr(text, 1, 1000) AS text FROM cut WHERE regexp_matches(substr(text, 1, 1000), '(?i){pattern}')),
spans AS (SELECT DISTINCT repository, {_C("path")} AS path, symbol_key AS symbol, start_line, end_line FROM symbols WHERE removed_at IS NULL AND repository IS NOT NULL AND path IS NOT NULL AND end_line >= start_line)"""


_INSIDE = "inside AS (SELECT h.*, (SELECT s.symbol FROM spans s WHERE s.repository = h.repository AND s.path = h.path AND s.start_line <= h.line AND s.end_line >= h.line ORDER BY s.end_line - s.start_line, s.start_line DESC, s.symbol LIMIT 1) AS symbol FROM hits h)"
_GATE = f"""CASE WHEN list_has_any(string_split(lower(path), '/'), {EXCLUDED}) OR regexp_matches(lower({common.basename("path")}), {_quoted(SENSITIVE)}) THEN 'excluded' WHEN {_EXT} NOT IN ({", ".join(map(_quoted, SOURCE + TEXTS))}) THEN 'unsupported'
WHEN text IS NULL THEN 'missing' WHEN strlen(text) > {BYTE_LIMIT} THEN 'too large' WHEN contains(text, chr(0)) THEN 'binary' WHEN {_secret("text")} THEN 'sensitive' ELSE 'indexed' END"""

ORACLE: dict[str, str] = {
    "file_inventory": f"WITH {_FILES} SELECT file_id, repository, path, {_EXT} AS language, strlen(text) AS bytes, sha256(text) AS digest FROM files",
    "file_status_coverage": f"""WITH {_FILES}, n AS (SELECT repository, count(*) AS total, count(*) FILTER (status = 'parsed') AS parsed, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'failed') AS failed,
count(*) FILTER (status = 'unsupported') AS unsupported, count(*) FILTER (status IS NULL OR status = 'unknown') AS "unknown" FROM files GROUP BY 1)
SELECT *, partial + failed + unsupported AS unavailable, partial + failed + unsupported = 0 AND "unknown" = 0 AS complete FROM n""",
    "path_gates": f"WITH {_FILES} SELECT repository, {_GATE} AS gate, count(*) AS files FROM files GROUP BY 1, 2",
    "dissection": rf"""WITH {_FILES}, p AS (SELECT repository, lower(path) AS path FROM files)
SELECT repository, count(*) FILTER (regexp_matches(path, '(^|/)(main|index|app|cli|server)\.[a-z]+$')) AS entry_points, count(*) FILTER (regexp_matches(path, '(^|/)(tests?|__tests__|spec)/|[._](test|spec)\.[a-z]+$')) AS tests,
count(*) FILTER (regexp_matches(path, '\.(md|mdx|txt)$')) AS documents, count(*) FILTER (regexp_matches(path, '(^|/)(package\.json|go\.mod|pyproject\.toml|cargo\.toml|pom\.xml|build\.gradle(\.kts)?)$')) AS packages FROM p GROUP BY 1""",
    "regex_find_all": f"""WITH {_hits(PATTERN)}, {_INSIDE}
SELECT i.repository, i.path, i.line, i.symbol, (SELECT count(DISTINCT source_key) FROM call_edges c WHERE c.repository = i.repository AND c.target_key = i.symbol AND c.confidence IS DISTINCT FROM 'unresolved') AS callers, i.text FROM inside i""",
    "match_groups": f"WITH {_hits(PATTERN)}, {_INSIDE} SELECT repository, path, symbol, count(*) AS matches, min(line) AS first_line, max(line) AS last_line FROM inside GROUP BY 1, 2, 3",
    "enclosing_span": f"WITH {_hits(TODO)}, {_INSIDE} SELECT repository, path, line, symbol FROM inside",
    "diff_impact_overlap": f"""WITH {_hits(TODO)}, r AS (SELECT repository, path, min(line) AS start, count(*) AS n_lines FROM (SELECT *, line - row_number() OVER (PARTITION BY repository, path ORDER BY line) AS g FROM (SELECT DISTINCT repository, path, line FROM hits)) GROUP BY repository, path, g)
SELECT DISTINCT r.repository, r.path, r.start, r.n_lines, s.symbol FROM r LEFT JOIN spans s ON s.repository = r.repository AND s.path = r.path AND s.start_line <= r.start + r.n_lines - 1 AND s.end_line >= r.start""",
    "hygiene_scan": rf"""WITH cut AS (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) AS line FROM (SELECT doc_id, string_split_regex(text, '\r?\n') AS l FROM documents WHERE text IS NOT NULL)),
n AS (SELECT doc_id, min(line) FILTER (regexp_matches(text, {_quoted(T.EMAIL)})) AS email_line, min(line) FILTER (regexp_matches(text, {_quoted(T.HEX_TOKEN)})) AS hex_line, min(line) FILTER (regexp_matches(text, {_quoted(T.LOCAL_PATH)})) AS local_path_line,
min(line) FILTER ({_secret("text")}) AS secret_line FROM cut GROUP BY 1) SELECT * FROM n WHERE coalesce(email_line, hex_line, local_path_line, secret_line) IS NOT NULL""",
    "redact_text": f"""SELECT doc_id, sha256({_redacted("text || chr(10) || 'password = ''correct-horse-' || doc_id || '''' || chr(10) || 'token: Bearer abcdefghijklmnop1234' || chr(10)")}) AS digest FROM documents WHERE text IS NOT NULL""",
    "budget_prefix": f"SELECT source, doc_id, total::BIGINT AS total FROM (SELECT source, doc_id, sum(strlen(text)) OVER (PARTITION BY source ORDER BY path, doc_id ROWS UNBOUNDED PRECEDING) AS total FROM documents WHERE source IS NOT NULL AND text IS NOT NULL) WHERE total <= {BUDGET}",
    "excerpt_budget": rf"""WITH {_FILES}, cut AS (SELECT file_id, unnest(l) AS text, generate_subscripts(l, 1) AS line FROM (SELECT file_id, string_split_regex(text, '\r?\n')[1:{EXCERPT_LINES}] AS l FROM files WHERE text IS NOT NULL)),
s AS (SELECT file_id, line, sum(strlen(text) + 1) OVER (PARTITION BY file_id ORDER BY line) AS total FROM cut)
SELECT file_id, count(*) FILTER (total <= {EXCERPT_BYTES}) AS kept_lines, coalesce(max(total) FILTER (total <= {EXCERPT_BYTES}), 0)::BIGINT AS kept_bytes FROM s GROUP BY 1""",
    "directory_listing": f"WITH {_FILES} SELECT repository, {common.dirname('path')} AS directory, count(DISTINCT path) AS files, sum(coalesce(strlen(text), 0))::BIGINT AS bytes FROM files GROUP BY 1, 2",
}
