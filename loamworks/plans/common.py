"""Pieces that the queries and the SQL of several modules share."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ACCENTED, PLAIN

_CANON = r"regexp_replace(regexp_replace({0}, '[\\/]+', '/', 'g'), '^(\./)+', '')"


def wide(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with its int columns as long, as SQL counts them."""

    @wraps(query)
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = query(spark, d)
        return df.withColumns({c: F.col(c).cast("long") for c, k in df.dtypes if k == "int"})

    return run


def canon(x: str) -> str:
    """Canonical path."""
    return _CANON.format(x)


def dirname(x: str) -> str:
    return f"CASE WHEN contains({x}, '/') THEN regexp_replace({x}, '/[^/]*$', '') ELSE '' END"


def basename(x: str) -> str:
    return f"regexp_extract({x}, '([^/]*)$', 1)"


def fold(x: str) -> str:
    return f"translate({x}, '{ACCENTED}', '{PLAIN}')"


def tokens(x: str) -> str:
    return rf"regexp_extract_all({fold(f'lower({x})')}, '[\p{{L}}\p{{N}}_$]+')"


def lexical(x: str) -> str:
    ids = rf"array_to_string(regexp_extract_all({x}, '[A-Za-z_$][A-Za-z0-9_$]*'), ' ')"
    return rf"list_filter(string_split_regex(regexp_replace({ids}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_$\s]+'), lambda p: length(p) > 1)"


def windows(files: str) -> str:
    """CTE ``chunks`` (path, start_line, end_line, heading, body) over a relation with (path, text)."""
    return rf"""cut AS (SELECT path, string_split_regex(text, '\r?\n') AS l FROM {files} WHERE text IS NOT NULL),
win AS (SELECT path, s + 1 AS start_line, least(len(l), s + 100) AS end_line, l[s + 1:s + 100] AS ls FROM (SELECT path, l, unnest(range(0, len(l), 80)) AS s FROM cut)),
chunks AS (SELECT path, start_line, end_line, regexp_replace(list_filter(ls, lambda p: regexp_matches(p, '^#{{1,6}}\s'))[1], '^#+\s*', '') AS heading, array_to_string(ls, chr(10)) AS body
           FROM win WHERE regexp_matches(array_to_string(ls, chr(10)), '\S'))"""


def terms(queries: str) -> str:
    """CTE ``terms`` (query_id, term, position) over a relation with (query_id, query): the first 20 distinct terms."""
    return rf"""listed AS (SELECT query_id, regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}_$-]{{2,}}') AS t FROM {queries}),
placed AS (SELECT query_id, unnest(t) AS term, generate_subscripts(t, 1) AS i FROM listed),
terms AS (SELECT query_id, term, position FROM (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY min(i)) AS position FROM placed GROUP BY 1, 2) WHERE position <= 20)"""


def bm25(files: str, queries: str, symbols: str | None = None) -> str:
    """CTEs up to ``ranked`` (query_id, path, start_line, rank) and ``best`` (one row per query and path).

    ``symbols``: a query with (path, qualname, start_line, end_line), whose definitions are windows too.
    """
    fields = (("2.5", "path"), ("3.0", basename("path")), ("2.0", "symbol"), ("1.5", "heading"), ("1.0", f"body || chr(10) || array_to_string({lexical('body')}, ' ')"))
    parts = " UNION ALL ".join(f"SELECT id, {w} AS weight, {i} AS field, {tokens(x)} AS t FROM numbered" for i, (w, x) in enumerate(fields))
    defined = f"""
UNION ALL SELECT c.path, s.qualname, s.start_line, s.end_line, NULL, array_to_string(c.l[s.start_line:s.end_line], chr(10)) FROM cut c JOIN (SELECT DISTINCT * FROM ({symbols})) s USING (path) WHERE s.start_line >= 1 AND s.end_line >= s.start_line AND s.start_line <= len(c.l)""" if symbols else ""
    return rf"""{windows(files)},
{terms(queries)},
every AS (SELECT path, NULL::VARCHAR AS symbol, start_line, end_line, heading, body FROM chunks{defined}),
numbered AS (SELECT *, row_number() OVER () AS id FROM every),
fielded AS ({parts}),
sized AS (SELECT id, sum(coalesce(len(t), 0)) AS n_tokens FROM fielded GROUP BY 1),
lengths AS (SELECT n.id, n.path, n.start_line, n.end_line, n.symbol, s.n_tokens FROM numbered n JOIN sized s USING (id)),
stats AS (SELECT count(*)::DOUBLE AS n, avg(n_tokens) AS mean FROM lengths),
phr AS (SELECT DISTINCT query_id, array_to_string(ts, ' ') AS phrase, ts FROM (SELECT query_id, regexp_extract_all({fold("term")}, '[\p{{L}}\p{{N}}_$]+') AS ts FROM terms) WHERE len(ts) > 0),
need AS (SELECT DISTINCT phrase, len(ts) AS k, unnest(ts) AS token, generate_subscripts(ts, 1) AS part FROM phr),
post AS (SELECT id, weight, field, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM fielded),
met AS (SELECT phrase, id, weight, field, pos - part AS origin, k, count(DISTINCT part) AS found FROM post JOIN need USING (token) GROUP BY ALL),
hits AS (SELECT phrase, id, sum(weight) AS tf FROM met WHERE found = k GROUP BY ALL),
spread AS (SELECT phrase, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM hits, stats GROUP BY 1),
ranked AS (SELECT query_id, id, path, start_line, end_line, symbol, round(-sum(CASE WHEN raw <= 0 THEN 1e-6 ELSE raw END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_tokens / mean))), 6) AS rank
           FROM hits JOIN phr USING (phrase) JOIN spread USING (phrase) JOIN lengths USING (id), stats GROUP BY ALL),
best AS (SELECT query_id, path, start_line, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY rank, start_line, end_line, symbol NULLS FIRST) AS r FROM ranked) WHERE r = 1)"""
