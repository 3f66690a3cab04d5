"""Source files that don't parse in the language of their extension, where they fail, and why.

Defined results: other extensions are no cases; an empty or null body is one only for ``.json``; extensions count in any case;
nulls in other columns don't matter; a repeated row is flagged and counted again; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import extension
from ..session import ship
from .grammars import PARSERS, parser

#: Causes, the first that holds: an unresolved merge, a body of another language, an end inside an open construct, then what
#: the furthest failure is: no token, brackets that don't pair, no statement, an indent.
CAUSES = ("empty", "merge conflict", "wrong extension", "truncated", "token", "bracket", "statement", "indent")
_CONFLICT = re.compile(r"^<{7}(?: [^\n]*)?\n(.*?)^={7}(?: [^\n]*)?\r?\n(?:.*?)^>{7}(?: [^\n]*)?(?:\n|\Z)", re.M | re.S)
_MARKER = re.compile(r"(?:<{7}|={7}|>{7}|\|{7})(?:[ \r\n]|\Z)")


def is_case(ext: str, body: str | None) -> bool:
    if not body:
        return ext == ".json"
    return not parser(ext).valid(body)


def failure(ext: str, body: str | None) -> tuple[int, int, str]:
    """(offset, line, cause) of a body that is a case; offsets count code points from 0, lines from 1."""
    if not body:
        return 0, 1, "empty"
    at, kind = parser(ext).failure(body)
    line = body.count("\n", 0, at) + 1
    begin = body.rfind("\n", 0, at) + 1
    ours = _CONFLICT.sub(lambda m: m[1], body)
    if _MARKER.match(body, begin) or (ours != body and parser(ext).valid(ours)):
        cause = "merge conflict"
    elif any(other != ext and parser(other).valid(body) for other in PARSERS):
        cause = "wrong extension"
    elif kind == "open bracket" or at >= len(body.rstrip()):
        cause = "truncated"
    else:
        cause = {"inside of bracket": "statement", "suite": "indent"}.get(kind, kind)
    return at, line, cause


def _cases(source_files: DataFrame, *columns: str) -> DataFrame:
    """``columns``, the extension and the body of every file in a language that has a grammar."""
    ship(source_files.sparkSession)
    return source_files.select(*columns, extension(F.col("path")).alias("ext"), "body").where(F.col("ext").isin(*PARSERS))


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, exts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        found = [i for i, e, b in zip(ids, exts, batch.column(2), strict=True) if is_case(e, b.as_py())]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["file_id"])


def unparsable(source_files: DataFrame) -> DataFrame:
    """(file_id) of every file that its grammar doesn't consume to the end; one pass, no shuffle."""
    return _cases(source_files.withColumn("file_id", F.col("file_id").cast("long")), "file_id").mapInArrow(_flag, "file_id long")


_FAILED = pa.schema([("file_id", pa.int64()), ("repository", pa.string()), ("status", pa.string()), ("language", pa.string()), ("fail_offset", pa.int64()), ("fail_line", pa.int64()), ("cause", pa.string())])


def _failures(every: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for *kept, body in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                body = body.as_py()
                if is_case(kept[3], body):
                    out.append((*kept, *failure(kept[3], body)))
                elif every:
                    out.append((*kept, None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 7, _FAILED, strict=True)], schema=_FAILED)

    return run


_FAILED_DDL = "file_id long, repository string, status string, language string, fail_offset long, fail_line long, cause string"


def failures(source_files: DataFrame, every: bool = False) -> DataFrame:
    """(file_id, repository, status, language, fail_offset, fail_line, cause) of every case, or of every file, then with nulls for those that parse."""
    files = source_files.select(F.col("file_id").cast("long").alias("file_id"), "repository", "status", "path", "body")
    return _cases(files, "file_id", "repository", "status").mapInArrow(_failures(every), _FAILED_DDL)


def unparsable_rates(source_files: DataFrame, refresh_runs: DataFrame) -> DataFrame:
    """Per repository and language: files, files that don't parse and their causes, files recorded as failed, and the last refresh run's failed.

    The files are read once; the columns to group by go through the parsing.
    """
    causes = [F.count_if(F.col("cause") == c).alias(c.replace(" ", "_")) for c in CAUSES]
    rates = failures(source_files, every=True).groupBy("repository", "language").agg(F.count("*").alias("files"), F.count("cause").alias("unparsable"), *causes, F.count_if(F.col("status") == "failed").alias("recorded_failed"))
    last = refresh_runs.where("repository is not null").groupBy("repository").agg(F.max_by("failed", "finished_at").alias("run_failed"))
    return rates.join(last, "repository", "left").withColumn("rate", F.col("unparsable") / F.col("files"))
