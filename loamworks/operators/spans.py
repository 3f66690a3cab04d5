"""Lines and spans: regular expressions over lines, enclosing and overlapping definitions, changed ranges, byte budgets.

Spans meet lines by bins of ``BIN`` lines: every span is listed under each bin that it touches, so that the join is one of equal
keys and a long file is spread over many of them.

Defined results: null texts have no lines; spans whose end lies before their beginning are none; a line in no span has a null
symbol; of several enclosing spans the smallest counts, then the one that begins last, then the least name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines
from ..session import materialise

BIN = 64
#: Characters of a line that are searched and returned.
LINE_LIMIT = 1000


def file_lines(files: DataFrame, *keys: str) -> DataFrame:
    """(keys, line, text) of every line, counted from 1."""
    return files.where("text is not null").select(*keys, F.posexplode(lines(F.col("text"))).alias("line", "text")).withColumn("line", F.col("line") + 1)


def find_lines(files: DataFrame, pattern: str, *keys: str) -> DataFrame:
    """Lines that match, in any case; a line counts up to ``LINE_LIMIT`` characters."""
    cut = file_lines(files, *keys).withColumn("text", F.substring("text", 1, LINE_LIMIT))
    return cut.where(F.col("text").rlike(f"(?i){pattern}"))


def enclosing(rows: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (keys, line, ...) with the smallest of ``spans`` (keys, symbol, start_line, end_line) around the line."""
    binned = spans.where("end_line >= start_line").select(*keys, "symbol", "start_line", "end_line", F.explode(F.sequence(F.floor(F.col("start_line") / BIN), F.floor(F.col("end_line") / BIN))).alias("bin")).distinct()
    at = rows.select(*keys, "line").distinct().withColumn("bin", F.floor(F.col("line") / BIN))
    held = at.join(binned, [*keys, "bin"]).where("start_line <= line and end_line >= line")
    best = held.groupBy(*keys, "line").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("size"), (-F.col("start_line")).alias("late"), "symbol")).alias("s"))
    return rows.join(best.select(*keys, "line", F.col("s.symbol").alias("symbol")), [*keys, "line"], "left")


def overlapping(ranges: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """``ranges`` (keys, start, count) with every symbol they touch; ranges that touch none have a null symbol: a gap."""
    r = ranges.where("count > 0").withColumn("last", F.col("start") + F.col("count") - 1).select(*keys, "start", "count", "last").distinct()
    binned = spans.where("end_line >= start_line").select(*keys, "symbol", "start_line", "end_line", F.explode(F.sequence(F.floor(F.col("start_line") / BIN), F.floor(F.col("end_line") / BIN))).alias("bin"))
    at = r.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor(F.col("last") / BIN))))
    met = at.join(binned, [*keys, "bin"]).where("start_line <= last and end_line >= start").select(*keys, "start", "count", "symbol").distinct()
    return r.select(*keys, "start", "count").join(met, [*keys, "start", "count"], "left")


def runs_of_lines(hits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, count) of runs of neighbouring lines."""
    w = Window.partitionBy(*keys).orderBy("line")
    marked = hits.select(*keys, "line").distinct().withColumn("group", F.col("line") - F.row_number().over(w))
    return marked.groupBy(*keys, "group").agg(F.min("line").alias("start"), F.count("*").alias("count")).drop("group")


_HUNK = r"(?m)^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def changed_ranges(diffs: DataFrame) -> DataFrame:
    """(path, old_start, old_count, start, count) of the hunks of (path, diff); a count that isn't given is 1."""
    heads = F.regexp_extract_all("diff", F.lit(_HUNK), 0)
    one = lambda i, none: F.coalesce(F.regexp_extract("hunk", _HUNK, i).try_cast("int"), F.lit(none))
    return diffs.select("path", F.explode(heads).alias("hunk")).select("path", one(1, 0).alias("old_start"), one(2, 1).alias("old_count"), one(3, 0).alias("start"), one(4, 1).alias("count"))


def running_sum(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str = "total") -> DataFrame:
    """``rows`` with the sum of ``value`` up to and with each row of its key, by ``order``.

    Rows are range-partitioned by key and order, so that no task holds a whole key: the sums of the partitions are added up first, and
    each row adds what came before its own partition. ``order`` must be total, but for rows that are the same.
    """
    laid = materialise(rows.withColumn("_v", value).repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "runs")
    sums = laid.groupBy(*keys, "_part").agg(F.sum("_v").alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    here = F.sum("_v").over(Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = laid.withColumn("_here", here).alias("l").join(before.alias("b"), [F.col(f"l.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_part"]])
    return out.select(*(F.col(f"l.{c}").alias(c) for c in rows.columns), (F.col("_here") + F.col("_before")).alias(name))
