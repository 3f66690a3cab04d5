"""Percentiles of very large numeric columns by deterministic rank-interval summaries.

A summary of ``n`` values is a sorted list of tuples ``(v, rmin, rmax)``: ``v`` is a value and its rank lies between
``rmin`` and ``rmax``. Each task summarises its rows by group, compresses to the tuples that the permitted uncertainty
needs, and summaries merge hierarchically: merging adds the rank intervals, compressing widens them by at most
``n / 2k``. The true error of every summary is read off its own tuples, so that it is tracked, not assumed.

Summaries are plain rows (group, n, v, rmin, rmax): those of separate files or days can be kept and combined later.

Defined results: null, NaN and negative values are "not measured" and left out; null group values form groups of
their own; a group without measured values gives no row; repeated rows of one id count once (the last recorded one,
ties by the greatest values, null being the greatest as in the SQL); empty tables give no rows; ties share one value.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import materialise, ship, small

#: Permitted rank error as a share of n, over all levels of merging.
EPSILON = 0.002
#: Summaries merged in one task; a group of any size is merged by levels of this many.
FAN_IN = 32
#: Values sorted at once when a task builds its summaries.
BUFFER = 1 << 16
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)

Summary = tuple[np.ndarray, np.ndarray, np.ndarray]


def exact_summary(values: np.ndarray) -> Summary:
    """Every value with its exact rank; of ties, the first and the last rank."""
    v = np.sort(values, kind="stable")
    rank = np.arange(1, len(v) + 1)
    edge = np.ones(len(v), bool)
    if len(v) > 2:
        edge[1:-1] = (v[1:-1] != v[:-2]) | (v[1:-1] != v[2:])
    return v[edge], rank[edge], rank[edge]


def merge(a: Summary, b: Summary) -> Summary:
    """Rank intervals of the union; of equal values those of ``a`` come first."""
    if not len(a[0]) or not len(b[0]):
        return a if len(a[0]) else b

    def moved(x: Summary, y: Summary, side: str) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(y[0], x[0], side=side)  # tuples of y that come before
        low = np.concatenate(([0], y[1]))[at]
        high = np.concatenate((y[2] - 1, [y[2][-1]]))[at]
        return x[1] + low, x[2] + high

    amin, amax = moved(a, b, "left")
    bmin, bmax = moved(b, a, "right")
    v = np.concatenate((a[0], b[0]))
    order = np.argsort(v, kind="stable")
    return v[order], np.concatenate((amin, bmin))[order], np.concatenate((amax, bmax))[order]


def compress(s: Summary, k: int) -> Summary:
    """At most ``k + 1`` tuples: for evenly spaced ranks the tuple whose interval lies closest; both ends stay."""
    v, rmin, rmax = s
    if len(v) <= k + 1:
        return s
    n = rmax[-1]
    target = 1 + (n - 1) * np.arange(k + 1) / k
    mid = np.maximum.accumulate((rmin + rmax) / 2)
    at = np.clip(np.searchsorted(mid, target), 1, len(v) - 1)
    at -= (target - mid[at - 1]) < (mid[at] - target)
    at[0], at[-1] = 0, len(v) - 1
    at = np.unique(at)
    return v[at], rmin[at], rmax[at]


def rank_error(s: Summary) -> float:
    """No rank is answered with a greater error than this: half the widest gap between neighbouring intervals."""
    v, rmin, rmax = s
    if len(v) < 2:
        return 0.0
    # Between two tuples of one value every rank has that value: no error.
    gap = np.where(v[1:] == v[:-1], 0, rmax[1:] - rmin[:-1])
    return float(max(gap.max(), (rmax - rmin).max()) // 2)


def quantile(s: Summary, q: float) -> float:
    """The value whose rank interval deviates least from rank ``ceil(q n)`` (at least 1)."""
    v, rmin, rmax = s
    r = max(1, math.ceil(q * int(rmax[-1])))
    # A run of one value covers all ranks between its first and its last tuple.
    first = np.searchsorted(v, v, side="left")
    last = np.searchsorted(v, v, side="right") - 1
    off = np.maximum(0, np.maximum(r - np.maximum(rmin[last], rmin), np.minimum(rmax[first], rmax) - r))
    return float(v[int(np.argmin(off))])


class _Builder:
    """Summarises a stream of values, a buffer at a time; summaries of equal weight are merged as in a binary counter."""

    def __init__(self, k: int) -> None:
        self.k, self.parts, self.size, self.levels = k, [], 0, {}

    def add(self, values: np.ndarray) -> None:
        self.parts.append(values)
        self.size += len(values)
        if self.size >= BUFFER:
            self._flush()

    def _flush(self) -> None:
        if not self.parts:
            return
        s, level = compress(exact_summary(np.concatenate(self.parts)), self.k), 0
        self.parts, self.size = [], 0
        while level in self.levels:
            s, level = compress(merge(self.levels.pop(level), s), self.k), level + 1
        self.levels[level] = s

    def result(self) -> Summary:
        self._flush()
        s = (np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64))
        for level in sorted(self.levels):
            s = merge(s, self.levels[level])
        return compress(s, self.k)


def _summary_row(key: tuple, s: Summary) -> tuple:
    return (*key, int(s[2][-1]), s[0].tolist(), s[1].tolist(), s[2].tolist())


def _build(keys: list[str], metrics: list[str], k: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        built: dict[tuple, _Builder] = {}
        for pdf in batches:
            for key, at in pdf.groupby(keys, dropna=False, sort=False).indices.items():
                key = tuple(None if x is None or x != x else x for x in (key if isinstance(key, tuple) else (key,)))
                for m in metrics:
                    values = pdf[m].to_numpy(float, na_value=np.nan)[at]
                    values = values[values >= 0]
                    if len(values):
                        if (m, *key) not in built:
                            built[m, *key] = _Builder(k)
                        built[m, *key].add(values)
        yield pd.DataFrame([_summary_row(key, b.result()) for key, b in built.items()], columns=["metric", *keys, "n", "v", "rmin", "rmax"])

    return run


class _Merger:
    """Merges a stream of summaries; those of like weight first, as in a binary counter, so that the depth is the logarithm."""

    def __init__(self, k: int) -> None:
        self.k, self.levels = k, {}

    def add(self, s: Summary) -> None:
        level = int(s[2][-1]).bit_length()
        while level in self.levels:
            s = compress(merge(self.levels.pop(level), s), self.k)
            level = int(s[2][-1]).bit_length()
        self.levels[level] = s

    def result(self) -> Summary:
        out = None
        for level in sorted(self.levels):
            out = self.levels[level] if out is None else merge(out, self.levels[level])
        return compress(out, self.k)


def _merged(n_keys: int, k: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One summary per run of equal keys of rows sorted by key; runs go on over the ends of batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, merger, done = None, None, []
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(n_keys)), strict=True))
            parts = [batch.column(n_keys + 1 + i) for i in range(3)]
            arrays = [(p.values.to_numpy(zero_copy_only=False), p.offsets.to_numpy()) for p in parts]
            for r, key in enumerate(keys):
                if key != now or merger is None:
                    if merger is not None:
                        done.append(_summary_row(now, merger.result()))
                    now, merger = key, _Merger(k)
                merger.add(tuple(v[o[r] : o[r + 1]] for v, o in arrays))
            if len(done) >= 256:
                yield _batch(done, schema)
                done = []
        if merger is not None:
            done.append(_summary_row(now, merger.result()))
        yield _batch(done, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _levels(parts: int) -> int:
    return max(1, math.ceil(math.log(max(parts, 2), FAN_IN)))


def tuples_for(epsilon: float, levels: int) -> int:
    """Tuples per summary so that building, its counter (at most 16 levels) and ``levels`` merges keep to ``epsilon``."""
    return math.ceil((levels + 17) / (2 * epsilon))


def _key_fields(df: DataFrame, keys: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in keys)


def summaries(df: DataFrame, keys: list[str], metrics: list[str], epsilon: float = EPSILON) -> DataFrame:
    """Rank-interval summaries of each task's rows by ``keys`` and metric: (metric, keys, n, v, rmin, rmax)."""
    ship(df.sparkSession)
    schema = f"metric string, {_key_fields(df, keys)}, n long, v array<double>, rmin array<long>, rmax array<long>"
    return df.select(*keys, *metrics).mapInPandas(_build(keys, metrics, tuples_for(epsilon, 8)), schema)


def combine(parts: DataFrame, keys: list[str], epsilon: float = EPSILON) -> DataFrame:
    """One summary per ``keys`` (metric included) out of any number of them.

    Rows are laid side by side by key and merged as a stream, so that many small groups cost no call each. If a group has more than
    ``FAN_IN`` summaries it is merged by levels, salted, and no task merges more than about that many of it. ``parts`` should be
    materialised: the largest group is counted to know the levels.
    """
    keys, k = list(keys), tuples_for(epsilon, 8)
    ship(parts.sparkSession)
    most = parts.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
    for level in range(_levels(most), 0, -1):
        at = keys if level == 1 else [*keys, "salt"]
        if level > 1:
            parts = parts.withColumn("salt", F.pmod(F.xxhash64("v", "n"), F.lit(FAN_IN ** (level - 1))).cast("long"))
        parts = parts.select(*at, "n", "v", "rmin", "rmax")
        schema = to_arrow_schema(parts.schema)
        parts = parts.repartition(*at).sortWithinPartitions(*at).mapInArrow(_merged(len(at), k, schema), parts.schema)
    return parts.select(*keys, "n", "v", "rmin", "rmax")


def _answers(quantiles: tuple[float, ...], keys: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                s = (np.asarray(r["v"], float), np.asarray(r["rmin"], np.int64), np.asarray(r["rmax"], np.int64))
                e = rank_error(s)
                out += [(*(r[c] for c in keys), q, quantile(s, q), r["n"], e, e / r["n"]) for q in quantiles]
            yield pd.DataFrame(out, columns=[*keys, "quantile", "value", "n_values", "rank_error", "error_share"])

    return run


def percentiles(merged: DataFrame, keys: list[str], quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(keys, quantile, value, n_values, rank_error, error_share) of each summary."""
    schema = f"{_key_fields(merged, keys)}, quantile double, value double, n_values long, rank_error double, error_share double"
    return merged.mapInPandas(_answers(quantiles, keys), schema)


def once(df: DataFrame, key: str, latest: str, columns: dict[str, Column]) -> DataFrame:
    """One row per ``key``: of repeated rows the one with the greatest ``latest``, then the greatest values in the order of ``columns``; null is the greatest."""
    fields = list(columns)
    order = [x for n, c in {"_latest": F.col(latest), **columns}.items() for x in (c.isNull().alias(f"_no_{n}"), c.alias(n))]
    picked = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*order)).alias("s"))
    return picked.select(*(F.col(f"s.{n}").alias(n) for n in fields))


def measured_percentiles(measurements: DataFrame, by_day: bool = False, epsilon: float = EPSILON, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Percentiles of duration_ms and tool_calls per arm and run_condition, or those of each day; days are combined from their summaries."""
    metrics, keys = ["duration_ms", "tool_calls"], ["metric", "arm", "run_condition"]
    rows = once(measurements, "run_id", "recorded_at", {"arm": F.col("arm"), "run_condition": F.col("run_condition"), **{m: F.col(m) for m in metrics}, "day": F.to_date("started_at")})
    parts = materialise(summaries(rows, [*(["day"] if by_day else []), "arm", "run_condition"], metrics, epsilon), "summaries")
    group = [*keys, "day"] if by_day else keys
    return percentiles(combine(parts, group, epsilon), group, quantiles)


def combined_days(measurements: DataFrame, epsilon: float = EPSILON, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """The percentiles of all days, out of the kept summaries of single days only."""
    keys = ["metric", "arm", "run_condition"]
    rows = once(measurements, "run_id", "recorded_at", {"arm": F.col("arm"), "run_condition": F.col("run_condition"), "duration_ms": F.col("duration_ms"), "tool_calls": F.col("tool_calls"), "day": F.to_date("started_at")})
    parts = materialise(summaries(rows, ["day", "arm", "run_condition"], ["duration_ms", "tool_calls"], epsilon), "summaries")
    days = materialise(combine(parts, [*keys, "day"], epsilon), "days")
    return percentiles(combine(days, keys, epsilon), keys, quantiles)


def bound_holds(measurements: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """(metric, arm, run_condition, quantile, n_values, within_bound): do exact ranks of the values of :func:`measured_percentiles` keep to
    the error that each of them states, and that to ``epsilon``? The values are few; every measured row is counted against its group's."""
    keys = ["metric", "arm", "run_condition"]
    found = materialise(measured_percentiles(measurements, epsilon=epsilon), "percentiles")
    rows = once(measurements, "run_id", "recorded_at", {"arm": F.col("arm"), "run_condition": F.col("run_condition"), "duration_ms": F.col("duration_ms"), "tool_calls": F.col("tool_calls")})
    each = rows.select("arm", "run_condition", F.explode(F.create_map(*(x for m in ("duration_ms", "tool_calls") for x in (F.lit(m), F.col(m).cast("double"))))).alias("metric", "x")).where("x >= 0 and not isnan(x)")
    counted = each.groupBy(*keys, "x").agg(F.count("*").alias("c")).alias("e")
    p = small(found, 100).alias("p")
    met = counted.join(p, [F.col(f"e.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys])
    sums = met.groupBy(*(F.col(f"p.{k}").alias(k) for k in [*keys, "quantile", "n_values", "rank_error"])).agg(F.sum(F.when(F.col("x") < F.col("value"), F.col("c")).otherwise(0)).alias("below"), F.sum(F.when(F.col("x") <= F.col("value"), F.col("c")).otherwise(0)).alias("upto"), F.sum("c").alias("n"))
    rank = F.greatest(F.lit(1.0), F.ceil(F.col("quantile") * F.col("n_values")))
    holds = (F.col("below") + 1 - F.col("rank_error") <= rank) & (F.col("upto") + F.col("rank_error") >= rank) & (F.col("n") == F.col("n_values")) & (F.col("rank_error") <= F.greatest(F.lit(1.0), epsilon * F.col("n_values")))
    return sums.select(*keys, "quantile", "n_values", holds.alias("within_bound"))
