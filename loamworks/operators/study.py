"""Paired trials: schedules, missing trials, reductions per task, bootstrap intervals, ranks.

Defined results: a run_id is one measurement, of repeated ones the last recorded counts; of several measurements of one trial the
one with the least run_id; unmeasured costs (null or negative) leave a trial out of the comparison of costs; tasks without a pair give
no row; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .spans import running_sum

# Resamples and the places of the bounds among them.
RESAMPLES, LOWER, UPPER = 2_000, 49, 1_949
TRIAL = ["task", "trial", "arm", "run_condition"]
#: Distinct arms and conditions that a plan may have.
MOST_ARMS = 1_000


def trials(measurements: DataFrame) -> DataFrame:
    """One measurement per (task, trial, arm, run_condition)."""
    cost = sum((F.when(F.col(c) >= 0, F.col(c)) for c in ("setup_ms", "refresh_ms", "enrichment_ms")), F.when(F.col("duration_ms") >= 0, F.col("duration_ms")))
    rows = measurements.where("run_id is not null").groupBy("run_id").agg(F.max(F.struct("recorded_at", *TRIAL, "correct", "context_bytes", cost.alias("cost"))).alias("s")).select("run_id", "s.*")
    complete = " and ".join(f"{c} is not null" for c in TRIAL)
    return rows.where(complete).groupBy(*TRIAL).agg(F.min(F.struct("run_id", "correct", "context_bytes", "cost")).alias("s")).select(*TRIAL, "s.*")


def schedule(measurements: DataFrame) -> DataFrame:
    """Every trial that the study plans: each task with each of its trials, each arm and each condition."""
    values = lambda c: sorted(r[0] for r in measurements.where(F.col(c).isNotNull()).select(c).distinct().limit(MOST_ARMS + 1).collect())
    arms, conditions = values("arm"), values("run_condition")
    if max(len(arms), len(conditions)) > MOST_ARMS:
        raise ValueError("a study has at most a thousand arms and conditions")
    texts = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    last = measurements.where("task is not null and trial >= 1").groupBy("task").agg(F.max("trial").alias("trials"))
    return last.select("task", F.explode(F.sequence(F.lit(1), "trials")).alias("trial")).withColumn("arm", F.explode(texts(arms))).withColumn("run_condition", F.explode(texts(conditions)))


def missing_trials(measurements: DataFrame) -> DataFrame:
    done = measurements.select(*TRIAL).distinct()
    return schedule(measurements).join(done, TRIAL, "left_anti")


def reductions(measurements: DataFrame, arm: str, base: str) -> DataFrame:
    """(task, run_condition, time_reduction, context_reduction, correctness, pairs): medians and means over the paired trials of a task.

    A task and condition has no more pairs than trials, so that each group is small.
    """
    t, key = trials(measurements), ["task", "trial", "run_condition"]
    a = t.where(F.col("arm") == base).select(*key, F.col("cost").alias("o_cost"), F.col("context_bytes").alias("o_bytes"), F.col("correct").alias("o_correct"))
    b = t.where(F.col("arm") == arm).select(*key, "cost", "context_bytes", "correct")
    less = lambda x, o: F.when(F.col(o) > 0, 1 - F.col(x) / F.col(o))
    pairs = a.join(b, key).select(*key, less("cost", "o_cost").alias("t"), less("context_bytes", "o_bytes").alias("c"), (F.col("correct").cast("int") - F.col("o_correct").cast("int")).alias("d"))
    return pairs.groupBy("task", "run_condition").agg(F.percentile("t", 0.5).alias("time_reduction"), F.percentile("c", 0.5).alias("context_reduction"), F.avg("d").alias("correctness"), F.count("*").alias("pairs"))


def xorshift(seed: str) -> Iterator[float]:
    """Numbers from 0 to 1 of the 32-bit generator with shifts 13, 17 and 5, begun with the digest of ``seed``."""
    state = int.from_bytes(hashlib.sha256(seed.encode()).digest()[:4], "little") or 1
    while True:
        state ^= state << 13 & 0xFFFFFFFF
        state ^= state >> 17
        state ^= state << 5 & 0xFFFFFFFF
        yield state / 2**32


def median(values: list[float]) -> float:
    v, n = sorted(values), len(values)
    return v[n // 2] if n % 2 else (v[n // 2 - 1] + v[n // 2]) / 2


def interval(values: list[float], seed: str) -> tuple[float, float, float]:
    """The median with its percentile bootstrap bounds."""
    n, draw, found = len(values), xorshift(seed), []
    for _ in range(RESAMPLES):
        found.append(median([values[int(next(draw) * n)] for _ in range(n)]))
    found.sort()
    return median(values), found[LOWER], found[UPPER]


def bootstrap_intervals(tasks: DataFrame, by: str, value: str, seed: str) -> DataFrame:
    """(by, tasks, estimate, lower, upper) of a value per task; a group holds one value for each task of the study."""
    ship(tasks.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf[by].iloc[0]
        values = pdf.sort_values("task")[value].tolist()
        return pd.DataFrame([(key, len(values), *interval(values, f"{seed}:{key}"))], columns=[by, "tasks", "estimate", "lower", "upper"])

    return tasks.where(F.col(value).isNotNull() & F.col(by).isNotNull()).select(by, "task", value).groupBy(by).applyInPandas(run, f"{by} string, tasks long, estimate double, lower double, upper double")


def nearest_rank(rows: DataFrame, keys: list[str], value: str, share: float, tie: str) -> DataFrame:
    """(keys, n, mean, value): the exact percentile by nearest rank of each key; ranks are counted over ranges, no key is one task."""
    measured = rows.where(F.col(value).isNotNull())
    n = measured.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    ranked = running_sum(measured.select(*keys, value, tie), keys, [value, tie], F.lit(1), "rank")
    return ranked.join(n, keys).where(F.col("rank") == F.ceil(F.col("n") * share)).select(*keys, "n", "mean", value)


