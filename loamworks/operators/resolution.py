"""What a name refers to: unique names, the nearest scope, chains of names.

A name is resolved only if exactly one definition fits. Each rung of the ladder is one grouped table of names joined once; the first
rung with any candidate decides, and with several it refuses: later rungs never rescue it.

Defined results: null names resolve to nothing; definitions that are gone don't count; repeated definitions of one key are one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import clean, walk


def candidates(definitions: DataFrame, keys: dict[str, Column], rung: str) -> DataFrame:
    """One row per name: how many distinct definitions it has and the least of them."""
    one = definitions.select(*(c.alias(n) for n, c in keys.items()), "definition").where(" and ".join(f"{k} is not null" for k in [*keys, "definition"])).distinct()
    return one.groupBy(*keys).agg(F.count("*").alias(f"n_{rung}"), F.min("definition").alias(f"d_{rung}"))


def ladder(references: DataFrame, rungs: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """``references`` with (rung, n_candidates, definition, confidence) by the first rung, of (name, candidates, keys), that has a candidate."""
    out = references
    for name, found, keys in rungs:
        out = out.join(found, keys, "left")
    decided = reduce(lambda c, n: c.when(F.col(f"n_{n}") > 0, F.struct(F.lit(n).alias("rung"), F.col(f"n_{n}").alias("n"), F.col(f"d_{n}").alias("d"))), [n for n, _, _ in rungs], F)
    out = out.withColumn("_s", decided.otherwise(F.struct(F.lit("none").alias("rung"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("d"))))
    sure = F.col("_s.n") == 1
    return out.select(*references.columns, F.col("_s.rung").alias("rung"), F.col("_s.n").alias("n_candidates"), F.when(sure, F.col("_s.d")).alias("definition"), F.when(sure, "high").otherwise("unresolved").alias("confidence"))


def chain_ends(edges: DataFrame, depth: int) -> DataFrame:
    """Where chains of names end: (origin, n_ends, definition) of every node with an edge out, following at most ``depth`` edges.

    An end has no edge out. ``definition`` is the only end, null if there are none (a circle, or too deep) or several.
    """
    edges = clean(edges).where("source != target")
    starts = edges.select(F.col("source").alias("origin"), F.col("source").alias("node")).distinct()
    reached = walk(starts, edges, depth, ("origin",)).where("depth > 0")
    ends = reached.join(edges.select(F.col("source").alias("node")).distinct(), "node", "left_anti").groupBy("origin").agg(F.count("*").alias("n_ends"), F.min("node").alias("end"))
    out = starts.select("origin").join(ends, "origin", "left").withColumn("n_ends", F.coalesce("n_ends", F.lit(0).cast("long")))
    return out.select("origin", "n_ends", F.when(F.col("n_ends") == 1, F.col("end")).alias("definition"))
