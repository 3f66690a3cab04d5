"""What became of files and of what was written about them: moves, bindings, coverage.

Defined results: null paths, digests and keys take part in nothing; repeated rows count once; a path with several digests in one
snapshot stands for each of them; snapshots that don't count are passed over; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import canonical
from .orphans import held_sources


def snapshot_states(files: DataFrame) -> DataFrame:
    """Distinct (repository, idx, snapshot_no, next_no, path, content_hash) of the files of counted snapshots."""
    return files.select("repository", "idx", "snapshot_no", "next_no", "path", "content_hash").distinct()


def refresh_counters(files: DataFrame, changes: DataFrame) -> DataFrame:
    """Per counted snapshot with one before it: files reused, changed, added and removed."""
    held = files.where("idx > 1").select("repository", "snapshot_no", "path").distinct().groupBy("repository", "snapshot_no").agg(F.count("*").alias("files"))
    kinds = changes.groupBy("repository", "snapshot_no").agg(*(F.count_if(F.col("change_kind") == k).alias(k) for k in ("changed", "added", "removed")))
    out = held.join(kinds, ["repository", "snapshot_no"], "full").na.fill(0, ["files", "changed", "added", "removed"])
    return out.withColumn("reused", F.col("files") - F.col("changed") - F.col("added")).drop("files")


def move_candidates(files: DataFrame) -> DataFrame:
    """What became of each removed file: (repository, snapshot_no, path, candidates, state).

    ``moved`` if the next snapshot holds its content at one other path, ``ambiguous`` at several, ``missing`` at none. Contents are
    counted per snapshot before they meet the removed files, so that a content that fills a snapshot is one row.
    """
    s = snapshot_states(files)
    after = s.select("repository", (F.col("idx") - 1).alias("idx"), "path", "content_hash")
    gone = s.where("next_no is not null").join(after.select("repository", "idx", "path").distinct(), ["repository", "idx", "path"], "left_anti")
    places = after.groupBy("repository", "idx", "content_hash").agg(F.count_distinct("path").alias("n"))
    found = gone.join(places, ["repository", "idx", "content_hash"], "left").groupBy("repository", F.col("next_no").alias("snapshot_no"), "path").agg(F.sum(F.coalesce("n", F.lit(0))).cast("long").alias("candidates"))
    return found.withColumn("state", F.when(F.col("candidates") == 1, "moved").when(F.col("candidates") > 1, "ambiguous").otherwise("missing"))


def entry_sources(knowledge_entries: DataFrame) -> DataFrame:
    """Distinct (entry_id, repository, snapshot_no, verified_at, key) of the entries' sources, canonical."""
    rows = knowledge_entries.where("entry_id is not null and repository is not null").select("entry_id", "repository", F.col("snapshot_no").cast("int").alias("snapshot_no"), "verified_at", F.explode("sources").alias("source"))
    return rows.where("source is not null").select("entry_id", "repository", "snapshot_no", "verified_at", canonical(F.col("source")).alias("key")).distinct()


def _pattern() -> Column:
    return F.col("key").contains("*") | F.col("key").contains("{")


def binding_freshness(knowledge_entries: DataFrame, files: DataFrame, counted: DataFrame) -> DataFrame:
    """(entry_id, state) of entries with plain sources: ``missing`` if one is not in the last snapshot, ``unverified`` if nobody verified it,
    ``stale`` if one has changed since the entry's snapshot, else ``fresh``."""
    plain = entry_sources(knowledge_entries).where(~_pattern())
    last = counted.groupBy("repository").agg(F.max("snapshot_no").alias("last_no"))
    digest = files.groupBy("repository", "snapshot_no", F.col("path").alias("key")).agg(F.max("content_hash").alias("digest"))
    wanted = plain.join(last, "repository", "left")
    then = digest.withColumnRenamed("digest", "then")
    now = digest.select("repository", F.col("snapshot_no").alias("last_no"), "key", F.col("digest").alias("now"))
    each = wanted.join(then, ["repository", "snapshot_no", "key"], "left").join(now, ["repository", "last_no", "key"], "left")
    state = F.when(F.bool_or(F.col("now").isNull()), "missing").when(F.max("verified_at").isNull(), "unverified").when(F.bool_or(~F.col("now").eqNullSafe(F.col("then"))), "stale").otherwise("fresh")
    return each.groupBy("entry_id").agg(state.alias("state"))


def pattern_impact(knowledge_entries: DataFrame, changes: DataFrame, counted: DataFrame) -> DataFrame:
    """(entry_id, outcome): ``update`` if a path that changed in the repository's last snapshot equals or matches a source, else ``no-op``."""
    last = counted.groupBy("repository").agg(F.max("snapshot_no").alias("last_no"))
    keys = entry_sources(knowledge_entries).join(last, "repository").select("entry_id", "repository", F.col("last_no").alias("snapshot_no"), "key")
    changed = changes.join(last.withColumnRenamed("last_no", "snapshot_no"), ["repository", "snapshot_no"], "left_semi").select("repository", "snapshot_no", "path").distinct()
    held = held_sources(keys.select("repository", "snapshot_no", "key").distinct(), changed).withColumn("hit", F.lit(True))
    return keys.join(held, ["repository", "snapshot_no", "key"], "left").groupBy("entry_id").agg(F.when(F.bool_or("hit"), "update").otherwise("no-op").alias("outcome"))


def overlapping_owners(claims: DataFrame) -> DataFrame:
    """(repository, path, owners, others): how many owners claim a path or one above or below it.

    ``claims`` (repository, path, owner). Pairs of owners are never formed: owners are counted at each path and at all paths above it.
    """
    from .graph import ancestors  # noqa: PLC0415

    one = claims.distinct()
    up = one.select("repository", "path", "owner", F.explode(F.array_append(ancestors(F.col("path")), F.col("path"))).alias("at"))
    claimed = one.select("repository", F.col("path").alias("at")).distinct()
    up = up.join(claimed, ["repository", "at"], "left_semi")
    below = up.select("repository", F.col("at").alias("path"), "owner")
    above = up.select("repository", "path", "at").distinct().join(one.select("repository", F.col("path").alias("at"), "owner"), ["repository", "at"]).select("repository", "path", "owner")
    own = one.groupBy("repository", "path").agg(F.count("*").alias("owners"))
    every = below.unionByName(above).distinct().groupBy("repository", "path").agg(F.count("*").alias("n"))
    return own.join(every, ["repository", "path"]).select("repository", "path", "owners", (F.col("n") - F.col("owners")).alias("others"))
