"""References to records that do not exist.

Three tables refer to others: ``call_edges.target_key`` to symbols, ``reader_relationships.target_id`` to reader records
and the elements of ``knowledge_entries.sources`` to the files of a snapshot. A reference whose target has no lifetime
covering it is a *direct* orphan (round 0, a semi-join against lifetimes or snapshot files). The cascade then walks the
foreign-key graph to its fixpoint: a record that holds an orphan reference is an orphaned record, and a reference to an
orphaned record is an *inherited* orphan of the next round.

Patterns among the sources are found by tuple-space search: each pattern has a tuple (literal depth, kind of last
segment) and one key in it; each file forms keys only for the tuples its snapshot's patterns use, and a semi-join on
the key, with the pattern's expression where the key alone doesn't decide, tells which have a file. No pairs are emitted.

Defined results: null references are none; a null ``captured_at`` is covered by no lifetime; a null ``confidence``
counts as resolved; lifetimes without ``added_at`` cover nothing; repeated rows give one reference; a snapshot that
doesn't count has no files, so each source held against it is an orphan; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.globs import glob_regex, glob_tuple
from ..functions.paths import canonical
from ..session import forget, materialise, ship, small
from .snapshots import counted_snapshots, file_lines

REFERENCE = ["ref_table", "ref_id", "ref_key"]
#: Files of one key that one task holds against patterns.
SALTED = 20_000
#: Rounds after which the records reached are written as one table, and the links without those to records reached.
MERGED = 8
#: Links are also written anew once the records reached since they were last written are this part of them.
RENEWED = 1 / 4
#: A record in a broadcast table.
RECORD_BYTES = 80


def symbol_key(key: Column) -> Column:
    """``path::qualname`` with the canonical path."""
    path = F.substring_index(key, "::", 1)
    return F.concat(canonical(path), F.substring(key, F.length(path) + 1, F.length(key)))


def node(kind: str, repository: Column, key: Column) -> Column:
    """16 bytes that stand for a record in the foreign-key graph."""
    return F.unhex(F.md5(F.concat(F.lit(kind + "\0"), repository, F.lit("\0"), key)))


def lifetimes(df: DataFrame, key: Column) -> DataFrame:
    return df.select(F.col("repository").alias("l_repository"), key.alias("l_key"), "added_at", "removed_at").where("added_at is not null and l_key is not null").distinct()


def _missing(refs: DataFrame, lives: DataFrame) -> DataFrame:
    """The rows of ``refs`` (with repository, key, at) that no lifetime covers.

    AQE splits hot keys of ``refs``; a key's lifetimes, of which it can't split any, are few and distinct.
    """
    covered = (F.col("repository") == F.col("l_repository")) & (F.col("key") == F.col("l_key")) & (F.col("at") >= F.col("added_at")) & (F.col("removed_at").isNull() | (F.col("at") < F.col("removed_at")))
    return refs.join(lives, covered, "left_anti")


def edge_references(call_edges: DataFrame) -> DataFrame:
    """One row per edge with the readings of its target: in its own repository, and, with a third part, in the one it names (else null)."""
    edges = call_edges.where("target_key is not null and not (confidence <=> 'unresolved')")
    head = F.substring_index("target_key", "::", 1)
    rest = F.expr("substring(target_key, length(substring_index(target_key, '::', 1)) + 3)")
    own = F.struct(F.col("repository").alias("repository"), symbol_key(F.col("target_key")).alias("key"))
    other = F.struct(head.alias("repository"), symbol_key(rest).alias("key"))
    return edges.select(
        F.lit("call_edges").alias("ref_table"), F.col("edge_id").alias("ref_id"), F.col("target_key").alias("ref_key"), F.col("captured_at").alias("at"),
        node("symbol", F.col("repository"), symbol_key(F.col("source_key"))).alias("holder"), own.alias("own"), F.when(rest.contains("::"), other).alias("other"),
    )


def relation_references(reader_relationships: DataFrame) -> DataFrame:
    record = lambda c: canonical(F.substring_index(c, "#", 1))
    return reader_relationships.where("target_id is not null").select(
        F.lit("reader_relationships").alias("ref_table"), F.col("relation_id").alias("ref_id"), F.col("target_id").alias("ref_key"), F.col("captured_at").alias("at"),
        node("record", F.col("repository"), record(F.col("source_id"))).alias("holder"),
        F.struct(F.col("repository").alias("repository"), record(F.col("target_id")).alias("key")).alias("own"),
    )


def _direct_by_lifetime(refs: DataFrame, lives: DataFrame) -> DataFrame:
    """A reference with two readings is an orphan only if neither is covered; the second is tried for what the first leaves over.

    References without a second reading are tried for the first again, which changes nothing, so that their table is read once.
    """
    left = _missing(refs.select("*", "own.*").drop("own"), lives)
    second = {c: F.coalesce(F.col("other")[c], F.col(c)) for c in ("repository", "key")}
    return _missing(left.withColumns(second), lives) if "other" in refs.columns else left


def _targets(refs: DataFrame, kind: str) -> DataFrame:
    """One row per reference and reading, with the record that it names."""
    readings = F.array("own")
    if "other" in refs.columns:
        readings = F.when(F.col("other").isNotNull(), F.array("own", "other")).otherwise(readings)
    each = refs.select(*REFERENCE, "at", "holder", F.explode(readings).alias("r"))
    return each.select(*REFERENCE, "at", "holder", node(kind, F.col("r.repository"), F.col("r.key")).alias("target"))


def _glob_columns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        made = {s: (*glob_tuple(s), glob_regex(s)) for s in pdf["key"].unique()}
        parts = [made[s] for s in pdf["key"]]
        pdf["tuple"] = [f"{p[0]}{p[1]}" for p in parts]
        pdf["tuple_key"] = [p[2] for p in parts]
        pdf["expression"] = [None if p[3] else p[4] for p in parts]
        yield pdf


def source_references(knowledge_entries: DataFrame) -> DataFrame:
    """One row per element of sources, with its canonical key."""
    return knowledge_entries.select("entry_id", "repository", "path", F.col("snapshot_no").cast("int").alias("snapshot_no"), "registered_at", F.explode("sources").alias("source")).where("source is not null").select(
        F.lit("knowledge_entries").alias("ref_table"), F.col("entry_id").alias("ref_id"), F.col("source").alias("ref_key"), F.col("registered_at").alias("at"),
        node("record", F.col("repository"), canonical(F.col("path"))).alias("holder"), "repository", "snapshot_no", canonical(F.col("source")).alias("key"),
    )


def held_sources(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Of the distinct (repository, snapshot_no, key), those that one of ``files`` (repository, snapshot_no, path) equals or matches.

    Files form the keys of the tuples in use and are cut to the keys that are wanted before any shuffle, by hash. Keys that decide alone
    go on without the path. Where the expression decides, files of one key are salted and the few patterns are repeated for
    each salt, so that a key that a third of all files form is spread over many tasks.
    """
    ship(wanted.sparkSession)
    place = ["repository", "snapshot_no"]
    pattern = F.col("key").contains("*") | F.col("key").contains("{")
    globs = wanted.where(pattern).mapInPandas(_glob_columns, "repository string, snapshot_no int, key string, tuple string, tuple_key string, expression string")
    plain = wanted.where(~pattern).select(*place, "key", F.lit("path").alias("tuple"), F.col("key").alias("tuple_key"), F.lit(None).cast("string").alias("expression"))
    keys = materialise(plain.unionByName(globs), "sources")
    # The tuples in use are few (depth times six kinds), whatever the number of patterns; what they mean is read once, not for each file.
    kind = F.regexp_extract("tuple", r"^\d+(.*)$", 1)
    read = F.struct("tuple", F.regexp_extract("tuple", r"^(\d+)", 1).try_cast("int").alias("depth"), kind.alias("kind"), F.startswith(kind, F.lit("/")).alias("direct"), F.when(F.endswith(kind, F.lit("name")), 1).when(F.endswith(kind, F.lit("ext")), 2).otherwise(0).alias("tail"), "unsure")
    kinds = keys.groupBy("tuple").agg(F.max(F.col("expression").isNotNull()).alias("unsure")).select("tuple", read.alias("t"))
    tuples = small(materialise(keys.select(*place, "tuple").distinct().join(F.broadcast(kinds), "tuple").groupBy(*place).agg(F.collect_set("t").alias("tuples")), "tuples"), 800)
    hashed = lambda key: F.xxhash64(*place, "tuple", key)
    asked = small(materialise(keys.select(hashed(F.col("tuple_key")).alias("h")).distinct(), "asked"), 24)
    # What depends on the file alone is worked out before the tuples are unfolded: a select that also explodes would do it for each tuple.
    read_once = files.join(tuples, place).select(*place, "path", F.size(F.split("path", "/")).alias("parts"), F.substring_index("path", "/", -1).alias("name"), F.regexp_extract("path", r"(\.[^./]+)$", 1).alias("ext"), "tuples")
    each = read_once.select(*place, "path", "parts", "name", "ext", F.explode("tuples").alias("t")).select(*place, "path", "parts", "name", "ext", "t.*")
    deep = F.when(F.col("direct"), F.col("parts") == F.col("depth") + 1).otherwise(F.col("parts") > F.col("depth"))
    formed = F.when(F.col("tuple") == "path", F.col("path")).when(deep, F.concat_ws("\0", F.expr("substring_index(path, '/', depth)"), "kind", F.when(F.col("tail") == 1, F.col("name")).when(F.col("tail") == 2, F.col("ext")).otherwise(F.lit(""))))
    found = each.select(*place, "tuple", formed.alias("tuple_key"), F.when(F.col("unsure"), F.col("path")).alias("path")).where("tuple_key is not null").withColumn("h", hashed(F.col("tuple_key"))).join(asked, "h", "left_semi").drop("h")
    tuple_key = [*place, "tuple", "tuple_key"]
    found = materialise(found.distinct(), "found")
    sure = keys.where("expression is null").join(found.select(*tuple_key).distinct(), tuple_key, "left_semi").select(*place, "key")
    unsure, tried = keys.where("expression is not null"), found.where("path is not null")
    most = tried.groupBy(*tuple_key).count().agg(F.max("count")).first()[0] or 0
    salts = max(1, math.ceil(most / SALTED))
    left = unsure.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    right = tried.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(salts)).cast("int"))
    same = F.expr("path rlike expression")
    for c in [*tuple_key, "salt"]:
        same = same & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    held = left.alias("l").join(right.alias("r"), same, "left_semi").select(*place, "key")
    return sure.unionByName(held).distinct()


def direct_orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """Round 0: (ref_table, ref_id, ref_key, at, holder) of each reference without a target; holder is its record."""
    keep = [*REFERENCE, "at", "holder"]
    edges = _direct_by_lifetime(edge_references(tables["call_edges"]), lifetimes(tables["symbols"], symbol_key(F.col("symbol_key"))))
    relations = _direct_by_lifetime(relation_references(tables["reader_relationships"]), lifetimes(tables["reader_records"], canonical(F.col("record_id"))))
    sources = source_references(tables["knowledge_entries"])
    place = ["repository", "snapshot_no", "key"]
    wanted = materialise(sources.where("repository is not null and snapshot_no is not null").select(*place).distinct(), "wanted")
    counted = counted_snapshots(tables["file_rows"], tables["snapshots"])
    asked = materialise(counted.join(wanted.select("repository", "snapshot_no").distinct(), ["repository", "snapshot_no"], "left_semi").select("repository", "snapshot_no", "delivery"), "asked")
    files = file_lines(tables["file_rows"]).join(small(asked, 60), ["repository", "snapshot_no", "delivery"]).select("repository", "snapshot_no", "path")
    held = held_sources(wanted, files)
    missing = sources.join(held, place, "left_anti")
    return reduce(DataFrame.unionByName, [edges.select(*keep), relations.select(*keep), missing.select(*keep)])


def orphan_references(tables: dict[str, DataFrame], max_round: int | None = None) -> DataFrame:
    """The cascade: (ref_table, ref_id, ref_key, at, round), distinct; round 0 is direct, later ones are inherited.

    Each round is one semi-join of the links between records with the newly orphaned ones; it ends when no record is new, or after
    ``max_round`` rounds. The set of records reached so far is rewritten every few rounds, so that no round reads many files.
    """
    direct = direct_orphans(tables)
    if max_round == 0:  # what holds an orphan changes no reference of its own round
        return direct.select(*REFERENCE, "at", F.lit(0).alias("round")).distinct()
    direct = materialise(direct.distinct(), "direct")
    targets, more = _targets(edge_references(tables["call_edges"]), "symbol"), _targets(relation_references(tables["reader_relationships"]), "record")
    # Repeated references are made one when they get their round; before, nothing depends on that.
    rest = materialise(targets.unionByName(more).where("target is not null").join(small(direct.select(*REFERENCE), 200), REFERENCE, "left_anti"), "references")
    last = materialise(direct.where("holder is not null").select("holder").distinct().select("holder", F.lit(1).alias("round")), "records")
    # The graph of records is walked on distinct links; references get their round at the end. Links to holders that are reached
    # can't add any, so each time that links are written they are left out, and only records reached since then can come up again.
    unreached = lambda links, seen: links.join(small(seen.select("holder"), RECORD_BYTES), "holder", "left_anti")
    links = materialise(unreached(rest.where("holder is not null").select("target", "holder"), last).distinct(), "links")
    reached, since, new, rounds, n_links = [last], [], 0, 1, links.count()
    while max_round is None or rounds < max_round:
        rounds += 1
        fresh = links.join(small(last.select(F.col("holder").alias("target")), RECORD_BYTES), "target", "left_semi").select("holder").distinct()
        if since:
            fresh = unreached(fresh, reduce(DataFrame.unionByName, since))
        last = materialise(fresh.select("holder", F.lit(rounds).alias("round")), "records")
        n = last.count()
        if not n:
            break
        reached.append(last)
        since.append(last)
        new += n
        if len(reached) > MERGED or new >= RENEWED * n_links:
            links = materialise(unreached(links, reduce(DataFrame.unionByName, since)), "links", replaces=[links])
            since, new, n_links = [], 0, links.count()
        if len(reached) > MERGED:
            reached = [materialise(reduce(DataFrame.unionByName, reached), "reached", replaces=reached[:-1])]
    forget(links)
    records = materialise(reduce(DataFrame.unionByName, reached).select(F.col("holder").alias("target"), "round"), "reached", replaces=[*reached, last])
    inherited = rest.join(small(records, RECORD_BYTES), "target").groupBy(*REFERENCE, "at").agg(F.min("round").alias("round"))
    return direct.select(*REFERENCE, "at", F.lit(0).alias("round")).distinct().unionByName(inherited)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Direct and inherited orphans per table and month (null ``at``: null month)."""
    return orphans.groupBy("ref_table", F.date_format("at", "yyyy-MM").alias("month")).agg(
        F.count_if(F.col("round") == 0).alias("direct"), F.count_if(F.col("round") > 0).alias("inherited"), F.count_distinct(F.when(F.col("round") == 0, F.col("ref_key"))).alias("missing_keys")
    )
