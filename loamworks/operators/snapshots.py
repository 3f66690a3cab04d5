"""What changed between full snapshots.

``file_rows`` holds deliveries of full snapshots. A delivery is full if the SHA-256 of its sorted lines gives the
``input_digest`` of its row in ``snapshots``; the highest full delivery of a ``snapshot_no`` is the snapshot.

Digests: the lines are range-partitioned by delivery and line, so that no task sorts a whole delivery; each task joins
its sorted lines into chunks, and the chunks of a delivery are hashed as a stream. A task never holds more than a batch.

Changes: each key ``(repository, path)`` is windowed by the index of its snapshots. The lagged digest reveals changes,
a gap in the index a removal and a later addition.

Defined results: null paths or digests are no lines; repeated rows count once; a delivery without rows has the
digest of the empty text; a null ``input_digest`` or repository is never full; a path with several digests in one
snapshot is compared by the set of them; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import canonical
from ..session import materialise, ship, small

DELIVERY = ["repository", "snapshot_no", "delivery"]
EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()
_DIGEST_SCHEMA = "repository string, snapshot_no int, delivery int, digest string"
_CHUNK_SCHEMA = "repository string, snapshot_no int, delivery int, first_line string, body binary"


def file_lines(file_rows: DataFrame) -> DataFrame:
    """(repository, snapshot_no, delivery, path, content_hash) with canonical path and lower-case digest."""
    return file_rows.select(
        "repository", F.col("snapshot_no").cast("int").alias("snapshot_no"), F.col("delivery").cast("int").alias("delivery"),
        canonical(F.col("path")).alias("path"), F.lower("content_hash").alias("content_hash"),
    ).where("repository is not null and snapshot_no is not null and delivery is not null and path is not null and content_hash is not null")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list]]:
    """Runs of rows of the same delivery, with the values of the remaining columns; a run ends at the end of a batch."""
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        start, n = 0, batch.num_rows
        keys = list(zip(*cols[:3], strict=True))
        while start < n:
            end = start + 1
            if keys[-1] == keys[start]:
                end = n
            else:
                while end < n and keys[end] == keys[start]:
                    end += 1
            yield keys[start], [c[start:end] for c in cols[3:]]
            start = end


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("repository", pa.string()), ("snapshot_no", pa.int32()), ("delivery", pa.int32()), ("first_line", pa.string()), ("body", pa.binary())])
    last = None
    for key, (lines,) in _runs(batches):
        kept = list(dict.fromkeys(lines))
        if last == (key, kept[0]):
            kept = kept[1:]
        if kept:
            last = (key, kept[-1])
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, kept[0], "\n".join(kept).encode()), strict=True))], schema)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("repository", pa.string()), ("snapshot_no", pa.int32()), ("delivery", pa.int32()), ("digest", pa.string())])
    now, sha, done = None, None, []
    for key, (_, bodies) in _runs(batches):
        if key != now:
            if sha is not None:
                done.append((*now, sha.hexdigest()))
            now, sha = key, hashlib.sha256()
        else:
            sha.update(b"\n")
        sha.update(b"\n".join(bodies))
    if sha is not None:
        done.append((*now, sha.hexdigest()))
    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in done], schema)


def delivery_digests(file_rows: DataFrame) -> DataFrame:
    """(repository, snapshot_no, delivery, digest): what the rows of each delivery hash to."""
    ship(file_rows.sparkSession)
    lines = file_lines(file_rows).select(*DELIVERY, F.concat("path", F.lit("\0"), "content_hash").alias("line"))
    chunks = lines.repartitionByRange(*DELIVERY, "line").sortWithinPartitions(*DELIVERY, "line").mapInArrow(_chunks, _CHUNK_SCHEMA)
    return chunks.repartition(*DELIVERY).sortWithinPartitions(*DELIVERY, "first_line").mapInArrow(_hashes, _DIGEST_SCHEMA)


def counted_snapshots(file_rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row per snapshot that counts: repository, snapshot_no, delivery, idx (dense, from 1), next_no (null at the end). Materialised."""
    declared = snapshots.select("repository", F.col("snapshot_no").cast("int").alias("snapshot_no"), F.col("delivery").cast("int").alias("delivery"), F.lower("input_digest").alias("input_digest")).where(
        "repository is not null and snapshot_no is not null and delivery is not null and input_digest is not null"
    )
    full = declared.join(delivery_digests(file_rows), DELIVERY, "left").where(F.coalesce("digest", F.lit(EMPTY_DIGEST)) == F.col("input_digest"))
    best = full.groupBy("repository", "snapshot_no").agg(F.max("delivery").alias("delivery"))
    w = Window.partitionBy("repository").orderBy("snapshot_no")
    return materialise(best.select("*", F.row_number().over(w).alias("idx"), F.lead("snapshot_no").over(w).alias("next_no")), "counted")


def snapshot_files(file_rows: DataFrame, counted: DataFrame) -> DataFrame:
    """The lines of the snapshots that count, with idx and next_no."""
    return file_lines(file_rows).join(small(counted, 120), DELIVERY)


def snapshot_changes(file_rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(repository, snapshot_no, path, change_kind) for each pair of consecutive counted snapshots."""
    files = snapshot_files(file_rows, counted_snapshots(file_rows, snapshots))
    # The partitioning of the window also serves the grouping: one shuffle.
    states = (
        files.select("repository", "path", "idx", "snapshot_no", "next_no", F.coalesce(F.unhex("content_hash"), F.encode("content_hash", "UTF-8")).alias("hash"))
        .repartition("repository", "path")
        .groupBy("repository", "path", "idx", "snapshot_no", "next_no")
        .agg(F.sort_array(F.collect_set("hash")).alias("hashes"))
    )
    w = Window.partitionBy("repository", "path").orderBy("idx")
    lag, lead = F.lag("idx").over(w), F.lead("idx").over(w)
    seen = states.select(
        "*", lag.alias("before"), lead.alias("after"),
        (F.lag("hashes").over(w) != F.col("hashes")).alias("differs"),
    )
    here = F.when(F.col("before").isNull() | (F.col("before") < F.col("idx") - 1), F.when(F.col("idx") > 1, F.lit("added"))).when(F.col("differs"), F.lit("changed"))
    gone = F.when(F.col("next_no").isNotNull() & (F.col("after").isNull() | (F.col("after") > F.col("idx") + 1)), F.lit("removed"))
    events = F.array(F.struct(F.col("snapshot_no").alias("snapshot_no"), here.alias("change_kind")), F.struct(F.col("next_no").alias("snapshot_no"), gone.alias("change_kind")))
    return seen.select("repository", "path", F.inline(events)).where("change_kind is not null").select("repository", "snapshot_no", "path", "change_kind")
