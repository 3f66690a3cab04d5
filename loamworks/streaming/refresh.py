"""The refresh pass as a stream: new files of deliveries are read once, and each path's latest row is kept.

The state holds one row per path, the latest so far, whatever arrives late or twice. Each batch replaces the result in the
shared folder; a lost executor or a restart goes on from the checkpoint there.

Defined results: rows without repository or path are passed over; of rows of one path the greatest (snapshot_no, delivery, row_id)
counts; an empty source gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import canonical
from ..session import shared_dir

LATEST = "repository string, path string, snapshot_no int, delivery int, row_id long, content_hash string"


def latest_rows(rows: DataFrame) -> DataFrame:
    """(repository, path, snapshot_no, delivery, row_id, content_hash) of the latest row of each path, of a stream or a table."""
    kept = rows.where("repository is not null and path is not null").select("repository", canonical(F.col("path")).alias("path"), F.struct(F.col("snapshot_no").cast("int").alias("snapshot_no"), F.col("delivery").cast("int").alias("delivery"), "row_id", F.lower("content_hash").alias("content_hash")).alias("s"))
    return kept.groupBy("repository", "path").agg(F.max("s").alias("s")).select("repository", "path", "s.*")


def refresh(spark: SparkSession, source: str, name_filter: str = "*.parquet") -> DataFrame:
    """Runs the stream over all files there are now and returns the latest rows."""
    root = f"{shared_dir(spark)}/loamworks/refresh-{uuid.uuid4().hex}"
    schema = spark.read.option("pathGlobFilter", name_filter).parquet(source).schema
    stream = latest_rows(spark.readStream.schema(schema).option("pathGlobFilter", name_filter).parquet(source))

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/latest-{number % 2}")
        batch.sparkSession.createDataFrame([(number % 2,)], "n int").coalesce(1).write.mode("overwrite").parquet(f"{root}/current")

    query = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{root}/checkpoint").foreachBatch(store).trigger(availableNow=True).start()
    query.awaitTermination()
    here = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/current")
    if not here.getFileSystem(spark._jsc.hadoopConfiguration()).exists(here):
        return spark.createDataFrame([], LATEST)
    current = spark.read.parquet(f"{root}/current").first()[0]
    return spark.read.schema(LATEST).parquet(f"{root}/latest-{current}")
