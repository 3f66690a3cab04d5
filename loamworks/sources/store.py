"""Tables of files that are replaced as a whole, with their former revisions.

Each revision is a folder of Parquet files; a small text next to them names the current one and is moved into place, so that readers
see the old or the new table, never a part. A writer states the revision it read; if another writer was faster it is refused.

Defined results: a table that was never written is empty and has revision 0; replacing nothing still makes a revision; keys that are
null replace nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class StaleRevision(RuntimeError):
    """Another revision than the stated one is current."""


class FileStore:
    """A versioned table below ``root`` whose rows belong to files: all rows of a file are replaced together."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: tuple[str, ...] = ("path",)) -> None:
        self.spark, self.root, self.schema, self.key = spark, root.rstrip("/"), schema, list(key)
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def revision(self) -> int:
        place = self._path(self.root)
        if not self._fs.exists(place):
            return 0
        names = [str(s.getPath().getName()) for s in self._fs.listStatus(place)]
        return max((int(n[8:]) for n in names if n.startswith("current-")), default=0)

    def read(self, revision: int | None = None) -> DataFrame:
        """The current table, or that of a former revision."""
        n = self.revision() if revision is None else revision
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/revision-{n}") if n else self.spark.createDataFrame([], self.schema)

    def replace(self, rows: DataFrame, removed: DataFrame | None = None, expected: int | None = None) -> int:
        """Replaces all rows of the keys that ``rows`` or ``removed`` hold; gives the new revision."""
        now = self.revision()
        if expected is not None and expected != now:
            raise StaleRevision(f"revision {now} is current, not {expected}")
        touched = rows.select(*self.key)
        if removed is not None:
            touched = touched.unionByName(removed.select(*self.key))
        columns = self.read(0).columns
        kept = self.read(now).join(touched.distinct(), self.key, "left_anti")
        kept.select(*columns).unionByName(rows.select(*columns)).write.mode("overwrite").parquet(f"{self.root}/revision-{now + 1}")
        # Making a name that exists fails, so that of two writers one is refused.
        if not self._fs.createNewFile(self._path(f"{self.root}/current-{now + 1}")):
            raise StaleRevision(f"revision {now + 1} was written by another")
        return now + 1

    def forget(self, before: int) -> None:
        """Removes the revisions before one."""
        for n in range(1, before):
            self._fs.delete(self._path(f"{self.root}/revision-{n}"), True)


def drift(old: DataFrame, new: DataFrame, key: str = "path", digest: str = "digest") -> DataFrame:
    """(key, state) of what differs between two tables: ``added``, ``removed`` or ``changed``."""
    a, b = old.select(F.col(key), F.col(digest).alias("_a")).distinct(), new.select(F.col(key), F.col(digest).alias("_b")).distinct()
    both = a.withColumn("_x", F.lit(1)).join(b.withColumn("_y", F.lit(1)), key, "full")
    state = F.when(F.col("_x").isNull(), "added").when(F.col("_y").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return both.select(key, state.alias("state")).where("state is not null")
