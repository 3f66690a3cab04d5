"""Session helpers: shared storage, shipping of the package, checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it is measured to be below this many bytes.
BROADCAST_LIMIT = 48 << 20
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session without the setting (tests) gets a folder of its own.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="loamworks-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialise(df: DataFrame, name: str = "step", replaces: Iterable[DataFrame] = ()) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: lineage ends there and any executor may be lost.

    ``replaces``: tables written before that nothing but ``df`` reads any more; they are removed once it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loamworks/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for old in replaces:
        forget(old)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def forget(df: DataFrame) -> None:
    """Removes the files of a table that :func:`materialise` wrote and that nothing reads any more."""
    path = getattr(df, "_written", None)
    if path is not None:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def cleanup(spark: SparkSession) -> None:
    """Removes all tables that :func:`materialise` wrote into the shared folder, once the results that read them are stored."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/loamworks")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows times ``row_bytes`` stay below ``limit``, else ``df`` as it is (shuffled join, AQE splits skew).

    ``df`` should be materialised: it is counted here.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, which import it by name, wherever the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="loamworks-ship-")) / "loamworks.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, os.path.join(here.name, f.relative_to(here)))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
