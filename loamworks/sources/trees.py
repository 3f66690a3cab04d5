"""Source trees, documents and status texts as tables.

Defined results: files beyond the size limit, with NUL bytes, that hold secrets or whose text is no UTF-8 keep their row with the gate that
closed and no text; excluded paths give no row; empty trees give an empty table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import extension
from ..functions.text import contains_secret
from ..session import ship

#: Bytes of a file that is still read.
BYTE_LIMIT = 1 << 20


def read_tree(spark: SparkSession, root: str, excluded: Column | None = None, glob: str = "*") -> DataFrame:
    """(path, size, modified, digest, language, text, gate) of all files below ``root``; paths are relative to it.

    ``excluded`` is a condition on ``path``. The contents of files beyond the limit aren't kept.
    """
    base = root.rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    # Locations begin with the scheme; the part before the root is the same for all.
    path = F.element_at(F.split(F.try_url_decode(F.regexp_replace("path", "[+]", "%2B")), F.lit("\\Q" + base.split(":", 1)[-1].replace("//", "/") + "\\E"), 2), 2)
    files = raw.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    if excluded is not None:
        files = files.where(~excluded)
    text = F.decode("content", "UTF-8")
    gate = F.when(F.col("size") > BYTE_LIMIT, "too large").when(F.instr(F.col("content").cast("string"), "\0") > 0, "binary").when(~F.is_valid_utf8(F.col("content").cast("string")), "encoding").when(contains_secret(F.col("content").cast("string")), "sensitive")
    out = files.withColumn("gate", gate)
    return out.select("path", "size", "modified", F.sha2("content", 256).alias("digest"), extension(F.col("path")).alias("language"), F.when(F.col("gate").isNull(), text).alias("text"), "gate")


def worktree_status(status: DataFrame) -> DataFrame:
    """(root, path, state) of status texts in the second porcelain format; ``status`` has (root, text).

    A rename marks both of its paths; untracked and ignored files keep their states; the head is the state ``head``.
    """
    line = status.where("text is not null").select("root", F.explode(F.split("text", r"\r?\n")).alias("line"))
    # Fields are separated by blanks: nine before the path of a change, ten before that of a rename, whose old path follows a tab.
    kind = F.substring("line", 1, 2)
    head = F.regexp_extract("line", r"^# branch\.oid ([0-9a-f]+)", 1)
    plain = F.regexp_extract("line", r"^1 (?:\S+ ){7}(.+)$", 1)
    renamed = F.regexp_extract("line", r"^2 (?:\S+ ){8}([^\t]+)\t(.+)$", 1)
    before = F.regexp_extract("line", r"^2 (?:\S+ ){8}([^\t]+)\t(.+)$", 2)
    unmerged = F.regexp_extract("line", r"^u (?:\S+ ){9}(.+)$", 1)
    other = F.substring("line", 3, 1 << 20)
    pair = lambda p, s: F.struct(p.alias("path"), F.lit(s).alias("state"))
    rows = (
        F.when(head != "", F.array(pair(head, "head"))).when(kind == "1 ", F.array(pair(plain, "dirty"))).when(kind == "2 ", F.array(pair(renamed, "dirty"), pair(before, "dirty"))).when(kind == "u ", F.array(pair(unmerged, "dirty")))
        .when(kind == "? ", F.array(pair(other, "untracked"))).when(kind == "! ", F.array(pair(other, "ignored")))
    )
    return line.select("root", F.inline(rows)).where("path != ''").distinct()


def front_matter(files: DataFrame) -> DataFrame:
    """(path, metadata): the block between ``---`` lines at the top of (path, text), as JSON; files without one give no row, unreadable ones null.

    YAML is read by the ``yaml`` package where it is installed, else only flat ``key: value`` lines are.
    """
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            from yaml import YAMLError, safe_load
        except ImportError:
            YAMLError, safe_load = ValueError, lambda t: dict((k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in t.splitlines() if ":" in x))  # noqa: C402
        for pdf in batches:
            out = []
            for t in pdf["block"]:
                try:
                    value = safe_load(t)
                    out.append(json.dumps(value, sort_keys=True, default=str) if isinstance(value, dict) else None)
                except YAMLError:
                    out.append(None)
            yield pd.DataFrame({"path": pdf["path"], "metadata": out})

    block = F.regexp_extract("text", r"^---\r?\n(?s)(.*?)\r?\n---(?:\r?\n|$)", 1)
    return files.where("path is not null and text is not null").select("path", block.alias("block")).where("block != ''").mapInPandas(run, "path string, metadata string")


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one per file, by an explicit schema; what doesn't fit gives nulls."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
