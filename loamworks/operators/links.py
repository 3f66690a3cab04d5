"""Links of Markdown texts: extracted, decoded and normalised to paths inside the same bundle.

Defined results: images, addresses with a scheme and anchors of the same text are no links; a path that leads out of the bundle
is none; ``.`` and ``..`` are resolved; null texts have no links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import dirname

_LINK = r"(?:^|[^!])\[[^\]\n]*\]\(\s*<?([^)\s>]+)"


def normalised(path: Column) -> Column:
    """The path without ``.`` and ``..``; null if it leads out."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("out"))
    step = lambda a, x: F.struct(F.when(x == "..", F.slice(a["kept"], 1, F.greatest(F.size(a["kept"]) - 1, F.lit(0)))).otherwise(F.array_append(a["kept"], x)).alias("kept"), (a["out"] | ((x == "..") & (F.size(a["kept"]) == 0))).alias("out"))
    return F.aggregate(parts, start, step, lambda a: F.when(~a["out"], F.array_join(a["kept"], "/")))


def markdown_links(files: DataFrame) -> DataFrame:
    """(path, target), distinct, of (path, text)."""
    raw = files.where("path is not null and text is not null").select("path", F.explode(F.regexp_extract_all("text", F.lit(_LINK), 1)).alias("link"))
    link = F.regexp_replace(F.try_url_decode(F.regexp_replace("link", "[+]", "%2B")), "[#?].*$", "")
    inside = raw.select("path", F.coalesce(link, F.regexp_replace("link", "[#?].*$", "")).alias("link")).where("link != '' and not link rlike '^[A-Za-z][A-Za-z0-9+.-]*:' and not link rlike '^//'")
    joined = F.when(F.startswith("link", F.lit("/")), F.col("link")).otherwise(F.concat_ws("/", dirname(F.col("path")), "link"))
    return inside.select("path", normalised(joined).alias("target")).where("target is not null and target != ''").distinct()
