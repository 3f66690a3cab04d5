"""Path expressions; all of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(path: Column) -> Column:
    """Single ``/`` as separator, no leading ``./``; null stays null.

    Only paths that have something to replace, which are few, are held against the expressions.
    """
    other = path.contains("\\") | path.contains("//") | F.startswith(path, F.lit("./"))
    return F.when(other, F.regexp_replace(F.regexp_replace(path, r"[\\/]+", "/"), r"^(\./)+", "")).otherwise(path)


def dirname(path: Column) -> Column:
    """The part before the last ``/``, ``''`` at the root."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, ``''`` if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def in_scope(path: Column, scope: str) -> Column:
    """``path`` is ``scope`` itself or lies below it; ``src`` does not hold ``src-other``."""
    s = scope.rstrip("/")
    return (path == s) | F.startswith(path, F.lit(s + "/"))
