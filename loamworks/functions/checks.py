"""Checks of identifiers and arguments, and the budget of an answer."""

from __future__ import annotations

import json
import math
from typing import Any

from pyspark.sql import Column

DIGEST, ALIAS, IDENTIFIER = r"^[0-9a-f]{64}$", r"^[a-z0-9][a-z0-9-]{0,62}$", r"^[A-Za-z_$][A-Za-z0-9_$.-]{0,127}$"


def is_digest(c: Column) -> Column:
    return c.rlike(DIGEST)


def is_alias(c: Column) -> Column:
    return c.rlike(ALIAS)


def is_identifier(c: Column) -> Column:
    return c.rlike(IDENTIFIER)


def scope(path: str) -> str:
    """A scope without its last slash; absolute paths and paths that lead out are refused."""
    parts = path.replace("\\", "/").split("/")
    if path.startswith(("/", "\\")) or ".." in parts or (len(path) > 1 and path[1] == ":"):
        raise ValueError(f"a scope must lie inside the repository: {path}")
    return "/".join(p for p in parts if p not in ("", "."))


def arguments(given: dict[str, Any], schema: dict[str, dict]) -> dict[str, Any]:
    """Checked arguments with their defaults. A schema names for each argument its ``type`` and, if any, ``default``, ``least``, ``most``,
    ``options`` and ``required``; others are refused."""
    extra = set(given) - set(schema)
    if extra:
        raise ValueError(f"unknown arguments: {', '.join(sorted(extra))}")
    out = {}
    for name, rule in schema.items():
        if name not in given:
            if rule.get("required"):
                raise ValueError(f"{name} is required")
            out[name] = rule.get("default")
            continue
        value = given[name]
        if not isinstance(value, rule["type"]) or (rule["type"] is int and isinstance(value, bool)):
            raise ValueError(f"{name} must be {rule['type'].__name__}")
        size = value if isinstance(value, int) else len(value) if isinstance(value, str | list) else 0
        if size < rule.get("least", size) or size > rule.get("most", size) or value not in rule.get("options", [value]):
            raise ValueError(f"{name} is out of bounds")
        out[name] = value
    return out


def fit_budget(payload: dict[str, Any], token_budget: int, lists: list[str]) -> dict[str, Any]:
    """The payload cut to about so many tokens of four bytes: the longest list loses its last item until it fits, long texts are halved."""
    limit = max(256, min(16_000, token_budget)) * 4 - 128
    out, omitted = dict(payload), 0
    size = lambda x: len(json.dumps(x, ensure_ascii=False, default=str).encode())
    while size(out) > limit:
        open_ = [k for k in lists if (isinstance(out.get(k), list) and out[k]) or (isinstance(out.get(k), str) and len(out[k]) > 80)]
        if not open_:
            break
        k = max(open_, key=lambda k: size(out[k]))
        out[k] = out[k][:-1] if isinstance(out[k], list) else out[k][: len(out[k]) // 2] + "\n[cut]"
        omitted += 1
    return {**out, "truncated": bool(omitted) or bool(payload.get("truncated")), "omitted_items": omitted, "estimated_tokens": math.ceil(size(out) / 4)}
