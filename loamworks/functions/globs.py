"""Glob patterns of paths: ``*`` inside a segment, ``**`` any number of segments (also none), ``{a,b}`` alternatives."""

from __future__ import annotations

import re

def glob_regex(pattern: str) -> str:
    """An anchored regular expression, valid in Java and Python, for a canonical glob."""
    out, depth = [], 0
    closed = _balanced(pattern)
    segments = re.split(r"/", pattern) if not closed else _outer_segments(pattern)
    for i, segment in enumerate(segments):
        last = i == len(segments) - 1
        if segment == "**":
            out.append("(?:[^/]+(?:/[^/]+)*)?" if last and i == 0 else "[^/]+(?:/[^/]+)*" if last else "(?:[^/]+/)*")
            continue
        part = []
        for ch in re.findall(r"\*+|.", segment, re.S):
            if ch[0] == "*":
                part.append(".*" if len(ch) > 1 and depth else "[^/]*")
            elif ch == "{" and closed:
                part.append("(?:")
                depth += 1
            elif ch == "}" and closed:
                part.append(")")
                depth -= 1
            elif ch == "," and depth:
                part.append("|")
            else:
                part.append(re.escape(ch) if not ch.isalnum() and ch not in "_-/ " and ord(ch) < 128 else ch)
        out.append("".join(part) + ("" if last else "/"))
    return "^" + "".join(out) + "$"


def _balanced(pattern: str) -> bool:
    depth = 0
    for ch in pattern:
        depth += (ch == "{") - (ch == "}")
        if depth < 0:
            return False
    return depth == 0


def _outer_segments(pattern: str) -> list[str]:
    """Split at the slashes that stand outside braces."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(pattern):
        depth += (ch == "{") - (ch == "}")
        if ch == "/" and depth == 0:
            out.append(pattern[start:i])
            start = i + 1
    return [*out, pattern[start:]]


def glob_tuple(pattern: str) -> tuple[int, str, str, bool]:
    """The tuple ``(depth, kind, key, exact)`` under which a file that matches must be found.

    ``depth`` is the number of leading literal segments. ``kind`` says what else the key holds: ``name`` the literal last
    segment, ``ext`` its literal extension, ``any`` nothing, each with ``/`` before it if the last segment must directly
    follow the literal ones. ``exact``: a file with that key matches for certain; otherwise the expression decides.
    """
    segments = _outer_segments(pattern) if _balanced(pattern) else pattern.split("/")
    literal = 0
    while literal < len(segments) - 1 and not re.search(r"[*{]", segments[literal]):
        literal += 1
    rest, last = segments[literal:-1], segments[-1]
    # Alternatives that hold a slash may span segments.
    direct = not rest and "/" not in last
    if not re.search(r"[*{]", last):
        kind, tail, sure = "name", last, True
    elif (m := re.fullmatch(r"\*(\.[^.*{}/]+)", last)) is not None:
        kind, tail, sure = "ext", m[1], True
    else:
        kind, tail, sure = "any", "", last in ("*", "**")
    if last == "**" and direct:
        direct, rest = False, ["**"]
    exact = sure and (direct or rest == ["**"])
    kind = ("/" if direct else "") + kind
    return literal, kind, file_key("/".join(segments[:literal]), kind, tail), exact


def file_key(prefix: str, kind: str, tail: str) -> str:
    return "\0".join((prefix, kind, tail))
