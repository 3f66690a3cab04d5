"""Definitions, imports and calls of source files.

Python is read by its own syntax tree. The other languages are read by a scanner that knows comments, literals and brackets: a
definition ends with the bracket that its body begins with. Files that can't be read give what could be found, or nothing.

Defined results: null and empty texts give no rows; other extensions neither; a name defined twice gives a row for each definition.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import canonical, extension
from ..session import ship

FOUND = "repository string, path string, row_kind string, qualname string, kind string, start_line int, end_line int, target string"
_SCHEMA = pa.schema([("repository", pa.string()), ("path", pa.string()), ("row_kind", pa.string()), ("qualname", pa.string()), ("kind", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("target", pa.string())])
Row = tuple[str, str | None, str | None, int, int, str | None]

_SKIP = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|(?<=[=(,:;!&|?{}\[])([ \t]*)/(?![/*\s])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*", re.S)
_BRACKET = re.compile(r"[(){}]")
_CALL = re.compile(r"(?<![\w.])((?:\w+\.)*\w+)\s*\(")
_BODY, _ARROW = re.compile(r"[^{;]*\{"), re.compile(r"[^{;=]*=>\s*\{")
_NO_CALL = frozenset("if for while switch catch return function func new typeof throw super def class else do try case await synchronized assert".split())
_DEFINITIONS = {
    ".js": re.compile(r"(?:^|(?<=[\n;{}]))[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?(?:(?P<f>function)\*?[ \t]+(?P<n>[\w$]+)[^(\n]*\(|(?P<c>class)[ \t]+(?P<m>[\w$]+)[^{;]*\{|(?:const|let|var)[ \t]+(?P<a>[\w$]+)(?:[ \t]*:[^=\n]+)?[ \t]*=[ \t]*(?:async[ \t]*)?\()"),
    ".go": re.compile(r"(?:^|(?<=\n))(?:(?P<f>func)[ \t]+(?:\([^)]*?\*?(?P<r>\w+)(?:\[[^\]]*\])?\)[ \t]*)?(?P<n>\w+)|(?P<c>type)[ \t]+(?P<m>\w+)[ \t]+(?:struct|interface))[^{\n]*\{"),
    ".java": re.compile(r"(?:^|(?<=[\n;{}]))[ \t]*(?:(?:public|private|protected|static|final|abstract|synchronized|default)[ \t]+)*(?:(?P<c>class|interface|enum|record)[ \t]+(?P<m>\w+)[^{;]*|(?:<[^>]+>[ \t]*)?[\w<>\[\], .?]+[ \t](?P<n>\w+)[ \t]*\([^()]*\)[^{;]*)\{"),
}
_DEFINITIONS[".ts"] = _DEFINITIONS[".js"]
_IMPORTS = {
    ".js": re.compile(r"(?:import\s[^'\";]*?from\s*|import\s*|require\s*\(\s*)['\"]([^'\"]+)['\"]"),
    ".go": re.compile(r"import\s+(?:[\w.]+\s+)?\"([^\"]+)\"|(?<=\n)\s*(?:[\w.]+\s+)?\"([\w./-]+)\"\s*(?=\n)"),
    ".java": re.compile(r"import\s+(?:static\s+)?([\w.*]+)\s*;"),
}
_IMPORTS[".ts"] = _IMPORTS[".js"]


def _python(text: str) -> Iterator[Row]:
    def dotted(n: ast.AST) -> str | None:
        if isinstance(n, ast.Name):
            return n.id
        if isinstance(n, ast.Attribute):
            base = dotted(n.value)
            return f"{base}.{n.attr}" if base else None
        return None

    stack: list[tuple[ast.AST, str | None]] = [(ast.parse(text), None)]
    while stack:
        at, owner = stack.pop()
        for n in ast.iter_child_nodes(at):
            inside = owner
            if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                inside = f"{owner}.{n.name}" if owner else n.name
                kind = "class" if isinstance(n, ast.ClassDef) else "method" if isinstance(at, ast.ClassDef) else "function"
                yield "symbol", inside, kind, n.lineno, n.end_lineno, None
            elif isinstance(n, ast.Import):
                for a in n.names:
                    yield "import", owner, "import", n.lineno, n.end_lineno, a.name
            elif isinstance(n, ast.ImportFrom):
                yield "import", owner, "import", n.lineno, n.end_lineno, "." * n.level + (n.module or "")
            elif isinstance(n, ast.Call) and (name := dotted(n.func)):
                yield "call", owner, "call", n.lineno, n.end_lineno, name
            stack.append((n, inside))


def _braces(text: str, ext: str) -> Iterator[Row]:
    # Comments and literals become spaces, so that places stay.
    text = text.replace("\r\n", "\n")
    code = _SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    line_of: list[int] = [0]
    line_of += [m.end() for m in re.finditer("\n", text)]

    def line(i: int) -> int:
        low, high = 0, len(line_of)
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if line_of[mid] <= i else (low, mid)
        return low + 1

    closes: dict[int, int] = {}
    opened: list[int] = []
    for m in _BRACKET.finditer(code):
        if m[0] in "({":
            opened.append(m.start())
        elif opened:
            closes[opened.pop()] = m.start()
    spans: list[tuple[int, int, str]] = []
    for m in _DEFINITIONS[ext].finditer(code):
        groups = m.groupdict()
        name = groups.get("n") or groups.get("m") or groups.get("a")
        if name in _NO_CALL:
            continue
        brace = m.end() - 1
        if code[brace] == "(":  # the body begins after the parameters, for arrows after the arrow
            body = (_ARROW if groups.get("a") else _BODY).match(code, closes.get(brace, len(code)) + 1)
            if body is None:
                continue
            brace = body.end() - 1
        begin = m.start() + len(m[0]) - len(m[0].lstrip())
        end = closes.get(brace, len(text) - 1)
        outer = [s for s in spans if s[0] < begin and end <= s[1]]
        owner = groups.get("r") or (outer[-1][2] if outer else None)
        qualname = f"{owner}.{name}" if owner else name
        kind = "class" if groups.get("c") else "method" if (groups.get("r") or (outer and ext == ".java")) else "function"
        spans.append((begin, end, qualname))
        yield "symbol", qualname, kind, line(begin), line(end), None
    for m in _IMPORTS[ext].finditer(text):
        yield "import", None, "import", line(m.start()), line(m.end() - 1), next(filter(None, m.groups()), None)
    heads = {s[0] for s in spans}
    at = 0
    live: list[tuple[int, int, str]] = []
    for m in _CALL.finditer(code):
        while at < len(spans) and spans[at][0] <= m.start():
            live.append(spans[at])
            at += 1
        while live and live[-1][1] < m.start():
            live.pop()
        before = code[max(0, m.start() - 12) : m.start()].split()
        if m[1] in _NO_CALL or (before and before[-1] in ("function", "func", "new")) or m.start() in heads or not live:
            continue
        if any(m[1] == s[2].rpartition(".")[2] and code.find("{", m.end()) >= 0 and s[0] <= m.start() < code.find("{", s[0]) for s in live[-1:]):
            continue
        yield "call", live[-1][2], "call", line(m.start()), line(m.start()), m[1]


def parse(ext: str, text: str | None) -> list[Row]:
    """(row_kind, qualname, kind, start_line, end_line, target) of a text: its symbols, imports and calls."""
    if not text:
        return []
    if ext == ".py":
        try:
            return list(_python(text))
        except (SyntaxError, ValueError, RecursionError):
            return []
    return list(_braces(text, ext)) if ext in _DEFINITIONS else []


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for repo, path, ext, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
            out += [(repo, path, *r) for r in parse(ext, text.as_py())]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 8, _SCHEMA, strict=True)], schema=_SCHEMA)


def parsed(source_files: DataFrame) -> DataFrame:
    """One row per symbol, import and call of each file; one pass, no shuffle."""
    ship(source_files.sparkSession)
    rows = source_files.where("path is not null").select("repository", canonical(F.col("path")).alias("path"), extension(F.col("path")).alias("ext"), "body")
    return rows.where(F.col("ext").isin(".py", *_DEFINITIONS)).mapInArrow(_run, FOUND)
