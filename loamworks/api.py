"""The operations on a repository by name, over tables that are already there.

``Repository`` holds the tables; each method gives a DataFrame, whose limits are parameters. ``invoke`` calls a method by its name with
checked arguments. Nothing is refreshed behind a query: :mod:`loamworks.sources.store` and the stream do that.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import checks
from .functions.paths import basename, dirname, extension, in_scope
from .operators import freshness, graph, search, spans
from .session import materialise

CODE = (".py", ".ts", ".js", ".go", ".java")


class Repository:
    """``files`` (path, text, digest, status), ``symbols`` (path, qualname, kind, start_line, end_line), ``edges`` (source, target, confidence) with
    nodes ``path::qualname``, and, if there are any, ``links`` (source, target) between documents and ``titles`` (path, title)."""

    def __init__(self, files: DataFrame, symbols: DataFrame, edges: DataFrame, links: DataFrame | None = None, titles: DataFrame | None = None) -> None:
        self.files, self.symbols, self.edges, self.links, self.titles = files, symbols, edges, links, titles
        self._index: DataFrame | None = None

    def index(self) -> DataFrame:
        """The search index, built once."""
        if self._index is None:
            chunks = search.chunk_windows(self.files).withColumn("symbol", F.lit(None).cast("string"))
            self._index = search.index(chunks.unionByName(search.symbol_windows(self.files, self.symbols)))
        return self._index

    @staticmethod
    def _in(path: Column, scopes: Sequence[str]) -> Column:
        return reduce(lambda a, s: a | in_scope(path, checks.scope(s)), scopes, F.lit(not scopes))

    def search(self, query: str, limit: int = 20, scopes: Sequence[str] = (), source_only: bool = False, documentation_only: bool = False) -> DataFrame:
        """(position, path, start_line, end_line, symbol, rank, title_match, reason), one row per file."""
        spark = self.files.sparkSession
        queries = spark.createDataFrame([(1, query)], "query_id int, query string")
        best = search.best_chunks(search.ranked_chunks(self.index(), queries)).where(self._in(F.col("path"), scopes))
        if source_only:
            best = best.where(extension(F.col("path")).isin(*CODE))
        if documentation_only:
            best = best.where(F.lower("path").rlike(r"\.mdx?$") & ~F.lower(basename(F.col("path"))).isin("index.md", "log.md"))
        titled = self.titles.where(F.lower("title") == query.strip().lower()).select("path").distinct().withColumn("title_match", F.lit(1)) if self.titles is not None else spark.createDataFrame([], "path string, title_match int")
        best = best.join(titled, "path", "left").withColumn("title_match", F.coalesce("title_match", F.lit(0)))
        # Without scopes of its own a search lets the top directories take turns.
        scope = F.lit(".") if scopes else F.regexp_extract("path", "^(?:packages/)?([^/]+)/", 1)
        found = materialise(search.balanced(best, scope, search.candidates(limit)), "found")
        rows = found.where(F.col("position") <= limit).select("query_id", "position", "path", "rank", F.lit("match").alias("reason"))
        if self.links is not None and not source_only:
            rows = search.linked(found, self.links, self.index(), limit)
        return rows.join(found.select("path", "start_line", "end_line", "symbol", "title_match"), "path", "left").select("position", "path", "start_line", "end_line", "symbol", "rank", F.coalesce("title_match", F.lit(0)).alias("title_match"), "reason")

    def file_api(self, path: str) -> DataFrame:
        return self.symbols.where(F.col("path") == path).orderBy("start_line", "qualname")

    def trace(self, symbol: str, direction: str = "callees", depth: int = 2, scopes: Sequence[str] = ()) -> DataFrame:
        """(source, target, confidence, depth); a bare name stands for every symbol of that name."""
        node = F.concat_ws("::", "path", "qualname")
        seeds = self.symbols.where((node == symbol) | (F.substring_index("qualname", ".", -1) == symbol) | (F.col("qualname") == symbol)).select(node.alias("node")).distinct()
        e = self.edges.where(self._in(F.substring_index("source", "::", 1), scopes))
        back = e.where("not (confidence <=> 'unresolved')").select(F.col("target").alias("source"), F.col("source").alias("target"), "confidence")
        depth = max(1, min(5, depth))
        down = graph.trace(seeds, e, depth)
        up = graph.trace(seeds, back, depth).select(F.col("target").alias("source"), F.col("source").alias("target"), "confidence", "depth")
        rows = {"callees": down, "callers": up}[direction] if direction != "both" else down.unionByName(up)
        return rows.groupBy("source", "target", "confidence").agg(F.min("depth").alias("depth"))

    def change_impact(self, paths: Sequence[str], depth: int = 2) -> DataFrame:
        """(seed, node, depth): what calls the symbols of the changed files."""
        node = F.concat_ws("::", "path", "qualname")
        seeds = self.symbols.where(F.col("path").isin(*paths)).select(node.alias("seed"), node.alias("node"))
        back = self.edges.where("not (confidence <=> 'unresolved')").select(F.col("target").alias("source"), F.col("source").alias("target"))
        return graph.walk(seeds, back, max(1, min(5, depth)), ("seed",)).where("depth > 0")

    def diff_impact(self, diffs: DataFrame, depth: int = 2) -> DataFrame:
        """The same for the symbols that the hunks of (path, diff) touch; seeds of rows outside of any symbol are all symbols of the file."""
        named = self.symbols.select("path", F.col("qualname").alias("symbol"), "start_line", "end_line")
        hit = spans.overlapping(spans.changed_ranges(diffs).select("path", "start", "count"), named, ["path"])
        gaps = hit.where("symbol is null").select("path").distinct().join(named.select("path", "symbol"), "path")
        seed = F.concat_ws("::", "path", "symbol")
        seeds = hit.where("symbol is not null").select("path", "symbol").unionByName(gaps).distinct().select(seed.alias("seed"), seed.alias("node"))
        back = self.edges.where("not (confidence <=> 'unresolved')").select(F.col("target").alias("source"), F.col("source").alias("target"))
        return graph.walk(seeds, back, max(1, min(5, depth)), ("seed",))

    def repository_map(self, limit: int = 200, scopes: Sequence[str] = ()) -> DataFrame:
        """Directories with their files, symbols, languages, hubs and the directories they call."""
        n = self.symbols.groupBy("path").agg(F.count("*").alias("symbol_count"))
        files = self.files.where(self._in(F.col("path"), scopes)).select(F.lit(".").alias("repository"), "path").distinct().join(n, "path", "left").withColumn("language", extension(F.col("path")))
        links = self.edges.select(F.lit(".").alias("repository"), F.substring_index("source", "::", 1).alias("source_path"), F.substring_index("target", "::", 1).alias("target_path"), "confidence")
        return graph.clusters(files, links).drop("repository").orderBy(F.col("symbols").desc(), F.col("files").desc(), "directory").limit(limit)

    def find_all(self, pattern: str, limit: int = 100, scopes: Sequence[str] = ()) -> DataFrame:
        """Matching lines with the symbol around them, those with the most callers first."""
        if len(pattern) > 256:
            raise ValueError("a pattern has at most 256 characters")
        named = self.symbols.select("path", F.concat_ws("::", "path", "qualname").alias("symbol"), "start_line", "end_line")
        hits = spans.enclosing(spans.find_lines(self.files.where(self._in(F.col("path"), scopes)), pattern, "path"), named, ["path"])
        callers = self.edges.where("not (confidence <=> 'unresolved')").select("source", "target").distinct().groupBy(F.col("target").alias("symbol")).agg(F.count("*").alias("callers"))
        return hits.join(callers, "symbol", "left").select("path", "line", "symbol", F.coalesce("callers", F.lit(0).cast("long")).alias("callers"), "text").orderBy(F.col("callers").desc(), "path", "line").limit(limit)

    def file_identities(self, paths: Sequence[str] = ()) -> DataFrame:
        return self.files.where(F.col("path").isin(*paths) if paths else F.lit(True)).select("path", "digest").distinct()

    def index_coverage(self, scopes: Sequence[str] = ()) -> DataFrame:
        n = self.files.where(self._in(F.col("path"), scopes)).agg(F.count("*").alias("total"), F.count_if(F.col("status").isin("failed", "partial", "unsupported")).alias("unavailable"))
        return n.withColumn("complete", F.col("unavailable") == 0)

    def changed_lines(self, diffs: DataFrame) -> DataFrame:
        return spans.changed_ranges(diffs)

    def check_knowledge(self, documents: DataFrame) -> DataFrame:
        """(node, component, degree) of documents (node) by the links between them."""
        links = self.links if self.links is not None else documents.sparkSession.createDataFrame([], "source string, target string")
        inside = graph.induced(links, documents)
        return graph.components(documents, inside).join(graph.degrees(documents, inside), "node")

    def owners_of(self, claims: DataFrame) -> DataFrame:
        return freshness.overlapping_owners(claims)

    def areas(self, paths: Sequence[str]) -> DataFrame:
        """Changed and calling files by directory."""
        e = self.edges.where("not (confidence <=> 'unresolved')")
        calling = e.where(F.substring_index("target", "::", 1).isin(*paths)).select(F.substring_index("source", "::", 1).alias("path"))
        changed = self.files.where(F.col("path").isin(*paths)).select("path")
        return changed.unionByName(calling).distinct().groupBy(dirname(F.col("path")).alias("directory")).agg(F.count("*").alias("files"))


_TEXTS = {"type": list, "default": [], "most": 20}
_DEPTH = {"type": int, "default": 2, "least": 1, "most": 5}
SCHEMAS: dict[str, dict[str, dict]] = {
    "search": {"query": {"type": str, "required": True, "least": 1}, "limit": {"type": int, "default": 20, "least": 0, "most": 1000}, "scopes": _TEXTS, "source_only": {"type": bool, "default": False}, "documentation_only": {"type": bool, "default": False}},
    "file_api": {"path": {"type": str, "required": True}}, "trace": {"symbol": {"type": str, "required": True}, "direction": {"type": str, "default": "callees", "options": ["callers", "callees", "both"]}, "depth": _DEPTH, "scopes": _TEXTS},
    "change_impact": {"paths": {"type": list, "required": True, "least": 1, "most": 100}, "depth": _DEPTH}, "repository_map": {"limit": {"type": int, "default": 200, "least": 1, "most": 1000}, "scopes": _TEXTS},
    "find_all": {"pattern": {"type": str, "required": True, "least": 1, "most": 256}, "limit": {"type": int, "default": 100, "least": 1, "most": 10_000}, "scopes": _TEXTS}, "file_identities": {"paths": {"type": list, "default": []}},
    "index_coverage": {"scopes": _TEXTS}, "areas": {"paths": {"type": list, "required": True, "least": 1, "most": 1000}},
}


def invoke(repository: Repository, operation: str, given: dict[str, Any]) -> DataFrame:
    """Calls an operation by its name with checked arguments."""
    if operation not in SCHEMAS:
        raise ValueError(f"there is no operation {operation}")
    return getattr(repository, operation)(**checks.arguments(given, SCHEMAS[operation]))
