"""Walks, components, cycles and coupling over edges (source, target).

Each walk is a loop of joins between the newest nodes and the edges, with an anti-join against those reached before; each round is
written to the shared folder, so that no plan grows with the depth. Nothing is collected but whether a round found anything.

Defined results: null ends are no edges; repeated edges count once; loops don't make a node its own neighbour; empty tables give
no rows; a node reached in several ways has its least depth.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import dirname
from ..session import materialise


def clean(edges: DataFrame, *more: str) -> DataFrame:
    return edges.where("source is not null and target is not null").select("source", "target", *more).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, without loops."""
    e = edges.where("source is not null and target is not null and source != target")
    return e.select("source", "target").unionByName(e.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()


def walk(seeds: DataFrame, edges: DataFrame, depth: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, node, depth) of all nodes that a walk along the edges reaches from ``seeds`` (keep, node); seeds have depth 0.

    ``keep`` names columns that tell walks apart, such as the seed they began at: one pass serves all of them.
    """
    edges = materialise(clean(edges), "edges")
    id_ = [*keep, "node"]
    reached = [materialise(seeds.where("node is not null").select(*id_).distinct().withColumn("depth", F.lit(0)), "walk")]
    while len(reached) <= depth:
        new = reached[-1].withColumnRenamed("node", "source").join(edges, "source").select(*keep, F.col("target").alias("node")).distinct()
        seen = reduce(DataFrame.unionByName, reached)
        new = materialise(new.join(seen.select(*id_), id_, "left_anti").withColumn("depth", F.lit(len(reached))), "walk")
        if new.isEmpty():
            break
        reached.append(new)
    return reduce(DataFrame.unionByName, reached)


def trace(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(source, target, confidence, depth) of the edges met by a walk; unresolved ones are reported, but never followed."""
    edges = materialise(clean(edges, "confidence"), "edges")
    nodes = walk(seeds, edges.where("not (confidence <=> 'unresolved')"), depth - 1)
    return nodes.withColumnRenamed("node", "source").join(edges, "source").select("source", "target", "confidence", (F.col("depth") + 1).alias("depth"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each connected component.

    Least labels pass along the edges, and every label is replaced by its own label, which halves the way left: the number of rounds
    grows with the logarithm of the longest way.
    """
    both = materialise(undirected(edges), "edges")
    names = nodes.where("node is not null").select("node").unionByName(both.select(F.col("source").alias("node"))).distinct()
    labels = materialise(names.select("node", F.col("node").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "target"), "target").groupBy(F.col("source").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("component").alias("before"), F.least("component", F.coalesce("near", "component")).alias("component"))
        step = materialise(step, "labels")
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("further"))
        after = step.join(jump, "component").select("node", "before", F.least("component", "further").alias("component"))
        after = materialise(after, "labels")
        labels = after.select("node", "component")
        if after.where("component != before").isEmpty():
            return labels


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, degree): how many other nodes it has an edge with."""
    d = undirected(edges).groupBy(F.col("source").alias("node")).agg(F.count("*").alias("degree"))
    return nodes.where("node is not null").select("node").distinct().join(d, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    return clean(edges).join(nodes.select(F.col("node").alias("source")).distinct(), "source", "left_semi").join(nodes.select(F.col("node").alias("target")).distinct(), "target", "left_semi").select("source", "target")


def cycle_nodes(edges: DataFrame, hops: int) -> DataFrame:
    """(node, length): nodes that reach themselves in at most ``hops`` steps, and the fewest steps.

    Nodes without an edge in or out lie on no cycle; they are taken away round by round before walks begin.
    """
    left = materialise(clean(edges), "edges")
    while True:
        kept = left.join(left.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(left.select(F.col("source").alias("target")).distinct(), "target", "left_semi")
        kept = materialise(kept.select("source", "target"), "edges")
        if kept.count() == left.count():
            break
        left = kept
    steps = [materialise(left.select(F.col("source").alias("origin"), F.col("target").alias("node"), F.lit(1).alias("length")), "cycles")]
    while len(steps) < hops:
        new = steps[-1].where("origin != node").join(left.withColumnRenamed("source", "node"), "node").select("origin", F.col("target").alias("node")).distinct()
        seen = reduce(DataFrame.unionByName, steps).select("origin", "node")
        new = materialise(new.join(seen, ["origin", "node"], "left_anti").withColumn("length", F.lit(len(steps) + 1)), "cycles")
        if new.isEmpty():
            break
        steps.append(new)
    return reduce(DataFrame.unionByName, steps).where("origin = node").groupBy("node").agg(F.min("length").alias("length"))


def coupling(files: DataFrame, links: DataFrame) -> DataFrame:
    """Per file (repository, path): how many other files' symbols call it, and the other way round; only sure links between known files count.

    ``files`` (repository, path, ...), ``links`` (repository, source_path, target_path, confidence). Pairs of files are made distinct
    before they are counted, so that a hot file is one row per caller.
    """
    known = files.select("repository", "path").distinct()
    sure = links.where("confidence = 'high' and source_path != target_path").select("repository", "source_path", "target_path").distinct()
    sure = sure.join(known.withColumnRenamed("path", "source_path"), ["repository", "source_path"], "left_semi").join(known.withColumnRenamed("path", "target_path"), ["repository", "target_path"], "left_semi")
    ends = sure.select("repository", F.explode(F.array(F.struct(F.col("source_path").alias("path"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target_path").alias("path"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    n = ends.groupBy("repository", "e.path").agg(F.sum("e.i").alias("incoming_files"), F.sum("e.o").alias("outgoing_files"))
    zero = F.lit(0).cast("long")
    out = files.join(n, ["repository", "path"], "left").withColumns({c: F.coalesce(c, zero) for c in ("incoming_files", "outgoing_files")})
    return out.withColumn("coupling", F.col("incoming_files") + F.col("outgoing_files"))


def clusters(files: DataFrame, links: DataFrame, hubs: int = 3) -> DataFrame:
    """Per directory: files, symbols, languages, the files with the most coupling, and the directories that its files call.

    The hubs are found by a window that keeps ``hubs`` rows before the shuffle; no directory is collected.
    """
    each = coupling(files, links).withColumn("directory", dirname(F.col("path")))
    sums = each.groupBy("repository", "directory").agg(F.count("*").alias("files"), F.sum(F.coalesce("symbol_count", F.lit(0))).cast("long").alias("symbols"), F.array_join(F.sort_array(F.collect_set("language")), ",").alias("languages"))
    w = Window.partitionBy("repository", "directory").orderBy(F.col("coupling").desc(), F.coalesce("symbol_count", F.lit(0)).desc(), "path")
    best = each.withColumn("r", F.row_number().over(w)).where(F.col("r") <= hubs).groupBy("repository", "directory").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "path"))), lambda x: x["path"]), ",").alias("hubs"))
    known = files.select("repository", "path").distinct()
    sure = links.where("confidence = 'high'").select("repository", "source_path", "target_path").distinct()
    sure = sure.join(known.withColumnRenamed("path", "source_path"), ["repository", "source_path"], "left_semi").join(known.withColumnRenamed("path", "target_path"), ["repository", "target_path"], "left_semi")
    out = sure.select("repository", dirname(F.col("source_path")).alias("directory"), dirname(F.col("target_path")).alias("other")).where("directory != other").distinct().groupBy("repository", "directory").agg(F.count("*").alias("outgoing_directories"))
    return sums.join(best, ["repository", "directory"]).join(out, ["repository", "directory"], "left").withColumn("outgoing_directories", F.coalesce("outgoing_directories", F.lit(0).cast("long")))


def ancestors(path: Column) -> Column:
    """The directories above a path, nearest last; the root is left out."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))


def layers(edges: DataFrame) -> DataFrame:
    """(node, layer) in an order of work: layer 0 depends on nothing, each later one only on earlier ones.

    ``edges`` point from what depends to what it depends on. Nodes in a circle, or that depend on one, have a null layer.
    """
    e = materialise(clean(edges), "edges")
    nodes = e.select(F.col("source").alias("node")).unionByName(e.select(F.col("target").alias("node"))).distinct()
    left, done, n = materialise(nodes, "nodes"), [], 0
    while True:
        waiting = e.join(left.withColumnRenamed("node", "target"), "target", "left_semi").select(F.col("source").alias("node")).distinct()
        free = materialise(left.join(waiting, "node", "left_anti").withColumn("layer", F.lit(n)), "layer")
        if free.isEmpty():
            return reduce(DataFrame.unionByName, [*done, left.withColumn("layer", F.lit(None).cast("int"))])
        done.append(free)
        left, n = materialise(left.join(free.select("node"), "node", "left_anti"), "nodes", replaces=[left]), n + 1


def nearest_above(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """``paths`` (repository, path) with the nearest of ``roots`` (repository, root) among the directories above, ``.`` if there is none."""
    above = paths.select("repository", "path", F.explode(ancestors(F.col("path"))).alias("root"))
    held = above.join(roots.distinct(), ["repository", "root"]).groupBy("repository", "path").agg(F.max_by("root", F.length("root")).alias("root"))
    return paths.join(held, ["repository", "path"], "left").withColumn("root", F.coalesce("root", F.lit(".")))
