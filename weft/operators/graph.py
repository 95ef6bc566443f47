"""Walks over the graph by breadth-first search.

Each level is one join of the frontier with the edges and one anti-join with what has been reached; levels are written to
the shared folder. The walk gives every node with its least depth. (Enumerating simple paths, with a cap on their number,
gives the same least depths until the cap is met, and then a part of them; here the result is always whole.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft import model
from weft.plans.store import stored


def bfs(edges: DataFrame, root: int, depth: int, forward: bool, kind: int = model.CALLS) -> DataFrame:
    """(symbol_id, depth) of what is reached from root by 1 to depth steps, root itself left out."""
    spark = edges.sparkSession
    a, b = ("src", "dst") if forward else ("dst", "src")
    step = edges.filter((F.col("kind") == kind) & (F.col("src") != F.col("dst"))).select(F.col(a).alias("a"), F.col(b).alias("b"))
    reached = frontier = spark.createDataFrame([(root, 0)], "symbol_id long, depth long")
    for d in range(1, depth + 1):
        found = frontier.select(F.col("symbol_id").alias("a")).join(step, "a").select(F.col("b").alias("symbol_id")).distinct()
        frontier = stored(found.join(reached.select("symbol_id"), "symbol_id", "left_anti").select("symbol_id", F.lit(d).cast("long").alias("depth")), "frontier")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached.filter("depth > 0")


def first_edge(edges: DataFrame, found: DataFrame, forward: bool) -> DataFrame:
    """found with provenance and resolution of the edge by which the walk came: the most trusted, then the most resolved."""
    order = F.array(*[F.lit(model.PROVENANCES.index(p)) for p in model.TRUST])
    a, b = ("src", "dst") if forward else ("dst", "src")
    before = found.select(F.col("symbol_id").alias(a), (F.col("depth") + 1).alias("depth"))
    into = edges.filter(F.col("kind") == model.CALLS).join(before, a).select(F.col(b).alias("symbol_id"), "depth", "provenance", "resolution")
    best = into.groupBy("symbol_id", "depth").agg(F.min(F.struct(F.array_position(order, F.col("provenance").cast("int")).alias("t"), "resolution", "provenance")).alias("e"))
    return found.join(best, ["symbol_id", "depth"], "left").select("symbol_id", "depth", "e.provenance", "e.resolution")


def walk(edges: DataFrame, symbols: DataFrame, files: DataFrame, root: int, depth: int, limit: int, forward: bool) -> DataFrame:
    """Callees (forward) or callers of root: symbol, file, depth and edge, ordered by depth, name path, id."""
    found = stored(bfs(edges, root, depth, forward), "walk")
    start = edges.sparkSession.createDataFrame([(root, 0)], "symbol_id long, depth long")
    told = first_edge(edges, found.unionByName(start), forward).filter("depth > 0")
    return hits(told.join(symbols, "symbol_id"), files, "depth", "provenance", "resolution").orderBy("depth", "name_path", "symbol_id").limit(limit)


def hits(symbols: DataFrame, files: DataFrame, *more: str) -> DataFrame:
    """The columns of a hit: id, name path, file, lines, kind."""
    return symbols.join(files.select("file_id", F.col("path").alias("file")), "file_id").select("symbol_id", "name_path", "file", F.col("start_line").alias("line"), "end_line", "kind", *more)


def trace_roots(edges: DataFrame, symbols: DataFrame, files: DataFrame, start: int, depth: int = 6, limit: int = 40) -> DataFrame:
    """Ancestors of start (the first 1,000 by depth and name path) that nothing calls, not even themselves."""
    above = walk(edges, symbols, files, start, depth, model.WALK_NODES, False)
    called = edges.filter(F.col("kind") == model.CALLS).select(F.col("dst").alias("symbol_id"))
    return above.join(called, "symbol_id", "left_anti").orderBy("depth", "name_path", "symbol_id").limit(limit)


def subgraph(edges: DataFrame, symbols: DataFrame, files: DataFrame, root: int, depth: int = 2, forward: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): at most 1,000 reached symbols and root; all Calls edges with both ends among them."""
    near = walk(edges, symbols, files, root, depth, model.WALK_NODES, forward).select("symbol_id")
    nodes = stored(near.unionByName(edges.sparkSession.createDataFrame([(root,)], "symbol_id long")).distinct(), "nodes")
    named = nodes.join(symbols.select("symbol_id", "name_path"), "symbol_id").orderBy("symbol_id")
    inner = edges.filter(F.col("kind") == model.CALLS).join(nodes.select(F.col("symbol_id").alias("src")), "src", "left_semi").join(nodes.select(F.col("symbol_id").alias("dst")), "dst", "left_semi")
    return named, inner.select("src", "dst", "provenance", "resolution").orderBy("src", "dst")


def traverse(edges: DataFrame, root: int, kind: int, depth: int, limit: int, forward: bool = True) -> DataFrame:
    """(symbol_id, depth) along edges of any kind, ordered by depth and id."""
    return bfs(edges, root, depth, forward, kind).orderBy("depth", "symbol_id").limit(limit)


def running(cost: Column, order: list[str]) -> Column:
    """Sum of the costs of a row and those before it. Over a query's limited rows only."""
    return F.sum(cost).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
