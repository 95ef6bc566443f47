"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import removed, stored


def large_star(e: DataFrame) -> DataFrame:
    """Each vertex hands its larger neighbours to the least vertex that it sees."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(e: DataFrame) -> DataFrame:
    """Each vertex hands its smaller neighbours, and itself, to the least of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(u, m): the least vertex m of the component of every vertex u that isn't m itself. links: (u, v), in either order.

    Every step is written to the shared folder, so lineage stays short and a lost executor costs one step at most. A
    round only groups by vertex (minimum, combined before the shuffle) and joins its links with the one row of that minimum;
    where a vertex has very many links, adaptive execution splits its side of the join. No links give no rows; self-links
    and repeated links don't matter.
    """
    e = stored(links.select("u", "v").filter("u <> v").distinct(), "links")
    mark = None
    for _ in range(most):
        n = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if n[0] == 0 or n == mark:
            return e.select("u", F.col("v").alias("m"))
        mark, old = n, e
        e = stored(small_star(large_star(e)), "links")
        removed(e.sparkSession, old.inputFiles()[0].rsplit("/", 1)[0])
    raise RuntimeError(f"components did not settle in {most} rounds")
