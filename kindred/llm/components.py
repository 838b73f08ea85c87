"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


#: Parts into which the neighbours of a node are dealt.
SALTS = 8


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Link neighbours (greater ones; of a small star lesser ones too) to the least of a node's neighbours.

    Only the least neighbour is aggregated per node, so a node with any number of neighbours is
    one row after partial aggregation; the join on it is salted, so its neighbours are dealt out.
    """
    both = edges.select("a", "b")
    if not small:
        both = both.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    salt = F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("s")
    copies = least.select("a", "m", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("s"))
    joined = both.select("a", "b", salt).join(copies, ["a", "s"]).drop("s")
    if small:
        linked = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    else:
        linked = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that can be reached, for every node of edges (a, b).

    Each round writes its edges to the shared folder; the rounds end when nothing changes, after
    about the logarithm of the longest path.  No edges give no rows.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
        before, now = now, stored(_star(_star(now, small=False), small=True))
        drop_stored(before)
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.union(roots)
