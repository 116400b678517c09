"""Connected components of a table of edges, by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stash


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each node on its least neighbour: the larger ones, or the node and the smaller ones.

    The written table of edges is replaced by the one returned."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # The minimum is written before the join: a node with very many neighbours is then split by adaptive execution.
    least = stash(near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "stars")
    joined = near.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    out = stash(out.filter("a <> b").distinct(), "edges")
    release(edges, least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component for every node of an edge (columns a, b of long)."""
    edges = stash(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    before = None
    while True:
        edges = _star(_star(edges, True), False)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        before = now
