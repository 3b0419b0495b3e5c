"""Connected components of a graph held as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from insidertrail.llm.common import cut, discard


def _ends(links: DataFrame, *columns: str) -> DataFrame:
    """Both ends of every row of ``links`` (v, u) with the other one, under the names ``columns``."""
    pairs = F.array(*(F.struct(F.col(x).alias(columns[0]), y.alias(columns[1])) for x, y in (("v", F.col("u")), ("u", F.col("v")))))
    return links.select(F.explode(pairs).alias("e")).select("e.*")


def _all_stars(links: DataFrame) -> bool:
    """Whether each node of ``links`` (v, u; v > u) hangs from one node at most, which itself hangs from none."""
    hung = F.count_if(F.col("u") < F.col("v"))
    nodes = _ends(links, "v", "u").groupBy("v").agg(hung.alias("above"), F.count(F.lit(1)).alias("all"))
    return nodes.filter("above > 1 or above = 1 and all > 1").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reachable.

    Stars are re-hung in turn from large to small neighbours until only stars are left: each node's larger
    neighbours move to its smallest one, then its smaller ones do.  Both steps are a minimum per node,
    which adds up before the shuffle, and a join; no neighbourhood is ever gathered in one place.  The
    number of rounds grows with the logarithm of the longest path.  Each step is written to the shared
    folder, and deleted when the next one is.
    """
    links = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(),
                "cc-links")
    while not _all_stars(links):
        both = _ends(links, "v", "u")
        smallest = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        # Large star: every larger neighbour of v, and v itself, hangs from the smallest around v.
        moved = F.array(F.struct(F.greatest("u", "v").alias("v"), F.col("m").alias("u")), F.struct("v", F.col("m").alias("u")))
        large = cut(both.join(smallest, "v").select(F.explode(moved).alias("e")).select("e.*").filter("v > u").distinct(), "cc-large")
        # Small star: v and its smaller neighbours hang from the smallest of these.
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        moved = F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct("v", F.col("m").alias("u")))
        before, links = links, cut(large.join(low, "v").select(F.explode(moved).alias("e")).select("e.*").filter("v > u").distinct(),
                                   "cc-links")
        discard(before, large)
    return links.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
        links.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
