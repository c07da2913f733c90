"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridemill.session import stage


def _points_down(rows: DataFrame) -> DataFrame:
    """Links as (a, b) with a > b, each once."""
    return rows.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()


def _step(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star: nodes move to the smallest node they know of."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
    large = (
        both.join(lowest, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    )
    large = _points_down(large)
    lowest = large.groupBy("a").agg(F.min("b").alias("low"))
    small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return _points_down(small.unionByName(lowest.withColumnRenamed("low", "b")))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component`` (its smallest node) for every node that has a link.

    Alternating large and small stars: the number of rounds grows with the
    logarithm of the longest chain, and no round sees more rows than there are
    links. Every round is a written table, so a lost executor costs one round.
    Nodes are integers; links of a node with itself and nulls are left out.
    """
    edges = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).dropna()
    edges = stage(_points_down(edges), "links")

    def mark(table: DataFrame):
        return tuple(table.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    seen = mark(edges)
    while seen[0]:
        edges = stage(_step(edges), "links")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
