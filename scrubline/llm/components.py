"""Connected components of an undirected edge table by alternating
large-star / small-star rounds (joins and grouped minima only): every
round is a shuffle, the number of rounds grows with the logarithm of the
longest chain, and a vertex with very many neighbours is aggregated
map-side, never gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import cut, drop_cut


def _stars(e: DataFrame) -> bool:
    """Whether every vertex hangs on one smaller vertex that hangs on none."""
    k = e.groupBy("u").agg(F.count("*").alias("n"))
    if not k.where("n > 1").isEmpty():
        return False
    return e.select("u").join(e.select(F.col("v").alias("u")), "u", "left_semi").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "cc") -> DataFrame:
    """Rows ``(id, component_id)`` for every vertex that has an edge;
    ``component_id`` is the smallest vertex reachable.

    Nulls and self-loops are ignored; repeated edges count once; an empty
    edge table gives an empty result.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = cut(e.where("u is not null and v is not null and u <> v").distinct(), name)  # u > v: each row points down
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour of u hangs on u's minimum
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = cut(large, name)
        # small star: u and its smaller neighbours hang on the smallest of them
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .unionByName(down.select("u", F.col("m").alias("v"))).distinct())
        nxt = cut(small, name)
        drop_cut(large)
        drop_cut(e)
        e = nxt
    roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component_id"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(roots)
