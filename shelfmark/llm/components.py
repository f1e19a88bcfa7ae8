"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.plans.durable import discard, keep


def _pairs(df: DataFrame) -> DataFrame:
    return df.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hangs its larger neighbours on the smallest of its neighbours and itself."""
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(
        edges.select(F.col("v").alias("x"), F.col("u").alias("y"))
    )
    least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("m", "x").alias("m"))
    return _pairs(both.join(least, "x").where("y > x").select(F.col("y").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hangs its smaller neighbours and itself on the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return _pairs(hung.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))))


def components(links: DataFrame) -> DataFrame:
    """(node, component_id) of all nodes in ``links`` (a, b); component_id is the smallest node of the component.

    Each round is two joins of the links with one row per node, whose minima are taken on the map side; skewed nodes are
    split by the adaptive join. Rounds are written to the shared folder and end when a round changes nothing;
    their number grows with the logarithm of the longest chain.
    """
    edges = keep(_pairs(links), "edges")
    before = None
    while True:
        nxt = keep(_small_star(_large_star(edges)), "edges")
        after = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(edges)
        edges = nxt
        if after == before:
            break
        before = after
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component_id"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct())
