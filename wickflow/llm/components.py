"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickflow.llm.common import checkpoint


#: Up to so many links are one partition, in which aggregations and joins need no shuffle.
FEW = 100_000


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _together(edges: DataFrame, few: bool) -> DataFrame:
    return edges.coalesce(1) if few else edges


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    """Each vertex hangs its larger neighbours on its smallest neighbour or itself."""
    both = _together(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), few)
    lowest = _lowest(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    """Each vertex hangs itself and its smaller neighbours on the smallest of them."""
    lowest = _lowest(edges)
    hung = edges.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _together(hung.union(lowest.select("u", F.col("m").alias("v"))), few).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """links: columns u, v (long, no nulls). Returns (node, component), where component is the smallest node reachable.

    Loops and repeated links are ignored; an empty table gives an empty table. A round costs two
    aggregations and two joins on the links; rounds grow with the logarithm of the component size.
    Minima are aggregated before any join, so that a hub's links meet one row of the other side. Few links (a checked
    number) stay in one task; more of them are dealt out.
    """
    edges = checkpoint(
        links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    few = edges.count() <= FEW
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first()
        if now == seen or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = now
        edges = checkpoint(_small_star(_large_star(edges, few), few))
