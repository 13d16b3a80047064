"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.llm.common import stage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of ``links`` (two long columns, any direction): the smallest node it is linked to.

    Each round points the larger neighbours of a node, then the smaller ones, at its smallest neighbour.  Minima are taken
    by map-side aggregation, so no neighbour list is ever held; every round is written to the shared folder, where the
    lineage ends.  Rounds stop when a round changes no link.  An empty table gives an empty table.
    """
    edges = stage(links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v").distinct(), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        larger = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = larger.groupBy("u").agg(F.min("v").alias("m"))
        moved = larger.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = stage(moved.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "links")
        print_of = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(print_of) == seen:
            break
        seen = tuple(print_of)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
