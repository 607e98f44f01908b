"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.operators.staging import drop_staged, staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """(id, component) for each end of ``edges`` (a, b) but the components' own least ids,
    as a staged table and its path. Rounds go on until the edges are stars around the least
    ids: the count and the sums of both columns then stay as they are."""
    spark, path, seen = edges.sparkSession, None, None
    edges = edges.filter("a <> b")
    while True:
        edges, new = staged(_small_star(_large_star(edges)), "components")
        if path:
            drop_staged(spark, path)
        path = new
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")), path
        seen = now
