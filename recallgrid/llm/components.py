"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is two joins and grouped minima over edges; nothing is collected but one count and checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return linked.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """id, component of each id in edges(a long, b long): the smallest id reachable. Loops and repeats are harmless.

    edges are read once. A round's table is removed when the next one is written.
    """
    now = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = mark(now)
    while seen[0]:
        now = stored(_small_star(_large_star(now)), "edges", replaces=now)
        before, seen = seen, mark(now)
        if before == seen:
            break
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
