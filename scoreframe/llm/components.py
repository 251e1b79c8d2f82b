"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreframe.llm.common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every vertex of the edges (a, b); the component is its smallest vertex.

    Each step replaces edges by edges to smaller vertices until every vertex points at its component's smallest, which the
    minima that a step begins with tell: no vertex then has two smaller neighbours, or both smaller and larger ones. A
    vertex with very many neighbours only passes through aggregations and joins that Spark splits, never through a list:
    the minima are written first, so that both sides of each join are plain shuffles. The edges are read several times.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smaller = F.when(F.col("b") < F.col("a"), F.col("b"))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.max(smaller).alias("s"), F.max("b").alias("g"))
        moves = F.col("s").isNotNull() & ((F.col("m") < F.col("s")) | (F.col("g") > F.col("a")))
        low = materialize(low.select(F.col("a").alias("u"), F.least("a", "m").alias("m"), moves.alias("moves")), "low")
        if low.where("moves").isEmpty():
            return low.select(F.col("u").alias("id"), F.col("m").alias("component"))
        large = both.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, "edges")
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u"), "low")
        small = large.join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = materialize(small.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
