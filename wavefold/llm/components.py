"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavefold.llm.common import each_salt, materialise, salt, salts


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the least neighbour of u. A busy node's edges are dealt by salts, and m goes to each salt; partial minima come before the shuffle."""
    dealt = edges.withColumn("salt", salt("v"))
    least = dealt.groupBy("u").agg(F.min("v").alias("m"), salts())
    return dealt.join(least.select("u", "m", each_salt()), ["u", "salt"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Hangs every larger neighbour of a node on the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hangs a node and its smaller neighbours on the least of these; every edge leads from the larger end."""
    down = _with_least(edges).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return down.filter(F.col("u") != F.col("v")).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node either has one edge that leads from it, or only such that lead to it."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))).alias("e")).select("e.*")
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out > 1 OR out > 0 AND into > 0").isEmpty()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """A row (id, component) for each node that isn't the least of its component: component is the least id reachable by edges of any direction.

    Edges with a null end and loops are left out; repeated edges count once. Without edges there are no rows.
    """
    stars = materialise(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while not _are_stars(stars):
        stars = materialise(_small_star(_large_star(stars)), "edges")
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component"))
