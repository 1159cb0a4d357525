"""Connected components by alternating large-star and small-star passes; nothing but a count reaches the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored


def apart(other: DataFrame, key: str) -> tuple[DataFrame, Column]:
    """Arguments of a join with `other`, an aggregate by its long column `key`, that shuffle both sides anew: so the join can split a hot key."""
    there = other.withColumnRenamed(key, "__there")
    return there, F.col(key).bitwiseXOR(F.lit(1)) == F.col("__there").bitwiseXOR(F.lit(1))


def _pass(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star pass over (a, b), a > b."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.join(*apart(least, "a")).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.union(low.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, most: int = 40) -> DataFrame:
    """(a, root) for every node of links (a, b) but the roots; root is the component's smallest node."""
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    last = None
    for _ in range(most):
        edges = stored(_pass(edges) if last else edges, "edges")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
        if now["n"] == 0 or tuple(now) == last:
            break
        last = tuple(now)
    else:
        raise RuntimeError("components have not settled")
    return edges.select("a", F.col("b").alias("root"))
