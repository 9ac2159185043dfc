"""Connected components of links, by rounds of min-label stars.

A round hangs every neighbour of a node, and the node, on the least of them, first for greater neighbours, then for
lesser ones. Links only ever move; when a round changes none, all hang on the least node they reach. Minima are
summed before they move, and the join that hands them out is one whose large partitions Spark splits, so a node
with very many links is no task's alone. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def star(links: DataFrame, large: bool) -> DataFrame:
    """links a > b as (a, b), after one half of a round."""
    if large:  # of each node: greater neighbours hang on the least neighbour or the node
        seen = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = seen.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        return seen.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
    low = links.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    rest = links.withColumnRenamed("a", "u").join(low, "u").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root: of every node in a link, the least node of its component. links: a, b, any longs but null."""
    now = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    sign = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = sign(now)
    while before[0]:
        now = stored(star(star(now, True), False))
        if (after := sign(now)) == before:
            break
        before = after
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
