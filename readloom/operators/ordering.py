"""Order given back to work that came out of order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ordinals(df: DataFrame, key: str, width: int = 1 << 16) -> DataFrame:
    """df with ordinal: 0, 1, 2 ... by an integer key. Rows are ranked in buckets of keys, which a task each can hold, behind the counts of earlier buckets."""
    bucket = F.floor(F.col(key) / width).alias("__bucket")
    earlier = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # over buckets, not rows
    before = df.groupBy(bucket).agg(F.count("*").alias("__n")).select("__bucket", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy(key)) - 1
    return df.withColumn("__bucket", bucket).withColumn("__place", place.cast("long")).join(before, "__bucket").withColumn("ordinal", F.col("__before") + F.col("__place")).drop("__bucket", "__place", "__before")


def committed(items: DataFrame, *order: str) -> DataFrame:
    """items once each by the columns of order, the first of duplicates, in partitions sorted by range."""
    return items.dropDuplicates(list(order)).repartitionByRange(*order).sortWithinPartitions(*order)


def contiguous(items: DataFrame, column: str = "frame_id") -> DataFrame:
    """first, last, n, gaps: whether column runs 0, 1, 2 ... without a gap, from sums that no order is needed for."""
    x = F.col(column)
    return items.agg(F.coalesce(F.min(x), F.lit(0)).alias("first"), F.coalesce(F.max(x), F.lit(-1)).alias("last"), F.count_distinct(x).alias("n")).withColumn("gaps", F.col("last") + 1 - F.col("n"))


def complete_chunks(items: DataFrame, expected: DataFrame) -> DataFrame:
    """chunk, n, expected, complete: a chunk is complete when all that its marker promised is there. expected: chunk, expected."""
    got = items.groupBy("chunk").agg(F.count_distinct("local").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return expected.join(got, "chunk", "left").select("chunk", n.alias("n"), "expected", (n == F.col("expected")).alias("complete"))


def out_of_place(frames: DataFrame, *by: str) -> DataFrame:
    """frames with expected_id and in_place, by the order of position in each group."""
    w = Window.partitionBy(*by).orderBy("position")
    return frames.withColumn("expected_id", (F.row_number().over(w) - 1).cast("long")).withColumn("in_place", F.col("expected_id") == F.col("frame_id"))
