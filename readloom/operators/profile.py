"""What platform reads come from: votes of a sample, then a cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.records import is_clr, is_hifi, is_insdc, is_ont, record_length

SAMPLE_RECORDS = 50_000
SHORT_MAX, SHORT_MEAN = 1000, 500


def sample_prefix(reads: DataFrame, bases: int, records: int = SAMPLE_RECORDS, order: str = "ordinal", pairs: str | None = None) -> DataFrame:
    """Reads in order until there are so many, or until so many bases came before. order: 0, 1, 2 ...; pairs: a column that two mates share, taken whole.

    Only the first records rows by order are ever looked at, so the one task that sums them up is bounded.
    """
    place = F.col(pairs or order)
    head = reads.filter(F.col(order) < records)
    sums = Window.orderBy(place).rangeBetween(Window.unboundedPreceding, -1)
    return head.withColumn("bases_before", F.coalesce(F.sum(record_length()).over(sums), F.lit(0))).filter(F.col("bases_before") < bases)


def votes(reads: DataFrame, *by: str) -> DataFrame:
    """records, bases, longest, and how many records each platform's marks are on; by group if asked."""
    n = record_length()
    return reads.groupBy(*by).agg(
        F.count("*").alias("records"),
        F.coalesce(F.sum(n), F.lit(0)).alias("bases"),
        F.coalesce(F.max(n), F.lit(0)).cast("long").alias("longest"),
        *[F.count_if(mark).alias(name) for name, mark in (("hifi", is_hifi()), ("ont", is_ont()), ("clr", is_clr()), ("insdc", is_insdc()))],
    )


def decision() -> Column:
    """The platform by votes(); null if it can't be told."""
    most = F.floor((F.col("records") + 1) / 2)
    return (
        F.when(F.col("records") == 0, "illumina")
        .when(F.col("hifi") >= most, "pacbio-hifi")
        .when(F.col("ont") >= most, "ont")
        .when(F.col("clr") >= most, "pacbio-clr")
        .when((F.col("longest") <= SHORT_MAX) & (F.floor(F.col("bases") / F.greatest("records", F.lit(1))) <= SHORT_MEAN), "illumina")
        .when(F.col("insdc") >= most, "ont")
    )


def profile(reads: DataFrame, *by: str) -> DataFrame:
    return votes(reads, *by).withColumn("profile", decision())
