"""Pairs by position: R1 and R2 zipped on their ordinal, and interleaved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("id", "comment", "sequence", "quality")


def zipped(one: DataFrame, two: DataFrame, *, strict: bool = True) -> DataFrame:
    """ordinal, first, second. Ids are not compared. Strict: an input longer than the other ends the job with an error."""
    pack = lambda df, name: df.select("ordinal", F.struct(*COLUMNS).alias(name))
    out = pack(one, "first").join(pack(two, "second"), "ordinal", "full_outer")
    if not strict:
        return out
    lone = F.col("first").isNull() | F.col("second").isNull()
    return out.filter(F.when(lone, F.raise_error(F.lit("EngineError: format error: paired inputs have different record counts")).cast("boolean")).otherwise(True))


def counts_differ(one: DataFrame, two: DataFrame) -> DataFrame:
    """r1_only, r2_only: how many records have no mate."""
    z = zipped(one, two, strict=False)
    return z.agg(F.count_if(F.col("second").isNull()).alias("r1_only"), F.count_if(F.col("first").isNull()).alias("r2_only"))


def interleaved(one: DataFrame, two: DataFrame) -> DataFrame:
    """R1, R2, R1, R2: pair_ordinal, mate, and ordinal over both."""
    side = lambda df, mate: df.select(F.col("ordinal").alias("pair_ordinal"), F.lit(mate).alias("mate"), (2 * F.col("ordinal") + mate - 1).alias("ordinal"), *COLUMNS)
    return side(one, 1).unionByName(side(two, 2))
