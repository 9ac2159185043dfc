"""Sizes of frames before and after they are encoded, totals, and the estimates of the memory a frame takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.codec import READ_SIZE, RESERVE
from readloom.functions.packing import exception_bytes, packed_size, varint_size
from readloom.functions.records import canonical_bytes, has_exceptions


def length(column: str) -> Column:
    return F.length(column).cast("long")


def stream_bytes() -> tuple[Column, Column, Column]:
    """Bytes of a read in the raw streams of ids, sequences and qualities."""
    n, i, c = length("sequence"), length("id"), length("comment")
    odd = F.when(has_exceptions(), exception_bytes()).otherwise(1)
    return varint_size(i) + i + varint_size(c) + c, varint_size(n) + packed_size(n) + odd, varint_size(length("quality")) + length("quality")


def bound(n: Column) -> Column:
    """The most that zstd makes of n bytes."""
    small = F.lit(128 << 10).cast("long")
    return n + F.shiftright(n, 8) + F.when(n < small, F.shiftright(small - n, 11)).otherwise(0)


def measured(reads: DataFrame, *by: str) -> DataFrame:
    """records, bases, text_bytes, and raw_ids, raw_sequences, raw_qualities, of each group of reads as a frame."""
    ids, sequences, qualities = stream_bytes()
    count = varint_size(F.count("*"))
    return reads.groupBy(*by).agg(
        F.count("*").alias("records"),
        F.sum(length("sequence")).alias("bases"),
        F.sum(length("id") + length("comment") + length("sequence") + length("quality") + 4).alias("text_bytes"),
        (F.sum(ids) + count).alias("raw_ids"),
        (F.sum(sequences) + count).alias("raw_sequences"),
        (F.sum(qualities) + count).alias("raw_qualities"),
    )


def compress_peak() -> Column:
    """Over measured(). Texts count at their size, not at an allocator's capacity."""
    raw = [F.col(f"raw_{x}") for x in ("ids", "sequences", "qualities")]
    return F.lit(RESERVE) + 2 * READ_SIZE * F.col("records") + F.col("text_bytes") + sum((x + bound(x) for x in raw[1:]), raw[0] + bound(raw[0]))


def decompress_peak(records: str, raw: list[str], coded: list[str]) -> Column:
    total = F.lit(RESERVE) + 2 * READ_SIZE * F.col(records)
    for c in raw + coded:
        total = total + F.col(c)
    return total


def totals(frames: DataFrame, *by: str) -> DataFrame:
    """frame_count, record_count, total_bases, encoded_bytes of a frames table. With by, frames that agree in it count as one."""
    size = F.length("ids") + F.length("sequences") + F.length("qualities")
    return frames.agg((F.count_distinct(*by) if by else F.count("*")).alias("frame_count"), F.coalesce(F.sum("record_count"), F.lit(0)).alias("record_count"), F.coalesce(F.sum("total_bases"), F.lit(0)).alias("total_bases"), F.coalesce(F.sum(size.cast("long") + 72), F.lit(0)).alias("encoded_bytes"))


def logical_bytes(reads: DataFrame) -> DataFrame:
    return reads.agg(F.coalesce(F.sum(canonical_bytes()), F.lit(0)).alias("logical_bytes"))
