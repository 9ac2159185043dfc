"""Greedy framing of ordered reads: a frame closes with the read that takes its cost to the target.

Where a frame ends depends on where all before it ended, so a chunk is folded in order; chunks do not depend on each
other. Encoding is part of the same pass: reads go in, compressed frames come out, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.codec import DEFAULT_MEMORY, READ_SIZE, Frame, Read, decode_frame, encode_frame
from readloom.functions.records import framing_cost

TARGET = 64 << 20
FRAME_SCHEMA = "chunk int, local bigint, record_count bigint, total_bases bigint, raw_ids_size bigint, ids binary, raw_sequences_size bigint, sequences binary, raw_qualities_size bigint, qualities binary, checksum bigint"
FRAME_ARROW = pa.schema([("chunk", pa.int32()), ("local", pa.int64()), ("record_count", pa.int64()), ("total_bases", pa.int64()), *(x for s in ("ids", "sequences", "qualities") for x in ((f"raw_{s}_size", pa.int64()), (s, pa.binary()))), ("checksum", pa.int64())])


class Accumulator:
    """Closes a frame when its cost reaches the target; in pairs, only after a second mate."""

    def __init__(self, target: int, paired: bool = False):
        self.target, self.paired, self.cost, self.count = target, paired, 0, 0

    def closes(self, cost: int) -> bool:
        """Takes a read of this cost in; whether the frame ends with it."""
        self.cost += cost
        self.count += 1
        if self.cost < self.target or self.paired and self.count % 2:
            return False
        self.cost = self.count = 0
        return True


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def frame_row(chunk: int, local: int, f: Frame) -> pa.RecordBatch:
    row = [chunk, local, f.records, f.bases, *(x for r, s in zip(f.raw, f.streams, strict=True) for x in (r, s)), signed(f.checksum)]
    return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(row, FRAME_ARROW, strict=True)], schema=FRAME_ARROW)


def encoded(blocks: Iterator[tuple[int, list[Read]]], *, target: int = TARGET, paired: bool = False, level: int = 1, memory: int = DEFAULT_MEMORY) -> Iterator[pa.RecordBatch]:
    """The frames of blocks of reads, each with its chunk; a chunk's blocks follow one another."""
    held: list[Read] = []
    chunk, local, acc = None, 0, Accumulator(target, paired)
    frame = lambda: frame_row(chunk, local, encode_frame(held, paired=paired, level=level, memory=memory))
    for at, reads in blocks:
        if at != chunk:
            if held:
                yield frame()
            held, chunk, local, acc = [], at, 0, Accumulator(target, paired)
        begin = 0
        for end, (name, comment, sequence, _) in enumerate(reads, 1):
            if acc.closes(READ_SIZE + 4 + len(name) + len(comment) + 2 * len(sequence)):
                held += reads[begin:end]
                yield frame()
                held, local, begin = [], local + 1, end
        held += reads[begin:]
    if held:
        yield frame()


def encode(reads: DataFrame, *, target: int = TARGET, paired: bool = False, level: int = 1, memory: int = DEFAULT_MEMORY) -> DataFrame:
    """Compressed frames of reads. Each partition must hold whole chunks in order, as the fastq source gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[tuple[int, list[Read]]]:
            for batch in batches:
                texts = [[x.encode("latin-1") for x in batch.column(k).to_pylist()] for k in range(1, 5)]
                for chunk, rows in groupby(zip(batch.column(0).to_pylist(), *texts, strict=True), itemgetter(0)):
                    yield chunk, [r[1:] for r in rows]

        return encoded(blocks(), target=target, paired=paired, level=level, memory=memory)

    return reads.select("chunk", "id", "comment", "sequence", "quality").mapInArrow(run, FRAME_SCHEMA)


def decode(frames: DataFrame) -> DataFrame:
    """The reads of frames, with the columns chunk, local, place. Hashes are checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                f = Frame(r["record_count"], r["total_bases"], (r["raw_ids_size"], r["raw_sequences_size"], r["raw_qualities_size"]), (r["ids"], r["sequences"], r["qualities"]), r["checksum"] & (1 << 64) - 1)
                got = decode_frame(f)
                n = len(got)
                text = [pa.array([x.decode("latin-1") for x in col], pa.string()) for col in zip(*got, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r["chunk"]] * n, pa.int32()), pa.array([r["local"]] * n, pa.int64()), pa.array(range(n), pa.int64()), *text], names=["chunk", "local", "place", "id", "comment", "sequence", "quality"])

    return frames.select(*FRAME_ARROW.names).mapInArrow(run, "chunk int, local bigint, place bigint, id string, comment string, sequence string, quality string")


def assign(reads: DataFrame, *, target: int, paired: bool = False, key: str = "ordinal", chunk: str | None = None) -> DataFrame:
    """key, chunk, frame of each read in the order of key, frames counted in each chunk. Only keys and costs move, a chunk to a task."""
    rows = reads.select(F.col(key).cast("long").alias("key"), (F.col(chunk) if chunk else F.lit(0)).cast("long").alias("chunk"), framing_cost().alias("cost"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, frame, acc = None, 0, Accumulator(target, paired)
        for batch in batches:
            frames = []
            for at, cost in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if at != now:
                    now, frame, acc = at, 0, Accumulator(target, paired)
                frames.append(frame)
                frame += acc.closes(cost)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(frames, pa.int64())], names=["key", "chunk", "frame"])

    return rows.repartition("chunk").sortWithinPartitions("chunk", "key").mapInArrow(run, "key long, chunk long, frame long")


def numbered(frames: DataFrame) -> DataFrame:
    """frames with frame_id: 0, 1, 2 ... by chunk and place in it. Counts of chunks are summed up first, so no task ranks all frames."""
    counts = frames.groupBy("chunk").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("chunk").orderBy("local")) - 1
    return frames.withColumn("__place", place.cast("long")).join(counts.select("chunk", before.alias("__before")), "chunk").withColumn("frame_id", F.col("__before") + F.col("__place")).drop("__before", "__place")
