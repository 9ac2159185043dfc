"""compress, decompress, verify: plans over the sources and operators, and the ordered writing of one file at their end.

Tasks do parsing, encoding and decoding, and leave frames as Parquet, or text as text parts, in a folder beside the
output; the driver only strings these together into the staged output, which takes its name when all is well. A failure
leaves neither. For outputs of a size that no single file should have, frames_of() and text_parts() are sinks without
a driver's part.
"""

from __future__ import annotations

import logging
import os
import sys
import tempfile
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from readloom.errors import FORMAT, IO, USAGE, EngineError, from_exception
from readloom.functions import codec
from readloom.functions.hashing import rolled
from readloom.functions.records import PROFILES
from readloom.operators import framing
from readloom.operators.profile import profile as profiled
from readloom.operators.profile import sample_prefix
from readloom.sources import store
from readloom.sources.archive import STREAMS, ArchiveSource, Directory, directory, plain
from readloom.sources.container import container, spooled
from readloom.sources.fastq import FastqSource, pair_ranges

log = logging.getLogger("readloom")
MIB = 1 << 20


@dataclass
class Limits:
    memory: int = codec.DEFAULT_MEMORY

    def check(self) -> None:
        if self.memory < codec.LEAST_MEMORY:
            raise EngineError(USAGE, "the memory limit is 64 MiB at least")


@dataclass
class CompressRequest(Limits):
    input: str = ""
    output: str = ""
    mate: str | None = None
    profile: str = "auto"
    frame_bytes: int = framing.TARGET
    level: int = 1
    workers: int = 4
    force: bool = False
    #: Plain pairs are cut into byte ranges too. Frames then begin anew in each, so the bytes aren't those of one scan.
    split_pairs: bool = False


@dataclass
class DecompressRequest(Limits):
    input: str = ""
    output: str = ""
    force: bool = False


@dataclass
class VerifyRequest(Limits):
    input: str = ""


@dataclass
class OperationStats:
    profile: str
    paired: bool
    frames: int
    records: int
    bases: int
    input_bytes: int
    output_bytes: int
    seconds: dict[str, float] = field(default_factory=dict)

    def frame(self, spark: SparkSession) -> DataFrame:
        """As a table of one row."""
        row = [(k, v) for k, v in self.__dict__.items() if k != "seconds"]
        kinds = {str: "string", bool: "boolean", int: "bigint"}
        return spark.createDataFrame([tuple(v for _, v in row)], ", ".join(f"{k} {kinds[type(v)]}" for k, v in row))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastqSource)
    spark.dataSource.register(ArchiveSource)


def mib(n: int) -> int:
    if not 0 < n <= ((1 << 63) - 1) // MIB:
        raise EngineError(USAGE, f"{n} MiB is out of range")
    return n * MIB


@contextmanager
def engine_errors():
    try:
        yield
    except EngineError:
        raise
    except Exception as e:
        raise from_exception(e) from e


@contextmanager
def published(spark: SparkSession, output: str, force: bool) -> Iterator[tuple[BinaryIO, str]]:
    """A staged output to append to, and a folder, beside it, for what tasks leave.

    Standard output, -, isn't staged; its folder is in spark.checkpoint.dir, a local one only where that is unset.
    """
    if output == "-":
        at = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}"
        folder = f"{at}/readloom-{time.time_ns()}-{os.getpid()}"
        try:
            yield sys.stdout.buffer, folder
            sys.stdout.buffer.flush()
        finally:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        return
    if store.exists(output) and not force:
        raise EngineError(IO, f"{output} exists")
    staged = f"{output}.tmp.{time.time_ns()}.{os.getpid()}"
    try:
        with store.created(staged) as f:
            yield f, store.address(f"{staged}.parts")
        store.moved(staged, output)
    except OSError as e:
        raise EngineError(IO, f"{output}: {e.strerror or e}") from e
    finally:
        store.removed(f"{staged}.parts")
        store.removed(staged)


@contextmanager
def inputs(*paths: str | None) -> Iterator[list[str | None]]:
    """The paths, with standard input, -, as a file."""
    if list(paths).count("-") > 1:
        raise EngineError(USAGE, "standard input can be read once only")
    made = []
    out = []
    for p in paths:
        if p == "-":
            made.append(p := tempfile.mkstemp(prefix="readloom-")[1])
            spooled(sys.stdin.buffer, p)
        out.append(p)
    try:
        yield out
    finally:
        for p in made:
            os.unlink(p)


def reads_of(spark: SparkSession, path: str, mate: str | None = None, workers: int = 1, split_pairs: bool = False, **how) -> DataFrame:
    register(spark)
    r = spark.read.format("fastq").options(path=path, workers=workers, **how)
    if mate:
        r = r.option("mate", mate)
        if split_pairs and (pairs := pair_ranges(spark, path, mate, workers)):
            r = r.option("pairs", pairs)
    return r.load()


def detect(spark: SparkSession, path: str, mate: str | None, bases: int) -> str:
    """The platform, from the reads that the input begins with."""
    head = reads_of(spark, path, mate).limit(50_000 + bool(mate)).withColumn("pair", F.floor(F.col("place") / (2 if mate else 1)))
    got = profiled(sample_prefix(head, bases, order="place", pairs="pair")).first()
    if got.profile is None:
        raise EngineError(USAGE, "the platform is ambiguous; give a profile")
    return got.profile


def frames_of(spark: SparkSession, path: str, mate: str | None = None, workers: int = 1, split_pairs: bool = False, **how) -> DataFrame:
    """The frames of a FASTQ input, encoded where they are parsed. Write it as Parquet for a sink without a driver's part."""
    return reads_of(spark, path, mate, workers, split_pairs, mode="frames", **how)


def frames_in(parts: list[str]) -> Iterator[codec.Frame]:
    """The frames of Parquet parts that were written a chunk each, in order; a frame in memory at a time."""
    for part in parts:
        with store.opened(part) as f:
            for batch in pq.ParquetFile(f).iter_batches(1):
                r = {name: column[0] for name, column in zip(batch.schema.names, batch.columns, strict=True)}
                raw = tuple(r[f"raw_{x}_size"].as_py() for x in STREAMS)
                yield codec.Frame(r["record_count"].as_py(), r["total_bases"].as_py(), raw, tuple(r[x].as_buffer() for x in STREAMS), r["checksum"].as_py() & (1 << 64) - 1)


def compress(spark: SparkSession, q: CompressRequest) -> OperationStats:
    q.check()
    if q.profile not in (*PROFILES.values(), "auto"):
        raise EngineError(USAGE, f"no profile {q.profile}")
    if not 1 <= q.level <= 19 or not 0 <= q.workers <= 64 or q.frame_bytes <= 0:
        raise EngineError(USAGE, "an option is out of range")
    if q.output != "-" and q.output in (q.input, q.mate):
        raise EngineError(USAGE, "an input is the output")
    if q.output != "-" and store.exists(q.output) and not q.force:
        raise EngineError(IO, f"{q.output} exists")
    room = q.memory - codec.RESERVE
    began = time.time()
    with engine_errors(), inputs(q.input, q.mate) as (path, mate):
        size = sum(container(p)[1] for p in (path, mate) if p)
        name = detect(spark, path, mate, min(512 * MIB, room // 8)) if q.profile == "auto" else q.profile
        sampled = time.time()
        with published(spark, q.output, q.force) as (out_file, folder):
            write = out_file.write
            frames_of(spark, path, mate, q.workers, q.split_pairs, target=min(q.frame_bytes, room // 8), level=q.level, memory=q.memory).write.parquet(folder)
            encoded = time.time()
            code = next(k for k, n in PROFILES.items() if n == name)
            write(codec.global_header(code, mate is not None))
            checksums: list[int] = []
            records = bases = out = 0
            for f in frames_in(store.parts(folder.removeprefix("file://"))):
                write(f.header(len(checksums)))
                for s in f.streams:
                    write(s)
                checksums.append(f.checksum)
                records, bases, out = records + f.records, bases + f.bases, out + codec.FRAME_HEADER_SIZE + sum(map(len, f.streams))
            write(codec.footer(len(checksums), records, bases, rolled(checksums)))
    seconds = {"sample": sampled - began, "encode": encoded - sampled, "write": time.time() - encoded}
    log.info("sample %.2f s, encode %.2f s, write %.2f s", *seconds.values())
    return OperationStats(name, mate is not None, len(checksums), records, bases, size, out + codec.HEADER_SIZE + codec.FOOTER_SIZE, seconds)


@contextmanager
def archive(path: str, memory: int) -> Iterator[tuple[str, Directory]]:
    with inputs(path) as (given,):
        at = plain(given)
        try:
            yield at, directory(at, memory)
        finally:
            if at != given:
                store.removed(at)


def decoded(spark: SparkSession, path: str, memory: int, run_bytes: int = 4 * MIB) -> DataFrame:
    """frame_id, records, bases, text binary: frames decoded and rendered, a task for each run of them."""
    register(spark)
    frames = spark.read.format("reads_archive").option("path", path).option("mode", "frames").option("memory", memory).option("run_bytes", run_bytes).load()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                f = codec.Frame(r["record_count"], 0, (r["raw_ids_size"], r["raw_sequences_size"], r["raw_qualities_size"]), (r["ids"], r["sequences"], r["qualities"]), r["checksum"] & (1 << 64) - 1)
                got = codec.decode_frame(f)
                text = b"".join([b"@%b%b\n%b\n+\n%b\n" % x for x in got])
                yield pa.RecordBatch.from_arrays([pa.array([r["frame_id"]]), pa.array([len(got)]), pa.array([sum(len(x[2]) for x in got)]), pa.array([text], pa.binary())], names=["frame_id", "records", "bases", "text"])

    return frames.mapInArrow(run, "frame_id long, records long, bases long, text binary")


def text_parts(spark: SparkSession, path: str, memory: int, folder: str) -> tuple[int, int, int]:
    """Leaves the text of all frames as text parts whose names sort as their frames do, at any store of Spark's; records, bases and bytes."""
    seen = Observation()
    text = decoded(spark, path, memory).observe(seen, F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.coalesce(F.sum("bases"), F.lit(0)).alias("bases"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("size"))
    # a text's own line end is the row's
    text.select(F.expr("substring(text, 1, length(text) - 1)").cast("string").alias("text")).write.option("lineSep", "\n").text(folder)
    got = seen.get
    return got["records"], got["bases"], got["size"]


def decompress(spark: SparkSession, q: DecompressRequest, sink: Callable[[bytes], None] | None = None) -> OperationStats:
    """sink: gets each frame's text in order, in place of the output; an exception of its ends the run."""
    q.check()
    if q.output != "-" and q.output == q.input:
        raise EngineError(USAGE, "the input is the output")
    began = time.time()
    with engine_errors(), archive(q.input, q.memory) as (path, d):
        walked = time.time()
        if sink:
            records = bases = out = 0
            for r in decoded(spark, path, q.memory).toLocalIterator():  # partitions are runs of frames, in order
                sink(bytes(r.text))
                records, bases, out = records + r.records, bases + r.bases, out + len(r.text)
            d.reconcile(records, bases)
            decoding = writing = time.time()
        else:
            with published(spark, q.output, q.force) as (file, folder):
                records, bases, out = text_parts(spark, path, q.memory, folder)
                d.reconcile(records, bases)
                decoding = time.time()
                for part in store.parts(folder.removeprefix("file://")):
                    store.appended(file, part)
                writing = time.time()
    seconds = {"walk": walked - began, "decode": decoding - walked, "write": writing - decoding}
    log.info("walk %.2f s, decode %.2f s, write %.2f s", *seconds.values())
    return OperationStats(PROFILES[d.profile], d.paired, len(d.frames), records, bases, d.size, out, seconds)


def verify(spark: SparkSession, q: VerifyRequest) -> OperationStats:
    """Decodes all, as decompress does, and writes nothing."""
    q.check()
    began = time.time()
    with engine_errors(), archive(q.input, q.memory) as (path, d):
        walked = time.time()
        got = decoded(spark, path, q.memory).agg(F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.coalesce(F.sum("bases"), F.lit(0)).alias("bases"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("size"), F.count("*").alias("frames")).first()
        if got.frames != len(d.frames):
            raise EngineError(FORMAT, "frames are missing")
        d.reconcile(got.records, got.bases)
        seconds = {"walk": walked - began, "decode": time.time() - walked}
    log.info("walk %.2f s, decode %.2f s", *seconds.values())
    return OperationStats(PROFILES[d.profile], d.paired, len(d.frames), got.records, got.bases, d.size, got["size"], seconds)
