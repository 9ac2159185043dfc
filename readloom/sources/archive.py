"""The data source "reads_archive": frames of an archive, or their reads, without an index.

The driver walks the frame headers, seeking over the payloads, checks them and the footer's totals, and deals runs of
frames to tasks. Tasks read, and in mode reads decode and check the hash of each frame.

Options: path, mode (frames or reads), memory (bytes), run_bytes (payload of a task at least), streams (in mode frames,
those to read of ids,sequences,qualities; the others are null).
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from readloom.errors import CHECKSUM, FORMAT, EngineError
from readloom.functions import codec
from readloom.functions.hashing import rolled
from readloom.sources import store
from readloom.sources.container import container, opened

FRAMES = "frame_id bigint, record_count bigint, total_bases bigint, raw_ids_size bigint, ids binary, raw_sequences_size bigint, sequences binary, raw_qualities_size bigint, qualities binary, checksum bigint"
READS = "frame_id bigint, place bigint, mate tinyint, id string, comment string, sequence string, quality string"
STREAMS = ("ids", "sequences", "qualities")


@dataclass(frozen=True)
class Entry:
    number: int
    at: int
    records: int
    raw: tuple[int, ...]
    coded: tuple[int, ...]
    checksum: int


@dataclass(frozen=True)
class Directory:
    """What the headers of an archive say."""

    profile: int
    paired: bool
    frames: list[Entry]
    records: int
    bases: int
    checksum: int
    size: int

    def reconcile(self, records: int, bases: int) -> None:
        """records and bases: as decoded."""
        if (records, bases) != (self.records, self.bases):
            raise EngineError(FORMAT, "the footer's totals differ")
        if rolled(f.checksum for f in self.frames) != self.checksum:
            raise EngineError(CHECKSUM, "the archive's hash differs")


def plain(path: str, folder: str | None = None) -> str:
    """path, or what a gzipped archive at path inflates to: beside it, as tasks read that too, or in the folder."""
    if container(path)[0] != "gzip":
        return path
    out = f"{folder or path.rpartition('/')[0] or '.'}/{uuid.uuid4().hex}.archive"
    with opened(path) as f, store.created(out) as g:
        while data := f.read(1 << 20):
            g.write(data)
    return out


def directory(path: str, memory: int = codec.DEFAULT_MEMORY) -> Directory:
    size = container(path)[1]
    with opened(path) as f:
        profile, paired = codec.read_header(f)
        frames: list[Entry] = []
        while True:
            got = codec.read_frame_header(f, len(frames), paired, memory)
            if got[0] < 0:
                break
            records, raw, coded, checksum = got
            entry = Entry(len(frames), f.tell(), records, raw, coded, checksum)
            if entry.at + sum(coded) > size:
                raise EngineError(FORMAT, "the archive is truncated")
            frames.append(entry)
            f.seek(sum(coded), 1)
    count, records, bases, checksum = got
    if ~count != len(frames) or records != sum(e.records for e in frames):
        raise EngineError(FORMAT, "the footer's totals differ")
    return Directory(profile, paired, frames, records, bases, checksum, size)


def fault(data: bytes, memory: int = codec.DEFAULT_MEMORY) -> int:
    """The code that reading an archive's bytes through ends with: 0 if nothing is wrong."""
    f = io.BytesIO(data)
    try:
        _, paired = codec.read_header(f)
        checksums, records, bases = [], 0, 0
        while (got := codec.read_frame_header(f, len(checksums), paired, memory))[0] >= 0:
            count, raw, coded, checksum = got
            reads = codec.decode_frame(codec.Frame(count, 0, raw, tuple(codec.exactly(f, n) for n in coded), checksum))
            checksums.append(checksum)
            records, bases = records + len(reads), bases + sum(len(r[2]) for r in reads)
        if (~got[0], *got[1:3]) != (len(checksums), records, bases):
            raise EngineError(FORMAT, "the footer's totals differ")
        if rolled(checksums) != got[3]:
            raise EngineError(CHECKSUM, "the archive's hash differs")
    except EngineError as e:
        return e.code
    return 0


def payload(f, e: Entry) -> tuple[bytes, ...]:
    f.seek(e.at)
    return tuple(codec.exactly(f, n) for n in e.coded)


def bases_of(sequences: bytes, e: Entry) -> int:
    """Bases of a frame, from its sequence stream."""
    import zstandard

    cursor = codec.Cursor(zstandard.ZstdDecompressor().decompress(sequences, max_output_size=max(1, e.raw[1])))
    total = 0
    for _ in range(cursor.varint()):
        n = cursor.varint()
        total += n
        cursor.take((n + 3) // 4)
        for _ in range(cursor.varint()):
            cursor.varint()
            cursor.take(1)
    return total


@dataclass
class Run(InputPartition):
    path: str
    paired: bool
    frames: list[Entry]

    def __init__(self, path: str, paired: bool, frames: list[Entry]):
        self.path, self.paired, self.frames = path, paired, frames


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.mode = options["path"], options.get("mode", "reads")
        self.memory, self.run_bytes = int(options.get("memory", codec.DEFAULT_MEMORY)), int(options.get("run_bytes", 1 << 20))
        self.streams = options.get("streams", ",".join(STREAMS)).split(",")

    def partitions(self) -> list[Run]:
        d = directory(self.path, self.memory)
        runs: list[list[Entry]] = [[]]
        for e in d.frames:
            if runs[-1] and sum(sum(x.coded) for x in runs[-1]) >= self.run_bytes:
                runs.append([])
            runs[-1].append(e)
        return [Run(self.path, d.paired, r) for r in runs]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        if not partition.frames:
            return
        with store.opened(partition.path) as f:
            for e in partition.frames:
                streams = payload(f, e)
                yield self.frame(e, streams) if self.mode == "frames" else self.reads(partition, e, streams)

    def frame(self, e: Entry, streams: tuple[bytes, ...]) -> pa.RecordBatch:
        long = lambda x: pa.array([x - (1 << 64) if x >> 63 else x], pa.int64())
        bases = bases_of(streams[1], e) if "sequences" in self.streams else None
        cols = [long(e.number), long(e.records), pa.array([bases], pa.int64())]
        for name, raw, s in zip(STREAMS, e.raw, streams, strict=True):
            cols += [long(raw), pa.array([s if name in self.streams else None], pa.binary())]
        return pa.RecordBatch.from_arrays([*cols, long(e.checksum)], names=[c.split()[0] for c in FRAMES.split(", ")])

    def reads(self, run: Run, e: Entry, streams: tuple[bytes, ...]) -> pa.RecordBatch:
        got = codec.decode_frame(codec.Frame(e.records, 0, e.raw, streams, e.checksum))
        n = len(got)
        text = [pa.array([x.decode("latin-1") for x in col], pa.string()) for col in zip(*got, strict=True)]
        mates = [1 + k % 2 for k in range(n)] if run.paired else [0] * n
        return pa.RecordBatch.from_arrays([pa.array([e.number] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(mates, pa.int8()), *text], names=[c.split()[0] for c in READS.split(", ")])


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "reads_archive"

    def schema(self) -> str:
        return FRAMES if self.options.get("mode") == "frames" else READS

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))
