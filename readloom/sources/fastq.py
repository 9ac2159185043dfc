"""The data source "fastq": reads of plain or gzipped files, in pairs if a mate is given, as rows in file order.

A plain unpaired file is cut into byte ranges; a record belongs to the range in which its header begins. Gzip is one
partition. So are pairs, unless pair_ranges() has told where the mates of each byte range of the first file begin. Rows
have their place explicitly: (file, byte_offset), chunk and place in the chunk.

Options: path, mate (R2 of path), workers (byte ranges; 0 or 1: one), start (byte to begin at), pairs (what pair_ranges()
gives), mode (reads; frames: the encoded frames of each range, with target, level and memory, so that reads never leave
the task; or counts: chunk, start, end and records of each range).
"""

from __future__ import annotations

import io
import json
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, chain, islice, zip_longest
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from readloom.errors import FORMAT, EngineError
from readloom.functions.codec import Read
from readloom.sources.container import container, opened

SCHEMA = "file string, chunk int, place bigint, byte_offset bigint, mate tinyint, id string, comment string, sequence string, quality string"
COUNTS = "chunk int, begin bigint, finish bigint, records bigint"
BATCH_BYTES = 8 << 20
LARGE = 64
#: Bytes that bulk() splits at once.
BLOCK = 4 << 20


class Parser:
    """Records of a byte stream from where it stands, with counts of lines, records and bytes."""

    def __init__(self, stream: BinaryIO, offset: int = 0):
        self.stream, self.offset, self.lines, self.records = stream, offset, 0, 0

    def line(self) -> bytes | None:
        """The next line without its end and one CR; None at the end."""
        raw = self.stream.readline()
        if not raw:
            return None
        self.offset += len(raw)
        self.lines += 1
        if raw.endswith(b"\n"):
            raw = raw[:-1]
        return raw[:-1] if raw.endswith(b"\r") else raw

    def needed(self) -> bytes:
        if (x := self.line()) is None:
            raise EngineError(FORMAT, f"unexpected EOF at line {self.lines}")
        return x

    def read(self) -> tuple[int, bytes, bytes, bytes, bytes] | None:
        """offset, id, comment, sequence, quality of the next record; None at the end."""
        while True:
            at = self.offset
            head = self.line()
            if head is None:
                return None
            if head:
                break
        if not head.startswith(b"@"):
            raise EngineError(FORMAT, f"line {self.lines}: a header must begin with @")
        cut = head.find(b" ")
        name, comment = (head[1:], b"") if cut < 0 else (head[1:cut], head[cut:])
        if not name:
            raise EngineError(FORMAT, f"line {self.lines}: no id")
        sequence = self.needed()
        if not sequence:
            raise EngineError(FORMAT, f"line {self.lines}: no sequence")
        if not self.needed().startswith(b"+"):
            raise EngineError(FORMAT, f"line {self.lines}: no + line")
        quality = self.needed()
        if len(quality) != len(sequence):
            raise EngineError(FORMAT, f"line {self.lines}: quality and sequence differ in length")
        self.records += 1
        return at, name, comment, sequence, quality


def first_record(stream: BinaryIO, start: int) -> int | None:
    """Where the first record that begins at start or later begins. No alphabet is looked at: a bad letter must not hide a record."""
    stream.seek(max(0, start - 1))
    at = start
    if start and stream.read(1) != b"\n":
        at += len(stream.readline())
    trim = lambda x: x.rstrip(b"\n")[:-1] if x.rstrip(b"\n").endswith(b"\r") else x.rstrip(b"\n")
    while True:
        stream.seek(at)
        line = stream.readline()
        if not line:
            return None
        after = at + len(line)
        if line.startswith(b"@"):
            more = [stream.readline() for _ in range(3)]
            if not more[2]:  # the file ends in this record, if it is one
                return at if trim(more[0]) or more[1] else None
            two, three, four = map(trim, more)
            if three.startswith(b"+") and len(two) == len(four):
                return at
        at = after


@dataclass
class Part(InputPartition):
    chunk: int
    path: str
    mate: str | None
    start: int
    end: int | None  # None: to the end
    #: Of the mates: their range's number and first byte, the records of it to pass over, and how many follow (None: all).
    mates: tuple[int, int, int, int | None]

    def __init__(self, chunk: int, path: str, mate: str | None = None, start: int = 0, end: int | None = None, mates: tuple[int, int, int, int | None] = (0, 0, 0, None)):
        self.chunk, self.path, self.mate, self.start, self.end, self.mates = chunk, path, mate, start, end, mates

    def sides(self) -> tuple[Part, Part]:
        """Both files of a pair, each as a part of its own; the second is to be read from mates on."""
        return Part(self.chunk, self.path, None, self.start, self.end), Part(self.mates[0], self.mate, None, self.mates[1])

    def mates_of(self, rows: Iterator) -> Iterator:
        _, _, skip, count = self.mates
        return islice(rows, skip, None if count is None else skip + count)


def ranges(path: str, workers: int, start: int = 0) -> list[Part]:
    kind, size = container(path)
    if kind != "none" or workers <= 1 or size <= start:
        return [Part(0, path, None, start)]
    width = max(1, (size - start) // workers)
    cuts = [min(start + k * width, size) for k in range(workers)] + [size]
    return [Part(k, path, None, a, b if k < workers - 1 else None) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]


def paired(one: Iterator, two: Iterator) -> Iterator[tuple]:
    """Rows of both, in pairs; one longer than the other is an error."""
    for a, b in zip_longest(one, two):
        if a is None or b is None:
            raise EngineError(FORMAT, "paired inputs have different record counts")
        yield a, b


def records(part: Part) -> Iterator[tuple[int, int, bytes, bytes, bytes, bytes]]:
    """mate, offset, id, comment, sequence, quality. Pairs alternate."""
    if part.mate is not None:
        one, two = map(records, part.sides())
        for a, b in paired(one, part.mates_of(two)):
            yield 1, *a[1:]
            yield 2, *b[1:]
        return
    with opened(part.path) as f:
        at = part.start
        if part.chunk:  # the first range begins at a record, whatever it looks like
            found = first_record(f, at)
            if found is None or part.end is not None and found >= part.end:
                return
            at = found
        if at:
            f.seek(at)
        parser = Parser(f, at)
        while (got := parser.read()) is not None and (part.end is None or got[0] < part.end):
            yield 0, *got
        if got is not None and first_record(f, part.end) != got[0]:  # else the next range would pass over a bad record
            raise EngineError(FORMAT, f"no record can be told at byte {got[0]}")


class Joined(io.RawIOBase):
    """Bytes already read, then a stream."""

    def __init__(self, head: bytes, rest: BinaryIO):
        self.head, self.rest = io.BytesIO(head), rest

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.head.read(len(buffer)) or self.rest.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


def regular(lines: list[bytes]) -> list[Read] | None:
    """The records of four lines each, if all are plainly right; None leaves them to the Parser and its errors."""
    heads, sequences, qualities = lines[0::4], lines[1::4], lines[3::4]
    sizes = list(map(len, sequences))
    if not all(sizes) or sizes != list(map(len, qualities)) or not all([x[:1] == b"+" for x in lines[2::4]]):
        return None
    out = []
    for head, sequence, quality in zip(heads, sequences, qualities, strict=True):
        cut = head.find(b" ")
        name, comment = (head[1:], b"") if cut < 0 else (head[1:cut], head[cut:])
        if not name or head[:1] != b"@":
            return None
        out.append((name, comment, sequence, quality))
    return out


def bulk(part: Part) -> Iterator[list[Read]]:
    """What records() gives, without mates and offsets, many at a time: blocks of plain four-line records are split at once."""
    if part.mate is not None:
        one, two = (chain.from_iterable(bulk(p)) for p in part.sides())
        rows = chain.from_iterable(paired(one, part.mates_of(two)))
        while held := list(islice(rows, 4096)):
            yield held
        return
    with opened(part.path) as f:
        at = part.start
        if part.chunk:
            found = first_record(f, at)
            if found is None or part.end is not None and found >= part.end:
                return
            at = found
        if at:
            f.seek(at)
        carry = b""
        while part.end is None or at < part.end:
            data = f.read(BLOCK)
            block = carry + data
            lines = block.split(b"\n") if data and b"\r" not in block else []
            whole = (len(lines) - 1) // 4 * 4
            got = regular(lines[:whole]) if whole > 0 else None
            if got is None:
                break
            size = sum(map(len, lines[:whole])) + whole
            if part.end is not None and at + size > part.end:
                ends = accumulate(len(x) + 1 for x in lines[:whole])
                mine = 1 + sum(1 for k, e in enumerate(ends, 1) if k % 4 == 0 and at + e < part.end)
                if mine < len(got):
                    yield got[:mine]
                    at += sum(map(len, lines[: 4 * mine])) + 4 * mine
                    if first_record(f, part.end) != at:
                        raise EngineError(FORMAT, f"no record can be told at byte {at}")
                    return
            yield got
            at, carry = at + size, block[size:]
        else:
            block = carry
        parser = Parser(io.BufferedReader(Joined(block, f), 1 << 20), at)
        rows = []
        while (got := parser.read()) is not None and (part.end is None or got[0] < part.end):
            rows.append(got[1:])
            if len(rows) == 4096:
                yield rows
                rows = []
        if rows:
            yield rows
        if got is not None and first_record(f, part.end) != got[0]:
            raise EngineError(FORMAT, f"no record can be told at byte {got[0]}")


Count = tuple[int, int, int | None, int]


def pair_cuts(one: list[Count], two: list[Count]) -> list[tuple[int, int | None, tuple[int, int, int, int]]]:
    """start, end and mates of each range of the first file, from chunk, start, end and records of the ranges of both."""
    first, of_mates = (list(accumulate((r[3] for r in side), initial=0)) for side in (one, two))
    if first[-1] != of_mates[-1]:
        raise EngineError(FORMAT, "paired inputs have different record counts")
    out = []
    for (_, start, end, n), done in zip(one, first[:-1], strict=True):
        at = min(bisect_right(of_mates, done), len(two)) - 1
        out.append((start, end, (at, two[at][1], done - of_mates[at], n)))
    return out


def pair_ranges(spark: SparkSession, path: str, mate: str, workers: int) -> str | None:
    """The option "pairs" for byte ranges of path, from a count of the records of each range of both; None where one scan has to do.

    A mate's record is known by its count only, so both files are read once more, in tasks; the driver gets two rows a range.
    Of its mates' range a task passes over what belongs to earlier ones, a range at most.
    """
    if workers <= 1 or any(container(p)[0] != "none" for p in (path, mate)):
        return None
    counted = lambda p: sorted(tuple(r) for r in spark.read.format("fastq").options(path=p, workers=workers, mode="counts").load().collect())
    return json.dumps(pair_cuts(counted(path), counted(mate)))


class FastqReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.mate = options["path"], options.get("mate")
        self.workers, self.start = int(options.get("workers", 4)), int(options.get("start", 0))
        self.mode, self.pairs = options.get("mode", "reads"), options.get("pairs")
        self.how = {k: int(options[k]) for k in ("target", "level", "memory") if k in options}

    def partitions(self) -> list[Part]:
        if self.mate:
            for p in (self.path, self.mate):
                container(p)
            if self.pairs:
                return [Part(k, self.path, self.mate, a, b, tuple(m)) for k, (a, b, m) in enumerate(json.loads(self.pairs))]
            return [Part(0, self.path, self.mate)]
        return ranges(self.path, self.workers, self.start)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if self.mode == "frames":
            from readloom.operators.framing import encoded

            yield from encoded(((partition.chunk, b) for b in bulk(partition)), paired=partition.mate is not None, **self.how)
            return
        if self.mode == "counts":
            n = sum(map(len, bulk(partition)))
            where = [pa.array([x], pa.int64()) for x in (partition.start, partition.end, n)]
            yield pa.RecordBatch.from_arrays([pa.array([partition.chunk], pa.int32()), *where], names=["chunk", "begin", "finish", "records"])
            return
        rows: list[tuple] = []
        size = place = 0
        for r in records(partition):
            rows.append(r)
            size += sum(map(len, r[2:])) + LARGE
            if size > BATCH_BYTES:
                yield batch_of(partition, place, rows)
                place += len(rows)
                rows, size = [], 0
        if rows:
            yield batch_of(partition, place, rows)


def batch_of(part: Part, place: int, rows: list[tuple]) -> pa.RecordBatch:
    mate, offset, *text = zip(*rows, strict=True)
    n = len(rows)
    strings = [pa.array([x.decode("latin-1") for x in col], pa.string()) for col in text]
    columns = [pa.array([part.path] * n), pa.array([part.chunk] * n, pa.int32()), pa.array(range(place, place + n), pa.int64()), pa.array(offset, pa.int64()), pa.array(mate, pa.int8()), *strings]
    return pa.RecordBatch.from_arrays(columns, names=["file", "chunk", "place", "byte_offset", "mate", "id", "comment", "sequence", "quality"])


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        if self.options.get("mode") == "frames":
            from readloom.operators.framing import FRAME_SCHEMA

            return FRAME_SCHEMA
        return COUNTS if self.options.get("mode") == "counts" else SCHEMA

    def reader(self, schema) -> FastqReader:
        if "path" not in self.options:
            raise EngineError(FORMAT, "fastq needs a path")
        return FastqReader(dict(self.options))
