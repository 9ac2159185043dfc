"""Frames of reads as bytes: three raw streams, their hash, their compression, and all of it back. No Spark here.

A read is a tuple of bytes (id, comment, sequence, quality); a comment has its leading blank.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import xxhash
import zstandard

from readloom.errors import CHECKSUM, FORMAT, INTERNAL, IO, UNSUPPORTED, USAGE, EngineError
from readloom.functions.records import ALPHABET, BASES

Read = tuple[bytes, bytes, bytes, bytes]

#: Fixed values of the wire format.
MAGIC = bytes.fromhex("46514356320D0A1A")
FOREIGN = bytes.fromhex("894651430D0A1A0A")
FRAME_MARK, FOOTER_MARK = 0x324D5246, 0x32444E45
VERSION, HEADER_SIZE, FRAME_HEADER_SIZE, FOOTER_SIZE = 2, 32, 72, 40
CODEC = 1

#: Fixed values of the limits.
RESERVE = 16 << 20
DEFAULT_MEMORY, LEAST_MEMORY = 16 << 30, 64 << 20
READ_SIZE = 96

_CODE = np.zeros(256, np.uint8)
_PLAIN = np.zeros(256, bool)
for _k, _b in enumerate(BASES.encode()):
    _CODE[_b], _PLAIN[_b] = _k, True
_LETTERS = np.frombuffer(BASES.encode(), np.uint8)
_KNOWN = np.zeros(256, bool)
_KNOWN[list(ALPHABET.encode())] = True
_SHORT = [bytes([k]) if k < 128 else b"" for k in range(128)]
_CODES = _CODE.tobytes()
#: The four letters of each byte, as one number in memory.
_QUADS = np.ascontiguousarray(_LETTERS[np.arange(256, dtype=np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3]).view(np.uint32).reshape(256)
_PRINTED = bytes(range(33, 127))


def varint(n: int) -> bytes:
    if n < 128:
        return _SHORT[n]
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


class Cursor:
    """Reads a stream from its start; whatever it lacks is a format error."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def varint(self) -> int:
        value = shift = 0
        while True:
            if self.at >= len(self.data):
                raise EngineError(FORMAT, "truncated number")
            b = self.data[self.at]
            self.at += 1
            if shift == 63 and b > 1:
                raise EngineError(FORMAT, "number too large")
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7
            if shift > 63:
                raise EngineError(FORMAT, "number too long")

    def take(self, n: int) -> bytes:
        if n > len(self.data) - self.at:
            raise EngineError(FORMAT, "truncated stream")
        self.at += n
        return self.data[self.at - n : self.at]

    def done(self) -> None:
        if self.at != len(self.data):
            raise EngineError(FORMAT, "bytes after a stream's end")


def shape_fault(r: Read) -> bool:
    i, c, s, q = r
    return not i or not s or len(s) != len(q) or b" " in i or b"\r" in i or b"\n" in i or b"\r" in c or b"\n" in c


def validate(reads: list[Read]) -> None:
    if bad := next(filter(shape_fault, reads), None):
        raise EngineError(USAGE, f"bad record {bad[0][:60]!r}")
    if b"".join([r[2] for r in reads]).translate(None, ALPHABET.encode()):
        raise EngineError(USAGE, "a sequence has a letter that is no IUPAC code")
    if b"".join([r[3] for r in reads]).translate(None, _PRINTED):
        raise EngineError(USAGE, "a quality has a byte beyond ! to ~")


def grid(head: bytes, rows: np.ndarray, tail: bytes = b"") -> bytes:
    """Rows of equal length one after another, each between head and tail."""
    out = np.empty((len(rows), len(head) + rows.shape[1] + len(tail)), np.uint8)
    out[:, : len(head)] = np.frombuffer(head, np.uint8)
    out[:, len(head) : len(head) + rows.shape[1]] = rows
    out[:, len(head) + rows.shape[1] :] = np.frombuffer(tail, np.uint8)
    return out.tobytes()


def quads(codes: np.ndarray) -> np.ndarray:
    """Four codes to a byte, the first lowest."""
    return codes[..., 0::4] | codes[..., 1::4] << 2 | codes[..., 2::4] << 4 | codes[..., 3::4] << 6


def pack(sequences: list[bytes]) -> bytes:
    """The raw sequence stream without its count."""
    lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
    joined = b"".join(sequences)
    plain = not joined.translate(None, BASES.encode())
    letters = np.frombuffer(joined, np.uint8)
    coded = np.frombuffer(joined.translate(_CODES), np.uint8)
    n = int(lengths[0])
    if plain and (lengths == n).all():
        codes = np.zeros((len(sequences), (n + 3) // 4 * 4), np.uint8)
        codes[:, :n] = coded.reshape(-1, n)
        return grid(varint(n), quads(codes), b"\0")
    room = (lengths + 3) // 4
    begins = np.cumsum(room) - room
    starts = np.cumsum(lengths) - lengths
    codes = np.zeros(int(room.sum()) * 4, np.uint8)
    codes[np.arange(len(letters)) + np.repeat(begins * 4 - starts, lengths)] = coded
    packed = quads(codes).tobytes()
    odd = np.flatnonzero(~_PLAIN[letters]) if not plain else np.empty(0, np.int64)
    cuts = np.searchsorted(odd, starts).tolist() + [len(odd)]
    out = []
    ends = (begins + room).tolist()
    for k, (n, a, b) in enumerate(zip(lengths.tolist(), begins.tolist(), ends, strict=True)):
        out += (varint(n), packed[a:b])
        first, last = cuts[k], cuts[k + 1]
        if first == last:
            out.append(b"\0")
            continue
        out.append(varint(last - first))
        before = int(starts[k])
        for p in odd[first:last].tolist():
            out += (varint(p - before), joined[p : p + 1])
            before = p
    return b"".join(out)


def raw_streams(reads: list[Read]) -> tuple[bytes, bytes, bytes]:
    n = varint(len(reads))
    ids = b"".join([n, *[x for i, c, _, _ in reads for x in (varint(len(i)), i, varint(len(c)), c)]])
    qualities = [r[3] for r in reads]
    size = len(qualities[0])
    if all(len(q) == size for q in qualities):
        printed = grid(varint(size), np.frombuffer(b"".join(qualities), np.uint8).reshape(-1, size))
    else:
        printed = b"".join([x for q in qualities for x in (varint(len(q)), q)])
    return ids, n + pack([r[2] for r in reads]), n + printed


def even_rows(data: bytes, at: int, count: int, head: bytes, size: int, tail: bytes) -> np.ndarray | None:
    """The rows of a stream that is a grid() from at on; None if it isn't."""
    width = len(head) + size + len(tail)
    if count < 2 or len(data) - at != count * width:
        return None
    rows = np.frombuffer(data, np.uint8, offset=at).reshape(count, width)
    if (rows[:, : len(head)] != np.frombuffer(head, np.uint8)).any() or (rows[:, len(head) + size :] != np.frombuffer(tail, np.uint8)).any():
        return None
    return rows[:, len(head) : len(head) + size]


def even_sequences(data: bytes, at: int, count: int) -> list[bytes] | None:
    """The sequences of a stream in which all are of one length and without exceptions."""
    cursor = Cursor(data)
    cursor.at = at
    n = cursor.varint()
    rows = even_rows(data, at, count, data[at : cursor.at], (n + 3) // 4, b"\0")
    if rows is None or not n:
        return None
    text = _QUADS[rows].view(np.uint8).reshape(count, -1)[:, :n].tobytes()
    return [text[k : k + n] for k in range(0, count * n, n)]


def even_qualities(data: bytes, at: int, count: int) -> list[bytes] | None:
    cursor = Cursor(data)
    cursor.at = at
    n = cursor.varint()
    rows = even_rows(data, at, count, data[at : cursor.at], n, b"")
    if rows is None or not n:
        return None
    text = rows.tobytes()
    return [text[k : k + n] for k in range(0, count * n, n)]


def unpack(cursor: Cursor) -> bytes:
    n = cursor.varint()
    packed = np.frombuffer(cursor.take((n + 3) // 4), np.uint8)
    letters = _LETTERS[(packed[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).reshape(-1)[:n]]
    if count := cursor.varint():
        if count > n:
            raise EngineError(FORMAT, "more exceptions than letters")
        at = 0
        for k in range(count):
            delta = cursor.varint()
            at += delta
            if k and not delta or at >= n:
                raise EngineError(FORMAT, "bad place of an exception")
            (b,) = cursor.take(1)
            if not _KNOWN[b]:
                raise EngineError(FORMAT, "an exception that is no IUPAC code")
            letters[at] = b
    return letters.tobytes()


def decode_streams(ids: bytes, sequences: bytes, qualities: bytes, count: int) -> list[Read]:
    i, s, q = map(Cursor, (ids, sequences, qualities))
    if any(c.varint() != count for c in (i, s, q)):
        raise EngineError(FORMAT, "record counts disagree")
    names = []
    for _ in range(count):
        name = i.take(i.varint())
        names.append((name, i.take(i.varint())))
    sequences = even_sequences(sequences, s.at, count) if count else []
    if sequences is None:
        sequences = [unpack(s) for _ in range(count)]
        s.done()
    qualities = even_qualities(qualities, q.at, count) if count else []
    if qualities is None:
        qualities = [q.take(q.varint()) for _ in range(count)]
        q.done()
    i.done()
    out = [(*n, a, b) for n, a, b in zip(names, sequences, qualities, strict=True)]
    if any(map(shape_fault, out)) or b"".join(qualities).translate(None, _PRINTED):
        raise EngineError(FORMAT, "a bad record in a frame")
    return out


def frame_hash(ids: bytes, sequences: bytes, qualities: bytes) -> int:
    h = 0
    for x in (ids, sequences, qualities):
        h = xxhash.xxh64_intdigest(x, h)
    return h


def bound(n: int) -> int:
    """The most that zstd makes of n bytes."""
    return n + (n >> 8) + (((128 << 10) - n) >> 11 if n < 128 << 10 else 0)


@dataclass(frozen=True)
class Frame:
    """A compressed frame."""

    records: int
    bases: int
    raw: tuple[int, int, int]
    streams: tuple[bytes, bytes, bytes]
    checksum: int

    def header(self, number: int) -> bytes:
        sizes = [x for r, s in zip(self.raw, self.streams, strict=True) for x in (r, len(s))]
        return struct.pack("<IIII6QQ", FRAME_MARK, FRAME_HEADER_SIZE, number & 0xFFFFFFFF, self.records, *sizes, self.checksum)


def frame_limit(memory: int) -> int:
    """The most bytes of one stream of a frame."""
    return min(512 << 20, (memory - RESERVE) // 4)


def compress_peak(reads: list[Read], raw: tuple[bytes, ...]) -> int:
    """The memory that encoding takes: reads, their texts with an end each, raw streams and the most that these become."""
    text = sum([len(i) + len(c) + 2 * len(q) + 4 for i, c, _, q in reads])
    return RESERVE + 2 * len(reads) * READ_SIZE + text + sum(len(x) + bound(len(x)) for x in raw)


def encode_frame(reads: list[Read], *, paired: bool = False, level: int = 1, memory: int = DEFAULT_MEMORY) -> Frame:
    if not reads or paired and len(reads) % 2 or len(reads) >= 1 << 32:
        raise EngineError(USAGE, f"a frame can't have {len(reads)} records")
    if not 1 <= level <= 19:
        raise EngineError(USAGE, "the quality level is 1 to 19")
    validate(reads)
    raw = raw_streams(reads)
    if max(map(len, raw)) > frame_limit(memory):
        raise EngineError(USAGE, "a stream of a frame is larger than the memory limit allows")
    if compress_peak(reads, raw) > memory:
        raise EngineError(USAGE, "encoding a frame would need more than the memory limit")
    try:
        streams = tuple(zstandard.ZstdCompressor(level=k).compress(x) for x, k in zip(raw, (1, 1, level), strict=True))
    except zstandard.ZstdError as e:
        raise EngineError(INTERNAL, f"compression failed: {e}") from None
    return Frame(len(reads), sum(len(r[2]) for r in reads), tuple(map(len, raw)), streams, frame_hash(*raw))


def decode_frame(f: Frame) -> list[Read]:
    raw = []
    for size, data in zip(f.raw, f.streams, strict=True):
        try:
            x = zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, size)) if data else b""
        except zstandard.ZstdError as e:
            raise EngineError(FORMAT, f"a stream can't be decompressed: {e}") from None
        if len(x) != size:
            raise EngineError(FORMAT, "a stream's size isn't as declared")
        raw.append(x)
    if frame_hash(*raw) != f.checksum:
        raise EngineError(CHECKSUM, "a frame's hash differs")
    return decode_streams(*raw, f.records)


def global_header(profile: int, paired: bool) -> bytes:
    head = struct.pack("<8sHHIBBBBI", MAGIC, VERSION, HEADER_SIZE, int(paired), profile, CODEC, CODEC, CODEC, 0)
    return head + struct.pack("<Q", xxhash.xxh64_intdigest(head, 0))


def footer(frames: int, records: int, bases: int, checksum: int) -> bytes:
    return struct.pack("<II4Q", FOOTER_MARK, FOOTER_SIZE, frames, records, bases, checksum)


def exactly(stream, n: int) -> bytes:
    try:
        data = stream.read(n)
    except (OSError, EOFError) as e:
        raise EngineError(IO, str(e)) from None
    if len(data) < n:
        raise EngineError(FORMAT, "the archive is truncated")
    return data


def read_header(stream) -> tuple[int, bool]:
    """profile, paired. The order of checks decides the error of an archive with several faults."""
    magic = exactly(stream, 8)
    if magic == FOREIGN:
        raise EngineError(UNSUPPORTED, "an indexed archive of the same name, which is another family")
    if magic != MAGIC:
        raise EngineError(FORMAT, "no archive")
    rest = exactly(stream, HEADER_SIZE - 8)
    version, size, flags, profile, a, b, c, reserved, checksum = struct.unpack("<HHIBBBBIQ", rest)
    if version != VERSION or size != HEADER_SIZE:
        raise EngineError(UNSUPPORTED, f"version {version}")
    if flags > 1 or reserved or not 1 <= profile <= 4 or (a, b, c) != (CODEC, CODEC, CODEC):
        raise EngineError(UNSUPPORTED, "flags, profile or codecs")
    if xxhash.xxh64_intdigest(magic + rest[:16], 0) != checksum:
        raise EngineError(CHECKSUM, "the header's hash differs")
    return profile, bool(flags)


def read_frame_header(stream, number: int, paired: bool, memory: int) -> tuple[int, tuple[int, ...], tuple[int, ...], int] | tuple[int, int, int, int]:
    """A frame's records, raw sizes, sizes and hash; or the four totals of the footer, with the first below zero turned by ~."""
    (mark,) = struct.unpack("<I", exactly(stream, 4))
    if mark == FOOTER_MARK:
        size, frames, records, bases, checksum = struct.unpack("<I4Q", exactly(stream, FOOTER_SIZE - 4))
        if size != FOOTER_SIZE:
            raise EngineError(FORMAT, "bad footer")
        if stream.read(1):
            raise EngineError(FORMAT, "bytes after the footer")
        return ~frames, records, bases, checksum
    if mark != FRAME_MARK:
        raise EngineError(FORMAT, "neither frame nor footer")
    size, found, records, *sizes, checksum = struct.unpack("<III6QQ", exactly(stream, FRAME_HEADER_SIZE - 4))
    raw, coded = tuple(sizes[::2]), tuple(sizes[1::2])
    if size != FRAME_HEADER_SIZE or found != number or not records or paired and records % 2:
        raise EngineError(FORMAT, "bad frame header")
    if max(sizes) > frame_limit(memory) or RESERVE + 2 * records * READ_SIZE + sum(sizes) > memory:
        raise EngineError(FORMAT, "a frame is larger than the memory limit allows")
    return records, raw, coded, checksum

