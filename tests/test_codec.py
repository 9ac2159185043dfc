import hashlib
import io
import random
import struct

import pytest
import zstandard

from readloom.errors import CHECKSUM, FORMAT, UNSUPPORTED, USAGE, EngineError
from readloom.functions import codec
from readloom.functions.hashing import rolled

LETTERS = codec.ALPHABET.encode()


def some_reads(n, seed=0xF0C2026, longest=600):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        size = rnd.randint(1, longest)
        out.append((f"read_{k}".encode(), rnd.choice([b"", b" ", b" a  b", b"\t".replace(b"\t", b" \xff\x80")]), bytes(rnd.choices(LETTERS if k % 3 else b"ACGT", k=size)), bytes(rnd.choices(range(33, 127), k=size))))
    return out


def archive(groups, profile=1, paired=False, level=1):
    frames = [codec.encode_frame(g, paired=paired, level=level) for g in groups]
    body = b"".join(f.header(k) + b"".join(f.streams) for k, f in enumerate(frames))
    return codec.global_header(profile, paired) + body + codec.footer(len(frames), sum(f.records for f in frames), sum(f.bases for f in frames), rolled(f.checksum for f in frames))


def decoded(data, memory=codec.DEFAULT_MEMORY):
    f = io.BytesIO(data)
    _, paired = codec.read_header(f)
    reads, sums, bases = [], [], 0
    while True:
        got = codec.read_frame_header(f, len(sums), paired, memory)
        if got[0] < 0:
            break
        records, raw, coded, checksum = got
        reads += codec.decode_frame(codec.Frame(records, 0, raw, tuple(codec.exactly(f, n) for n in coded), checksum))
        sums.append(checksum)
    frames, records, bases, checksum = ~got[0], *got[1:]
    if (frames, records, bases) != (len(sums), len(reads), sum(len(r[2]) for r in reads)):
        raise EngineError(FORMAT, "totals")
    if rolled(sums) != checksum:
        raise EngineError(CHECKSUM, "archive")
    return reads




@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 64])
def test_round_trip(n):
    reads = some_reads(n)
    assert decoded(archive([reads])) == reads
    assert archive([reads]) == archive([reads])


def test_frames_pairs_and_levels():
    reads = some_reads(64, longest=2048)
    groups = [reads[k : k + 8] for k in range(0, 64, 8)]
    assert decoded(archive(groups, 2, True)) == reads
    low, high = codec.encode_frame(reads, level=1), codec.encode_frame(reads, level=9)
    assert low.streams[:2] == high.streams[:2] and low.checksum == high.checksum


def test_empty_archive_has_header_and_footer():
    assert len(archive([])) == 72 and decoded(archive([])) == []


def test_every_flipped_byte_is_an_error():
    reads = some_reads(6, longest=40)
    data = archive([reads[:3], reads[3:]])
    for k in range(len(data)):
        bad = bytearray(data)
        bad[k] ^= 1
        try:
            again = decoded(bytes(bad))
        except EngineError:
            continue
        except (zstandard.ZstdError, MemoryError):
            pytest.fail(f"byte {k}")
        assert k == 16 or again == reads, k  # no byte may change reads silently


def fault(data):
    with pytest.raises(EngineError) as e:
        decoded(data)
    return e.value.code


def flipped(data, at, value=None):
    bad = bytearray(data)
    bad[at] = bad[at] ^ 1 if value is None else value
    return bytes(bad)


def test_codes_of_corruption():
    reads = some_reads(4)
    data = archive([reads], paired=True)
    assert fault(flipped(data, 24)) == CHECKSUM
    assert fault(flipped(data, 17, 0x7F)) == UNSUPPORTED
    assert fault(flipped(data, 32 + 8, 9)) == FORMAT  # frame id
    assert fault(flipped(data, len(data) - 1)) == CHECKSUM
    assert fault(flipped(data, len(data) - 24)) == FORMAT  # records
    assert fault(data[:-5]) == FORMAT
    assert fault(data + b"x") == FORMAT
    assert fault(flipped(data, 32 + 12, 3)) == FORMAT  # odd number of records
    for at in range(16, 64, 8):
        assert fault(data[: 32 + at] + b"\xff" * 8 + data[40 + at :]) == FORMAT
    assert fault(codec.FOREIGN + bytes(64)) == UNSUPPORTED
    assert fault(b"NOTMAGIC" + bytes(64)) == FORMAT
    assert fault(codec.MAGIC[:3]) == FORMAT
    with pytest.raises(EngineError) as e:
        codec.read_frame_header(io.BytesIO(data[32:]), 0, True, codec.RESERVE + 100)
    assert e.value.code == FORMAT


def test_changed_stream_with_its_size_kept_is_a_checksum_error():
    reads = some_reads(4)
    f = codec.encode_frame(reads)
    ids = bytearray(zstandard.ZstdDecompressor().decompress(f.streams[0]))
    ids[3] ^= 1
    bad = codec.Frame(f.records, f.bases, f.raw, (zstandard.ZstdCompressor().compress(bytes(ids)), *f.streams[1:]), f.checksum)
    with pytest.raises(EngineError) as e:
        codec.decode_frame(bad)
    assert e.value.code == CHECKSUM


def test_truncated_number_with_right_hashes_is_a_format_error():
    f = codec.encode_frame([(b"r", b"", b"ACGT", b"IIII")])
    raw = [b"\x01\x80", *[zstandard.ZstdDecompressor().decompress(s) for s in f.streams[1:]]]
    bad = codec.Frame(1, 4, tuple(map(len, raw)), tuple(zstandard.ZstdCompressor().compress(x) for x in raw), codec.frame_hash(*raw))
    with pytest.raises(EngineError) as e:
        codec.decode_frame(bad)
    assert e.value.code == FORMAT


@pytest.mark.parametrize("read", [(b"", b"", b"A", b"I"), (b"a b", b"", b"A", b"I"), (b"a", b" \n", b"A", b"I"), (b"a", b"", b"ACGZ", b"IIII"), (b"a", b"", b"ACG", b"III\n"), (b"a", b"", b"ACG", b"II\n"), (b"a", b"", b"", b""), (b"a", b"", b"AC\r", b"III")])
def test_bad_content_is_a_usage_error(read):
    with pytest.raises(EngineError) as e:
        codec.encode_frame([read])
    assert e.value.code == USAGE


def test_limits():
    reads = some_reads(10)
    for kw in ({"level": 0}, {"level": 20}, {"memory": codec.RESERVE + 1000}, {"paired": True}):
        with pytest.raises(EngineError) as e:
            codec.encode_frame(reads[:9] if "paired" in kw else reads, **kw)
        assert e.value.code == USAGE
    assert codec.frame_limit(16 << 30) == 512 << 20 and codec.frame_limit(64 << 20) == 12 << 20


@pytest.mark.parametrize("n", [0, 1, 127, 128, 16383, 16384, 2**32, 2**63, 2**64 - 1])
def test_numbers(n):
    c = codec.Cursor(codec.varint(n))
    assert c.varint() == n
    c.done()


def test_numbers_too_long_or_large():
    for data in (b"\xff" * 10, b"\xff" * 9 + b"\x02", b"\x80" * 11, b"\x80"):
        with pytest.raises(EngineError) as e:
            codec.Cursor(data).varint()
        assert e.value.code == FORMAT


def test_wire_bytes_of_known_archives():
    """The published hashes of the archives of two known inputs; the bytes hold for zstd 1.5.7 only."""
    if zstandard.ZSTD_VERSION != (1, 5, 7):
        pytest.skip("other zstd")
    of = lambda motif: (motif * 50)[:50].encode()
    se = [(b"read%d" % k, b"", of("ACGT"), b"I" * 50) for k in (1, 2, 3)]
    r1 = [(b"pair%d/1" % k, b"", of(m), b"I" * 50) for k, m in enumerate(("ACGT", "CCCA", "GGGGTTTT"), 1)]
    r2 = [(b"pair%d/2" % k, b"", of(m), b"5" * 50) for k, m in enumerate(("TGCA", "AAAT", "TTTTCCCCAAAAGGGG"), 1)]
    assert hashlib.sha256(archive([se])).hexdigest() == "2b1cc50edfa47dd8bd7881a4ee7bb7f4980e693c14d90d90b640fdd62ccc4edf"
    assert hashlib.sha256(archive([[x for p in zip(r1, r2, strict=True) for x in p]], paired=True)).hexdigest() == "11845bd85fa923ebc2e9ae77a8909539a64c2877588f383e1894f6157c97c685"


def test_header_layout():
    assert struct.unpack("<8sHHIBBBBI", codec.global_header(3, True)[:24])[1:6] == (2, 32, 1, 3, 1)


def test_a_large_read_fits_where_its_peak_does_and_no_lower():
    n = 5 << 20
    read = (b"r", b"", b"ACGT" * (n // 4), b"I" * n)
    peak = codec.compress_peak([read], codec.raw_streams([read]))
    assert codec.encode_frame([read], memory=64 << 20).bases == n
    assert 38 << 20 < peak < 39 << 20
    many = [(b"r%d" % k, b" c", b"ACGTN" * 30, b"I" * 150) for k in range(40_000)]
    peak = codec.compress_peak(many, codec.raw_streams(many))
    codec.encode_frame(many, memory=peak)
    with pytest.raises(EngineError, match="more than the memory limit"):
        codec.encode_frame(many, memory=peak - 1)
