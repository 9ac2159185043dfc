import gzip
import io
import random

import pytest

from readloom.errors import FORMAT, IO, EngineError
from readloom.sources import container
from readloom.sources import fastq
from readloom.sources.fastq import Parser, Part, bulk, first_record, pair_cuts, ranges, records


def parsed(data):
    p = Parser(io.BytesIO(data))
    out = []
    while (r := p.read()) is not None:
        out.append(r[1:])
    return out, p


def test_header_split_blanks_and_cr():
    got, p = parsed(b"\n\n@r1   x\r\nAC\r\n+any\r\nII\r\n\n@r2 \nA\n+\nI\n\n@r3\nN\n+\n!")
    assert got == [(b"r1", b"   x", b"AC", b"II"), (b"r2", b" ", b"A", b"I"), (b"r3", b"", b"N", b"!")]
    assert (p.records, p.offset, p.lines) == (3, 47, 16)


def test_only_one_cr_goes():
    assert parsed(b"@a\nA\r\r\n+\nI!\n")[0] == [(b"a", b"", b"A\r", b"I!")]


@pytest.mark.parametrize("data", [b"a\nA\n+\nI\n", b"@\nA\n+\nI\n", b"@ x\nA\n+\nI\n", b"@a\n\n+\n\n", b"@a\nA\nI\nI\n", b"@a\nAC\n+\nI\n", b"@a\nA\n+\n", b"@a\nA\n", b"@a"])
def test_malformed(data):
    with pytest.raises(EngineError) as e:
        parsed(data)
    assert e.value.code == FORMAT


def split(path, k):
    """All ranges' records; the bulk way must give the same, or fail as well."""
    parts = ranges(str(path), k)
    try:
        many = [r for p in parts for rows in bulk(p) for r in rows]
    except EngineError as e:
        with pytest.raises(EngineError) as f:
            [r for p in parts for r in records(p)]
        assert e.code == f.value.code
        raise
    out = [r for p in parts for r in records(p)]
    assert [r[2:] for r in out] == many
    return out


@pytest.fixture(autouse=True, params=[1 << 22, 97])
def block(request, monkeypatch):
    monkeypatch.setattr(fastq, "BLOCK", request.param)


def fuzz(rnd, n):
    out = []
    for k in range(n):
        size = rnd.choice([1, 3, 40, 150])
        quality = "".join(rnd.choice("@+I!~A") for _ in range(size))
        if rnd.random() < 0.4:
            quality = "@" + quality[1:]
        end = rnd.choice(["\n", "\r\n"])
        out.append(f"@r@{k}{rnd.choice(['', ' ', ' @x'])}{end}{'ACGTN'[k % 5] * size}{end}+{rnd.choice(['', 'r', '@'])}{end}{quality}{end}{rnd.choice(['', '', end])}")
    return "".join(out).encode()


@pytest.mark.parametrize("seed", range(12))
def test_ranges_give_what_one_scan_gives(tmp_path, seed):
    rnd = random.Random(seed)
    path = tmp_path / "a.fastq"
    path.write_bytes(fuzz(rnd, rnd.choice([1, 3, 60])))
    want = list(records(Part(0, str(path))))
    for k in (2, 3, 4, 8, 33):
        assert split(path, k) == want


def test_quality_that_begins_like_a_header(tmp_path):
    path = tmp_path / "a.fastq"
    path.write_bytes(b"".join(b"@read_%d comment\n%b\n+\n@%b\n" % (k, b"A" * 150, b"I" * 149) for k in range(1200)))
    assert len(split(path, 4)) == 1200 and split(path, 4) == split(path, 1)


def test_bad_letter_hides_no_record(tmp_path):
    path = tmp_path / "a.fastq"
    path.write_bytes(b"@r0\n%b\n+\n%b\n@r1\nAZ\n+\nII\n@r2\nA\n+\nI\n" % (b"A" * 3000, b"I" * 3000))
    assert [r[2] for r in split(path, 2)] == [b"r0", b"r1", b"r2"]


@pytest.mark.parametrize("tail", [b"@trunc\nAAA", b"@trunc\nAAA\n+\n", b"@bad\nAA\n+\nI\n@r2\nA\n+\nI\n", b"@bad\nAA\nII\n@r2\nA\n+\nI\n"])
def test_bad_tail_is_loud_for_any_ranges(tmp_path, tail):
    path = tmp_path / "a.fastq"
    path.write_bytes(b"@r0\n%b\n+\n%b\n" % (b"A" * 300, b"I" * 300) + tail)
    for k in range(1, 40):
        with pytest.raises(EngineError) as e:
            split(path, k)
        assert e.value.code == FORMAT


def test_first_record():
    f = io.BytesIO(b"@a\nA\n+\n@\n@b\nC\n+\nI\n")
    assert [first_record(f, k) for k in (0, 1, 9, 10)] == [0, 9, 9, None]


def test_pairs(tmp_path):
    one, two = tmp_path / "1", tmp_path / "2"
    one.write_bytes(b"@a/1\nA\n+\nI\n@b/1\nC\n+\nI\n")
    two.write_bytes(b"@a/2\nG\n+\nI\n@x\nT\n+\nI\n")
    assert [(r[0], r[2]) for r in records(Part(0, str(one), str(two)))] == [(1, b"a/1"), (2, b"a/2"), (1, b"b/1"), (2, b"x")]
    two.write_bytes(b"@a/2\nG\n+\nI\n")
    for a, b in ((one, two), (two, one)):
        with pytest.raises(EngineError) as e:
            list(records(Part(0, str(a), str(b))))
        assert e.value.code == FORMAT


def split_pairs(one, two, k):
    """What all ranges of a pair give, read either way."""
    counts = [[(p.chunk, p.start, p.end, sum(map(len, bulk(p)))) for p in ranges(str(x), k)] for x in (one, two)]
    parts = [Part(c, str(one), str(two), a, b, m) for c, (a, b, m) in enumerate(pair_cuts(*counts))]
    out = [r for p in parts for r in records(p)]
    assert [r[2:] for r in out] == [r for p in parts for rows in bulk(p) for r in rows]
    return out


@pytest.mark.parametrize("seed", range(8))
def test_ranges_of_pairs_give_what_one_scan_gives(tmp_path, seed):
    rnd = random.Random(seed)
    one, two = tmp_path / "1", tmp_path / "2"
    n = rnd.choice([0, 1, 3, 60])
    one.write_bytes(fuzz(rnd, n))
    two.write_bytes(fuzz(rnd, n))
    want = list(records(Part(0, str(one), str(two))))
    assert len(want) == 2 * n and [r[2:] for r in want] == [r for rows in bulk(Part(0, str(one), str(two))) for r in rows]
    for k in (2, 3, 4, 8, 33):
        assert split_pairs(one, two, k) == want
    two.write_bytes(two.read_bytes() + b"@more\nA\n+\nI\n")
    for a, b in ((one, two), (two, one)):
        with pytest.raises(EngineError) as e:
            split_pairs(a, b, 4)
        assert e.value.code == FORMAT


def test_mates_that_all_lie_in_one_range(tmp_path):
    one, two = tmp_path / "1", tmp_path / "2"
    one.write_bytes(b"".join(b"@r%d/1\n%b\n+\n%b\n" % (k, b"A" * 50, b"I" * 50) for k in range(40)))
    two.write_bytes(b"".join(b"@r%d/2\n%b\n+\n%b\n" % (k, *[(b"C" if k < 39 else b"C" * 9000)] * 2) for k in range(40)))
    for k in (2, 5, 16):
        assert [r[2] for r in split_pairs(one, two, k)] == [b"r%d/%d" % (k, m) for k in range(40) for m in (1, 2)]


def test_containers(tmp_path):
    text = b"@a\nA\n+\nI\n"
    p = tmp_path / "plain.gz"
    p.write_bytes(text)  # the name says gzip, the bytes do not
    assert len(list(records(Part(0, str(p))))) == 1
    g = tmp_path / "named.fastq"
    g.write_bytes(gzip.compress(text) + gzip.compress(text))
    assert len(list(records(Part(0, str(g))))) == 2 and len(ranges(str(g), 8)) == 1
    for data in (gzip.compress(text * 500)[:-9], gzip.compress(text) + b"junk"):
        g.write_bytes(data)
        with pytest.raises(EngineError) as e:
            list(records(Part(0, str(g))))
        assert e.value.code == IO
    for magic in (b"BZh9", bytes.fromhex("fd377a585a00"), bytes.fromhex("28b52ffd00")):
        g.write_bytes(magic + bytes(20))
        with pytest.raises(EngineError) as e:
            container.opened(str(g))
        assert e.value.code == IO
    g.write_bytes(b"")
    assert list(records(Part(0, str(g)))) == [] and split(g, 4) == []
    with pytest.raises(EngineError) as e:
        container.opened(str(tmp_path / "missing"))
    assert e.value.code == IO
    assert [container.by_extension(x) for x in ("a.GZ", "a.lzma", "a.b/c", "a.zstd")] == ["gzip", "xz", "none", "zstd"]
    one = tmp_path / "one.gz"
    one.write_bytes(b"@")
    assert container.container(str(one)) == ("gzip", 1)
