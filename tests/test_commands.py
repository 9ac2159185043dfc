import gzip
import random
import sys

import pytest

from readloom.cli import main
from readloom.errors import EngineError
from readloom.plans import commands as k


def text(n=200, seed=1, comment=True):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        size = rnd.randint(1, 150)
        out.append(f"@r{i}{' x ' if comment and i % 3 else ''}\n{''.join(rnd.choices('ACGTNacg', k=size))}\n+\n{''.join(rnd.choices('!#@IJ~', k=size))}\n")
    return "".join(out).encode()


@pytest.mark.parametrize("workers,frame", [(0, 64 << 20), (1, 4096), (4, 4096), (16, 1000)])
def test_round_trip(spark, tmp_path, workers, frame):
    a, b, c = (str(tmp_path / x) for x in ("a.fastq", "b", "c.fastq"))
    open(a, "wb").write(text())
    s = k.compress(spark, k.CompressRequest(input=a, output=b, workers=workers, frame_bytes=frame))
    assert (s.profile, s.records, s.paired) == ("illumina", 200, False)
    v = k.verify(spark, k.VerifyRequest(input=b))
    assert (v.records, v.bases, v.frames) == (s.records, s.bases, s.frames)
    d = k.decompress(spark, k.DecompressRequest(input=b, output=c))
    assert open(c, "rb").read() == text() and d.output_bytes == len(text())
    assert v.frame(spark).first().records == 200
    open(b + ".gz", "wb").write(gzip.compress(open(b, "rb").read()))
    assert k.verify(spark, k.VerifyRequest(input=b + ".gz")).records == 200
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.fastq", "b", "b.gz", "c.fastq"]


def test_sequential_paths_agree(spark, tmp_path):
    a = str(tmp_path / "a.fastq")
    open(a, "wb").write(text())
    open(a + ".gz", "wb").write(gzip.compress(text()))
    for name, path, workers in (("0", a, 0), ("1", a, 1), ("g", a + ".gz", 4)):
        k.compress(spark, k.CompressRequest(input=path, output=str(tmp_path / name), workers=workers, frame_bytes=5000))
    assert (tmp_path / "0").read_bytes() == (tmp_path / "1").read_bytes() == (tmp_path / "g").read_bytes()


def test_sink(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    open(a, "wb").write(text(20))
    k.compress(spark, k.CompressRequest(input=a, output=b, frame_bytes=500))
    got = []
    k.decompress(spark, k.DecompressRequest(input=b, output=str(tmp_path / "c")), sink=got.append)
    assert b"".join(got) == text(20)

    def refuse(_):
        raise EngineError(2, "no room")

    with pytest.raises(EngineError):
        k.decompress(spark, k.DecompressRequest(input=b, output=str(tmp_path / "d")), sink=refuse)
    assert not (tmp_path / "d").exists()


def test_command_line(spark, tmp_path, capfdbinary):
    run = lambda *a: main([str(x) for x in a], spark)
    one, two, out, back = (tmp_path / x for x in ("1.fastq", "2.fastq", "a", "back"))
    one.write_bytes(text(6))
    two.write_bytes(text(6, seed=2))
    assert run("-q", "c", "-1", one, "-2", two, "-o", out, "--profile", "ont") == 0
    assert run("x", "-i", out, "-o", back, "-q") == 0
    pairs = list(zip(*[iter(back.read_bytes().split(b"\n")[:-1])] * 4, strict=True))
    assert [b"\n".join(p) for p in pairs[::2]] == [b"\n".join(p) for p in zip(*[iter(text(6).split(b"\n")[:-1])] * 4, strict=True)]
    assert run("verify", out) == 0 and run("v", "-i", out, "--memory-limit", "64") == 0
    capfdbinary.readouterr()
    assert run("-q", "d", "-i", out, "-o", "-") == 0
    sys.stdout.flush()
    assert run("compress", "-i", one, "-o", out) == 2  # exists
    assert run("compress", "-i", one, "-o", one, "-f") == 1
    assert run("compress", "-i", one, "-2", two, "-o", two, "-f") == 1
    assert run("compress", "-i", "-", "-2", "-", "-o", tmp_path / "z") == 1
    assert run("compress", "-i", tmp_path / "none", "-o", tmp_path / "z") == 2
    assert run("compress", "-i", one, "-o", tmp_path / "z", "--memory-limit", "63") == 1
    assert run("compress", "-i", one, "-o", tmp_path / "z", "--quality-level", "20") == 1
    assert run("nothing") == 1 and run("--version") == 0 and run("verify") == 1
    two.write_bytes(text(5, seed=2))
    assert run("compress", "-i", one, "-2", two, "-o", tmp_path / "z") == 3
    two.write_bytes(b"@a\nAZ\n+\nII\n")
    assert run("compress", "-i", two, "-o", tmp_path / "z") == 1
    two.write_bytes(b"@u\n" + b"A" * 2000 + b"\n+\n" + b"I" * 2000 + b"\n")
    assert run("compress", "-i", two, "-o", tmp_path / "z") == 1  # ambiguous
    bad = bytearray(out.read_bytes())
    bad[17] = 0x7F
    out.write_bytes(bytes(bad))
    assert run("verify", out) == 5
    bad[17], bad[-1] = 1, bad[-1] ^ 1
    out.write_bytes(bytes(bad))
    assert run("verify", out) == 4
    out.write_bytes(bytes(bad[:-3]))
    assert run("verify", out) == 3
    assert not (tmp_path / "z").exists() and not [p for p in tmp_path.iterdir() if ".tmp." in p.name]


@pytest.mark.parametrize("workers", [1, 3, 7])
def test_split_pairs(spark, tmp_path, workers):
    one, two, out, back = (tmp_path / x for x in ("1.fastq", "2.fastq", "a", "back"))
    one.write_bytes(text(90))
    two.write_bytes(text(90, seed=2))
    whole = k.reads_of(spark, str(one), str(two)).select("mate", "id", "comment", "sequence", "quality").collect()
    cut = k.reads_of(spark, str(one), str(two), workers, split_pairs=True)
    assert cut.rdd.getNumPartitions() == workers
    assert cut.orderBy("chunk", "place").drop("file", "chunk", "place", "byte_offset").collect() == whole
    s = k.compress(spark, k.CompressRequest(input=str(one), output=str(out), mate=str(two), workers=workers, split_pairs=True, frame_bytes=4096))
    assert (s.records, s.paired) == (180, True) and s.frames >= workers
    k.decompress(spark, k.DecompressRequest(input=str(out), output=str(back)))
    assert back.read_text() == "".join(f"@{r.id}{r.comment}\n{r.sequence}\n+\n{r.quality}\n" for r in whole)
    (tmp_path / "2.gz").write_bytes(gzip.compress(two.read_bytes()))
    assert k.reads_of(spark, str(one), str(tmp_path / "2.gz"), workers, split_pairs=True).rdd.getNumPartitions() == 1
    two.write_bytes(text(89, seed=2))
    assert main(["compress", "-1", str(one), "-2", str(two), "-o", str(tmp_path / "z"), "--split-pairs", "--parse-workers", str(workers)], spark) == 3


def test_empty_input(spark, tmp_path):
    (tmp_path / "e.fastq.gz").write_bytes(b"")
    k.compress(spark, k.CompressRequest(input=str(tmp_path / "e.fastq.gz"), output=str(tmp_path / "a")))
    assert (tmp_path / "a").stat().st_size == 72
    k.decompress(spark, k.DecompressRequest(input=str(tmp_path / "a"), output=str(tmp_path / "b")))
    assert (tmp_path / "b").read_bytes() == b""


@pytest.mark.parametrize("name,comment,n,want", [("read", "", 4, "illumina"), ("abc", " runid=123 ch=7", 2000, "ont"), ("m64011_220101_010101/42/ccs", "", 2000, "pacbio-hifi"), ("m64011_220101_010101/42/0_2000", "", 2000, "pacbio-clr"), ("DRR171398.1", " 1/1", 16340, "ont"), ("SRR2962693.1", " 1/1", 126, "illumina"), ("SRR2962693.1", " /ccs", 2000, "pacbio-hifi")])
def test_profiles(spark, tmp_path, name, comment, n, want):
    p = tmp_path / "a"
    p.write_text(f"@{name}{comment}\n{'A' * n}\n+\n{'I' * n}\n")
    assert k.detect(spark, str(p), None, 1 << 30) == want
