import random
import time

import pytest
from pyspark.sql import functions as F

from readloom.functions import codec, hashing, packing
from readloom.operators import framing, measure, ordering, pairing
from readloom.queries import reads

SF = "/root/testdata/sf0.001"
COLUMNS = "ordinal long, id string, comment string, sequence string, quality string"


def fold(costs, target, paired=False):
    out, frame, total, n = [], 0, 0, 0
    for c in costs:
        out.append(frame)
        total, n = total + c, n + 1
        if total >= target and not (paired and n % 2):
            frame, total, n = frame + 1, 0, 0
    return out


@pytest.mark.parametrize("paired", [False, True])
def test_framing_is_the_plain_fold(spark, paired):
    rnd = random.Random(2)
    rows = [(k, "r", "", "A" * (n := rnd.randint(1, 200)), "I" * n) for k in range(500)]
    rnd.shuffle(rows)
    got = {r.key: r.frame for r in framing.assign(spark.createDataFrame(rows, COLUMNS), target=1000, paired=paired).collect()}
    costs = [101 + 2 * len(s) for _, _, _, s, _ in sorted(rows)]
    assert [got[k] for k in range(500)] == fold(costs, 1000, paired)


def test_greedy_framing_of_a_table(spark):
    rows = reads(spark, SF)
    want = [r.c for r in rows.selectExpr("ordinal", "length(id) + length(comment) + 2 * length(sequence) + 100 as c").orderBy("ordinal").collect()]
    got = framing.assign(rows, target=65_536).orderBy("key").collect()
    assert [r.frame for r in got] == fold(want, 65_536)


def test_pairs_of_unequal_length_fail(spark):
    make = lambda n: spark.createDataFrame([(k, f"r{k}", "", "A", "I") for k in range(n)], COLUMNS)
    assert pairing.zipped(make(3), make(3)).count() == 3
    for a, b in ((3, 2), (2, 3)):
        with pytest.raises(Exception, match="different record counts"):
            pairing.zipped(make(a), make(b)).collect()


def test_hashes_of_both_ways(spark):
    rows = spark.createDataFrame([(bytes(range(n % 256)) * (1 + n // 100), b"x" * n, b"") for n in range(0, 300, 7)], "a binary, b binary, c binary")
    made = rows.select(hashing.xxh64(spark, rows.a, rows.b, rows.c).alias("x"), hashing.chained(rows.a, rows.b, rows.c).alias("y")).collect()
    assert all(r.x == r.y for r in made)
    sums = spark.createDataFrame([([5, -7, 0, 1 << 62],)], "v array<long>")
    x = sums.select(hashing.xxh64(spark, sums.v)).first()[0]
    assert x & (1 << 64) - 1 == hashing.rolled([5, -7, 0, 1 << 62])


def test_contiguous_and_committed(spark):
    items = spark.createDataFrame([(k,) for k in (3, 0, 1, 1, 5)], "frame_id long")
    r = ordering.contiguous(items).first()
    assert (r.first, r["last"], r.n, r.gaps) == (0, 5, 4, 2)
    assert [x.frame_id for x in ordering.committed(items, "frame_id").collect()] == [0, 1, 3, 5]


def test_ordinals_over_buckets(spark):
    keys = [k * 1000 - 50_000 for k in range(300)]
    got = ordering.ordinals(spark.createDataFrame([(k,) for k in keys[::-1]], "k long"), "k", 10_000).collect()
    assert {r.k: r.ordinal for r in got} == {k: i for i, k in enumerate(keys)}


def test_bad_records_end_the_job(spark):
    from readloom.functions.records import asserted

    rows = spark.createDataFrame([(0, "a", "", "AC", "II"), (1, "b", "", "AZ", "II")], COLUMNS)
    with pytest.raises(Exception, match="bad sequence of record b"):
        rows.filter(asserted()).collect()


def test_the_encoder_checks_the_peak_that_measures_estimate(spark):
    rows = [(f"r{k}", " c" if k % 2 else "", "ACGTN"[k % 5 :] + "GATTACAR"[: k % 8] + "A" * (k % 70), "I") for k in range(300)]
    rows = [(i, c, s, q * len(s)) for i, c, s, q in rows]
    frame = spark.createDataFrame(rows, "id string, comment string, sequence string, quality string")
    reads = [tuple(x.encode() for x in r) for r in rows]
    raw = codec.raw_streams(reads)
    got = measure.measured(frame).withColumn("peak", measure.compress_peak()).first()
    assert [got.raw_ids, got.raw_sequences, got.raw_qualities] == list(map(len, raw))
    assert got.peak == codec.compress_peak(reads, raw)


def test_packing_takes_no_longer_for_long_reads(spark):
    """The same bases as short reads and as long ones; a loop that finds each letter from the start takes 100 times as long."""
    took = []
    for n in (100, 20_000):
        made = f"substr(repeat(translate(md5(cast(id as string)), '0123456789abcdef', 'ACGTACGTACGTNacg'), {n // 32 + 1}), 1, {n})"
        frame = spark.range(0, 1_000_000 // n, 1, 2).select(F.expr(made).alias("sequence")).cache()
        work = frame.select(F.length(packing.packed_hex()), F.size(packing.exception_deltas()), packing.exception_bytes())
        work.write.format("noop").mode("overwrite").save()
        began = time.time()
        work.write.format("noop").mode("overwrite").save()
        took.append(time.time() - began)
    assert took[1] < 5 * took[0] + 1


def test_encoded_bytes_are_the_archive_less_its_header_and_footer(spark, tmp_path):
    from readloom.plans import commands
    from readloom.queries import fastq_file

    path = fastq_file(spark, SF, "a.fastq")
    for workers in (1, 3):
        commands.compress(spark, commands.CompressRequest(input=path, output=f"{tmp_path}/{workers}", frame_bytes=1 << 16, workers=workers))
        got = measure.totals(commands.frames_of(spark, path, workers=workers, target=1 << 16)).first()
        assert got.encoded_bytes == (tmp_path / str(workers)).stat().st_size - codec.HEADER_SIZE - codec.FOOTER_SIZE and got.frame_count > 3


def test_frame_checksums_are_of_the_raw_streams(spark):
    import xxhash
    import zstandard

    from readloom.queries import frames

    for f in frames(spark, SF).collect():
        h = 0
        for data in (f.ids, f.sequences, f.qualities):
            h = xxhash.xxh64_intdigest(zstandard.ZstdDecompressor().decompress(data), h)
        assert h == f.checksum & (1 << 64) - 1


def test_inputs_by_address(spark, tmp_path):
    from readloom.plans import commands
    from readloom.queries import fastq_file

    path = fastq_file(spark, SF, "a.fastq")
    out, back = (f"file://{tmp_path}/{x}" for x in ("a", "b"))
    commands.compress(spark, commands.CompressRequest(input=f"file://{path}", output=out, workers=3))
    commands.decompress(spark, commands.DecompressRequest(input=out, output=back))
    with open(path, "rb") as a, open(f"{tmp_path}/b", "rb") as b:
        assert a.read() == b.read()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "b"]
