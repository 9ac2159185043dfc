import pytest

from readloom.plans import commands as k
from readloom.sources.archive import directory


@pytest.fixture
def made(spark, tmp_path):
    a, b = str(tmp_path / "a.fastq"), str(tmp_path / "a.archive")
    with open(a, "w") as f:
        f.writelines(f"@r{i} c{i}\n{'ACGTN' * (i % 7 + 1)}\n+\n{'IIII!' * (i % 7 + 1)}\n" for i in range(300))
    k.compress(spark, k.CompressRequest(input=a, output=b, profile="ont", frame_bytes=3000, workers=3))
    return b


def test_frames_and_their_headers(spark, made):
    d = directory(made)
    rows = spark.read.format("reads_archive").options(path=made, mode="frames", run_bytes=1).load().orderBy("frame_id").collect()
    assert [r.frame_id for r in rows] == list(range(len(d.frames))) and d.records == 300
    assert [(r.record_count, r.raw_ids_size) for r in rows] == [(e.records, e.raw[0]) for e in d.frames]
    assert sum(r.total_bases for r in rows) == d.bases == sum(5 * (i % 7 + 1) for i in range(300))


def test_streams_are_pruned(spark, made):
    rows = spark.read.format("reads_archive").options(path=made, mode="frames", streams="ids").load().collect()
    assert all(r.ids and r.sequences is None and r.qualities is None and r.total_bases is None for r in rows)


def test_reads_by_sql(spark, made):
    spark.read.format("reads_archive").option("path", made).load().createOrReplaceTempView("archived")
    row = spark.sql("select count(*) as n, max(length(sequence)) as longest, count(distinct frame_id) as frames from archived where comment like ' c%'").first()
    assert (row.n, row.longest, row.frames) == (300, 35, len(directory(made).frames))
