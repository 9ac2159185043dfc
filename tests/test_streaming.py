import gzip

from readloom.functions.records import asserted
from readloom.operators.profile import votes
from readloom.streaming.fastq import read_files, read_stream


def test_files_stream_in(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.fastq").write_bytes(b"@a x\nAC\n+\nII\n@b\nA\n+\nI\n")
    q = read_stream(spark, f"file://{tmp_path}/in").filter(asserted()).writeStream.format("memory").queryName("reads_in").option("checkpointLocation", f"file://{tmp_path}/ck").start()
    q.processAllAvailable()
    (tmp_path / "in/b.fastq.gz").write_bytes(gzip.compress(b"@c\nG\n+\nI\n"))
    q.processAllAvailable()
    q.stop()
    got = spark.table("reads_in").orderBy("id").collect()
    assert [(r.id, r.comment, r.byte_offset) for r in got] == [("a", " x", 0), ("b", "", 13), ("c", "", 0)]
    assert votes(read_files(spark, f"file://{tmp_path}/in")).first().records == 3
