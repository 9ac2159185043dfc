"""Each query with SQL gives what DuckDB gives for it, in values, names and types."""

import os
from functools import partial

import duckdb
import pytest

from readloom.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "tinyint": "TINYINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert {c: TYPES[t] for c, t in df.dtypes} == dict(zip(want.columns, map(str, want.types), strict=True))
    at = [want.columns.index(c) for c in columns]
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["q_totals", "q_operation_stats"])
def test_totals_of_chunks_of_several_frames(spark, duck, monkeypatch, name):
    from readloom.operators import framing
    from readloom.queries import frames

    monkeypatch.setattr(framing, "encode", partial(framing.encode, target=1 << 14))
    assert frames(spark, SF).count() > 16
    row = QUERIES[name](spark, SF).first()
    want = duck.sql(SQL[name])
    assert row.asDict() == dict(zip(want.columns, want.fetchall()[0], strict=True))


def test_all_but_two_have_sql():
    assert set(QUERIES) - set(SQL) == {"q_frame_checksum", "q_global_checksum"}


def test_checksums_against_the_library(spark):
    import xxhash
    import zstandard
    from pyspark.sql import functions as F

    from readloom.functions.hashing import rolled, xxh64
    from readloom.operators.framing import numbered
    from readloom.queries import frames, reads

    want = {}
    for r in reads(spark, SF).collect():
        h = 0
        for x in (r.id, r.sequence, r.quality):
            h = xxhash.xxh64_intdigest(x.encode(), h)
        want[r.k] = h
    each = reads(spark, SF).select("k", xxh64(spark, *[F.encode(c, "ISO-8859-1") for c in ("id", "sequence", "quality")]).alias("checksum"))
    assert {r.k: r.checksum & (1 << 64) - 1 for r in each.collect()} == want
    whole = {}
    for f in numbered(frames(spark, SF)).collect():
        h = 0
        for x in (f.ids, f.sequences, f.qualities):
            h = xxhash.xxh64_intdigest(zstandard.ZstdDecompressor().decompress(x), h)
        whole[f.frame_id] = (f.record_count, h)
    assert {r.frame_id: (r.record_count, r.checksum & (1 << 64) - 1) for r in QUERIES["q_frame_checksum"](spark, SF).collect()} == whole
    row = QUERIES["q_global_checksum"](spark, SF).first()
    sums = [r.checksum for r in numbered(frames(spark, SF)).orderBy("frame_id").collect()]
    assert (row.frames, row.checksum & (1 << 64) - 1) == (len(sums), rolled(sums))
