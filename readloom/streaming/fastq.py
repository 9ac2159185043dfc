"""A folder of FASTQ files as a stream: each new file is read whole, gzipped or not, and becomes reads.

Files are taken by Spark's binaryFile source, so they may be in any store that Spark reads; a file is one row, and
its records are parsed in one task. Output is append-only; a file's reads have its name and their byte offsets.
"""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from readloom.errors import IO, EngineError
from readloom.sources.container import sniff
from readloom.sources.fastq import Parser

SCHEMA = "file string, byte_offset long, id string, comment string, sequence string, quality string"
ROWS = 10_000


def parsed(files: DataFrame) -> DataFrame:
    """Reads of files (path, content), batch or stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py()
                if (kind := sniff(data[:8])) == "gzip":
                    try:
                        data = gzip.decompress(data)
                    except (OSError, EOFError, zlib.error) as e:
                        raise EngineError(IO, f"{path}: bad gzip data: {e}") from None
                elif kind != "none":
                    raise EngineError(IO, f"{path}: {kind} is not supported")
                parser, rows = Parser(io.BytesIO(data)), []
                while (r := parser.read()) is not None:
                    rows.append(r)
                    if len(rows) == ROWS:
                        yield rows_of(path, rows)
                        rows = []
                if rows:
                    yield rows_of(path, rows)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def rows_of(path: str, rows: list[tuple]) -> pa.RecordBatch:
    offset, *text = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(offset, pa.int64()), *[pa.array([x.decode("latin-1") for x in col], pa.string()) for col in text]], names=["file", "byte_offset", "id", "comment", "sequence", "quality"])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Reads of whole files at a path that Spark reads; for files too large for a task, the fastq source has byte ranges."""
    return parsed(spark.read.format("binaryFile").load(path))


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    return parsed(spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder))
