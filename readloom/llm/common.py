"""What the operators of this package share: reading tables, cutting lineage, size-checked broadcasts, bounded batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

#: Rows that a side may have, as counted, to be sent to every executor.
BROADCAST_ROWS = 200_000
#: And bytes, as text.
BROADCAST_BYTES = 64 << 20
#: Bytes of the rows that a Python worker is sent at once; Spark's 10,000 rows of long texts fill memory outside the heap and the worker's.
BATCH_BYTES = 2 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"

#: ASCII white space of the word pattern [^\x20\x09-\x0D]+ ; bytes.split() splits on just these.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where that is unset, a local master gets one of our own; a cluster must name one."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if at is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="readloom-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(at)
    return at


def stored(df: DataFrame) -> DataFrame:
    """df, written once as Parquet in the shared folder and read back: its lineage is cut, and losing an executor loses none of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/readloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_or_not(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Hints a broadcast of df if a count proves that it has so few rows and bytes; else Spark shuffles it. df should be stored()."""
    wide = [f.name for f in df.schema if isinstance(f.dataType, (ArrayType, BinaryType, MapType, StringType, StructType))]
    if (n := df.count()) > rows:
        return df
    text = df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*wide)))), F.lit(0))).first()[0] if wide else 0
    return F.broadcast(df) if text + 16 * n * len(df.columns) <= size else df


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow(run, schema) by batches of BATCH_BYTES, or of one longer row. Spark reads the bound when the plan runs, so the session keeps it."""
    df.sparkSession.conf.set(BATCH_CONF, f"{BATCH_BYTES}b")
    return df.mapInArrow(run, schema)


def own_names(df: DataFrame, *names: str) -> dict[str, str]:
    """A column name for each name that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, {}
    for name in names:
        out[name] = next(c for k in range(len(taken) + len(names) + 1) if (c := f"__{name}{k or ''}") not in taken)
        taken.add(out[name])
    return out


def ascii_lower(text: Column) -> Column:
    """Only A-Z become lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def digest(text: Column) -> Column:
    """16 bytes that name a text; null counts as empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))
