"""XXH64 with seed 0: as an expression of the JVM where the session is a classic one, as Arrow batches elsewhere."""

from __future__ import annotations

import struct

import pandas as pd
import xxhash
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def xxh64(spark: SparkSession, *columns: Column) -> Column:
    """The hash of the first column seeds that of the next, and so on; the first one's seed is 0. As a signed long."""
    try:
        jvm = spark._jvm
        utils = jvm.org.apache.spark.sql.classic.ExpressionUtils
        nodes = jvm.java.util.ArrayList()
        for c in columns:
            nodes.add(utils.expression(c._jc))
        made = jvm.org.apache.spark.sql.catalyst.expressions.XxHash64(jvm.org.apache.spark.api.python.PythonUtils.toSeq(nodes), 0)
        return Column(utils.column(made))
    except (AttributeError, TypeError):
        return chained(*columns)


def chained(*columns: Column) -> Column:
    """xxh64() by the library, in Arrow batches: only for sessions of Spark Connect, which have no JVM at hand."""

    def run(*columns: pd.Series) -> pd.Series:
        out = []
        for row in zip(*columns, strict=True):
            h = 0
            for x in row:
                h = xxhash.xxh64_intdigest(x, h)
            out.append(h - (1 << 64) if h >> 63 else h)
        return pd.Series(out)

    run.__annotations__ = {"columns": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "long")(*columns)


def rolled(checksums) -> int:
    """The fold of frame checksums in order, each hashed under the last: unsigned."""
    now = 0
    for c in checksums:
        now = xxhash.xxh64_intdigest(struct.pack("<Q", c & (1 << 64) - 1), now)
    return now
