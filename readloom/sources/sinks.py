"""FASTQ as a sink: parts by tasks, and one file from them in order."""

from __future__ import annotations

import gzip
import shutil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.errors import IO, EngineError
from readloom.functions.records import rendered
from readloom.sources import store


def write_parts(reads: DataFrame, folder: str, *order: str) -> None:
    """Text parts whose names sort as their reads do."""
    text = reads.repartitionByRange(*order).sortWithinPartitions(*order).select(F.encode(F.rtrim(rendered(), F.lit("\n")), "ISO-8859-1").cast("string"))
    text.write.option("lineSep", "\n").text(folder)


def write_file(reads: DataFrame, path: str, *order: str, force: bool = False, compress: bool = False) -> None:
    """One file, at a path or an address that driver and tasks share. It appears when it's whole."""
    if store.exists(path) and not force:
        raise EngineError(IO, f"{path} exists")
    parts = f"{path}.parts"
    try:
        write_parts(reads, store.address(parts), *order)
        with store.created(f"{path}.tmp") as file:
            out = gzip.GzipFile(fileobj=file, mode="wb") if compress else file
            for part in store.parts(parts):
                with store.opened(part) as f:
                    shutil.copyfileobj(f, out, 1 << 20)
            if compress:
                out.close()
        store.moved(f"{path}.tmp", path)
    finally:
        store.removed(parts)
        store.removed(f"{path}.tmp")
