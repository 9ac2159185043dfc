"""Documents to token counts in five stages, each an operator of readloom.llm over all that the stage before it kept.

A null text is empty and goes with the first stage, as a text without words does; a null source is the source ''; a row
without an id goes if a near copy of it has one, else it stays to the end. Repeated rows stay or go together. Very long texts
are worked on whole in every stage. Tables without rows pass through all of them. Further columns of documents, whatever their
names, are kept up to the last stage, which returns the columns of its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import bpe, mixing, quality, secrets, simhash
from readloom.llm.common import stored, table
from readloom.llm.queries import vocabulary


#: What the rows of a run are sorted by in the order of the mix: part of the mix and row in it.
PLACE = ("mix_part", "mix_row")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents of a source share go, and documents that fail the rules or have too little left."""
    return quality.clean(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of copies and near copies (5-word shingles, similarity 0.8) the earliest document stays."""
    return simhash.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind."""
    return secrets.redact(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, ordered so that each source keeps to its target weight within a block."""
    return mixing.mix(docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of what they decode to; and PLACE if docs have it."""
    return bpe.encode_documents(docs, vocabulary(), carried=PLACE if set(PLACE) <= set(docs.columns) else ())


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mixing_sources),
    ("BPE encoding and decoding", bpe_tokens),
]

#: Hash windows, classes of near copies and BPE are not for SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
        if stage is mixing_sources:  # reading splits and packs files by size, so the order is taken from where rows were written
            part = F.regexp_extract("_metadata.file_name", "^part-([0-9]+)", 1).cast("long")
            docs = docs.select("*", part.alias(PLACE[0]), F.col("_metadata.row_index").alias(PLACE[1]))
    return docs
