"""Secret scans over a ledger of blobs.

Every version of every text is a blob, named by its SHA-256. The ledger, Parquet in a shared folder, holds the
blobs scanned under each version of the rules, with what was found. A run scans only the pairs of blob and rule
version that it lacks, adds them, and joins findings back to all documents that hold the blob. Unless another is
given, the ledger is LEDGER in the folder of spark.checkpoint.dir and outlives runs: a second run over the same texts scans
none. Each run adds a folder of its own, which appears when it's whole, so runs at once and lost executors harm none.

The distinct texts meet once, by the blob's name, after each task has dropped its own copies; so a text that
fills a third of the table arrives once from each task. The join back is a plain equi-join, whose large
partitions Spark splits.

A null text is the empty text. Repeated rows give repeated results; null ids stay null; empty tables give no rows. Very
long texts are scanned whole, and no pattern has a longest match. Other columns stay, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, own_names, shared_dir, small_or_not, stored


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, the least length of its group that holds the secret, and strings of which a text must have one, in lower case."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    needs: tuple[str, ...] = ()
    any_case: bool = False


#: The kinds of the contract, first and in its order, then those that the method adds.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, ("password", "passwd", "secret", "token", "apikey", "api_key"), True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, ("akia",)),
    Rule("hex", r"[0-9a-f]{32,}"),
)
ADDED = (
    Rule("forge", r"\bgh[pousr]_[A-Za-z0-9]{36,}", needs=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("chat", r"\bxox[abeoprs]-[A-Za-z0-9-]{10,}", needs=("xox",)),
    Rule("maps", r"\bAIza[A-Za-z0-9_-]{35}", needs=("aiza",)),
    Rule("pay", r"\b[rs]k_(?:live|test)_[A-Za-z0-9]{16,}", needs=("k_live_", "k_test_")),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needs=("eyj",)),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s:,-]*?-----END (?:[A-Z]+ )*PRIVATE KEY-----)?", needs=("private key-----",)),
    Rule("login", r"(?<=[a-z0-9+.-])://[^\s/:@]+:([^\s/:@]{3,})@[^\s/@]+", 1, needs=("://",)),
)
RULES = BASE + ADDED

#: Where the ledger is in the folder that executors share, and the version of how rules are applied.
LEDGER = "readloom/secret-ledger"
FINDER = 2

SPANS = "array<struct<kind:string,start:long,end:long,secret_start:long,secret_end:long>>"


def version(rules: tuple[Rule, ...]) -> str:
    """Any change of the rules, or of how they are applied, is another version."""
    return hashlib.sha256(repr((FINDER, rules)).encode()).hexdigest()[:16]


def finder(rules: tuple[Rule, ...]):
    """A function from a text to its spans (kind, start, end, secret_start, secret_end), in code points, by start and then by rule."""
    made = [(k, r, re.compile(r.pattern, (re.I if r.any_case else 0) | re.A)) for k, r in enumerate(rules)]

    def find(text: str) -> list[tuple[str, int, int, int, int]]:
        low = text.lower()
        found = []
        for k, r, pattern in made:
            if not r.needs or any(x in low for x in r.needs):
                found += [(m.start(), k, r.kind, m.end(), *m.span(r.group)) for m in pattern.finditer(text) if m.end(r.group) - m.start(r.group) >= r.least]
        return [(kind, a, b, c, d) for a, _, kind, b, c, d in sorted(found)]

    return find


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, spans of the columns blob, text."""
    kind = pa.list_(pa.struct([("kind", pa.string()), *((x, pa.int64()) for x in ("start", "end", "secret_start", "secret_end"))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, names = finder(rules), [f.name for f in kind.value_type]
        for batch in batches:
            spans = [[dict(zip(names, x, strict=True)) for x in find(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["blob", "spans"])

    return map_batches(blobs.select("blob", "text"), run, f"blob binary, spans {SPANS}")


class Ledger:
    """Blobs by rule version, at a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/{LEDGER}"

    def folder(self, path: str):
        """A Hadoop file system and path."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def entries(self, rules: tuple[Rule, ...]) -> DataFrame:
        fs, at = self.folder(f"{self.path}/rules={version(rules)}")
        kind = f"blob binary, spans {SPANS}"
        if not fs.exists(at):
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).option("recursiveFileLookup", "true").parquet(at.toString())

    def update(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> int:
        """Scans the texts of docs that were never scanned under these rules. Returns how many were."""
        texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).select(F.unhex(F.sha2("text", 256)).alias("blob"), "text")
        texts = texts.join(small_or_not(self.entries(rules).select("blob")), "blob", "left_anti")
        run = uuid.uuid4().hex
        made, whole = (f"{self.path}/{at}" for at in (f"begun/{run}", f"rules={version(rules)}/run={run}"))
        scan(texts.groupBy("blob").agg(F.first("text").alias("text")), rules).write.parquet(made)
        fs, at = self.folder(made)
        if not (n := self.spark.read.schema("blob binary").parquet(made).count()):
            fs.delete(at, True)
            return 0
        to = self.folder(whole)[1]
        fs.mkdirs(to.getParent())
        if not fs.rename(at, to):
            raise OSError(f"{made} can't become {whole}")
        return n

    def found(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """blob and spans, of the blobs that have any. A blob that two runs scanned at once counts once."""
        return self.entries(rules).filter(F.size("spans") > 0).dropDuplicates(["blob"])


def named() -> Column:
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))


def found_in(docs: DataFrame, rules: tuple[Rule, ...], ledger: Ledger | None) -> DataFrame:
    """blob, spans of those blobs of docs that have any, each once, after the ledger has been brought up to date. Stored, so that the join to rows is one that Spark splits."""
    ledger = ledger or Ledger(docs.sparkSession)
    ledger.update(docs, rules)
    return stored(ledger.found(rules).join(docs.select(named().alias("blob")).distinct(), "blob", "left_semi"))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: Ledger | None = None) -> DataFrame:
    """doc_id, spans for each row of docs."""
    found = small_or_not(found_in(docs, rules, ledger))
    return docs.select("doc_id", named().alias("blob")).join(found, "blob", "left").select("doc_id", F.coalesce("spans", F.expr(f"cast(array() as {SPANS})")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: Ledger | None = None) -> DataFrame:
    """docs with each secret in text replaced by its kind in brackets, and n_chars, if there, counted anew. Overlapping secrets are replaced as one.

    The texts move only if more blobs hold secrets than may be broadcast.
    """
    own = own_names(docs, "blob", "spans", "new")
    found = found_in(docs, rules, ledger).select(F.col("blob").alias(own["blob"]), F.col("spans").alias(own["spans"]))
    cut = F.expr(f"""aggregate(array_sort(transform({own["spans"]}, x -> struct(x.secret_start as a, x.secret_end as b, x.kind as kind))),
        struct(cast('' as string) as done, cast(0 as bigint) as at),
        (s, x) -> if(x.b <= s.at, s, struct(concat(s.done, if(x.a >= s.at, concat(substring(text, cast(s.at + 1 as int), cast(x.a - s.at as int)), '[', x.kind, ']'), '')) as done, x.b as at)),
        s -> concat(s.done, substring(text, cast(s.at + 1 as int))))""")
    blob, spans, new = (F.col(own[n]) for n in ("blob", "spans", "new"))
    out = docs.withColumn(own["blob"], named()).join(small_or_not(found), own["blob"], "left")
    out = out.withColumn(own["new"], F.when(spans.isNotNull(), cut).otherwise(F.col("text")))
    kinds = dict(docs.dtypes)
    return out.select(*[new.alias("text") if c == "text" else F.when(spans.isNotNull(), F.length(new)).otherwise(F.col(c)).cast(kinds[c]).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def digests(found: DataFrame) -> DataFrame:
    """The columns of the contract from find_secrets()."""
    base = F.filter("spans", lambda x: x["kind"].isin([r.kind for r in BASE]))
    join = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{r.kind}')) as bigint)").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *count, F.sha2(join(base), 256).alias("base_sha256"), join(F.col("spans")).alias("spans"))
