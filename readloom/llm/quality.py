"""Quality rules: features of each document, and lines that many documents of a host share.

Each non-blank line is normalised (A-Z lowered, runs of white space one blank) and hashed. A document counts once
for a host (source) however many copies the host has. Lines that more than a share of a host's documents hold,
and at least so many, are boilerplate (for clean(), those in MOST_DOCUMENTS are at any share): they are removed, and a document of which too little is left is rejected.

What moves are line hashes, never texts: first one row for each distinct (host, text), which a task's own copies
have been dropped from, then counts by (host, line), summed before they move. A host with a third of all rows is
spread over its lines. Verdicts belong to (host, text), so repeated rows and null or repeated ids get the same one.

A null text has no words and fails; a null source is the host ''. Rows are never dropped here but by kept. Empty tables
give no rows; a very long text is one row, its lines an array of hashes. Other columns stay, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, digest, map_batches, own_names, small_or_not, stored

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A line is boilerplate if it's in more than this share of a host's distinct documents, and in at least so many.
LINE_SHARE = 0.1
LINE_DOCUMENTS = 20
#: For clean(): in so many of a host's distinct documents a line is boilerplate whatever share of a large host they are.
MOST_DOCUMENTS = 40
#: A document is depleted if fewer words are left than LEFT_WORDS, or less than LEFT_SHARE of them.
LEFT_WORDS = 10
LEFT_SHARE = 0.3

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in a window that comes twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    each = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + each[k : k + n]
    first = np.sort(mixed)
    if not (first[1:] == first[:-1]).any():
        return 0
    ids: dict[bytes, int] = {}  # some hashes are equal: now by the words themselves
    now = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    size = 1
    while size < window:  # numbers of the windows of twice the size
        now = np.unique(now[:-size] * (int(now.max()) + 1) + now[size:], return_inverse=True)[1]
        size *= 2
    _, which, count = np.unique(now, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[which] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[tuple[int, ...], list[int], list[int]]:
    """COUNTS, and hash (XXH64, seed 42, as Spark's xxhash64) and number of words of each line that has a word."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts = (len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words))
    cut = [x.lower().split() for x in lines]
    hashes = [xxhash.xxh64_intdigest(b" ".join(x), 42) for x in cut]
    return counts, [h - (1 << 64) if h >> 63 else h for h in hashes], [len(x) for x in cut]


def features(docs: DataFrame) -> DataFrame:
    """doc_id, host, digest, COUNTS, base_failed, lines: one row for each row of docs, without a shuffle."""
    line = pa.list_(pa.struct([("h", pa.int64()), ("words", pa.int32())]))
    fields = [("doc_id", pa.int64()), ("host", pa.string()), ("digest", pa.binary()), *((c, pa.int64()) for c in COUNTS), ("lines", line)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, names, lines = [], [], []
            for t in batch.column(2):
                text = t.as_py()
                c, hashes, words = measure(text)
                counts.append(c)
                names.append(hashlib.sha256((text or "").encode()).digest()[:16])
                lines.append([{"h": h, "words": n} for h, n in zip(hashes, words, strict=True)])
            cols = [batch.column(0), batch.column(1), pa.array(names, pa.binary())]
            cols += [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lines, line)], names=[f[0] for f in fields])

    schema = "doc_id long, host string, digest binary, " + ", ".join(f"{c} long" for c in COUNTS) + ", lines array<struct<h:long,words:int>>"
    out = map_batches(docs.select(F.col("doc_id").cast("long"), F.coalesce("source", F.lit("")).alias("host"), "text"), run, schema)
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def boilerplate(texts: DataFrame, share: float = LINE_SHARE, least: int = LINE_DOCUMENTS, most: int | None = None) -> DataFrame:
    """host, h of lines above the limits; with most, also of those in so many documents at least. texts: host, lines, one row for each distinct (host, text)."""
    hosts = texts.groupBy("host").agg(F.count("*").alias("docs"))
    lines = texts.select("host", F.explode(F.array_distinct("lines.h")).alias("h")).groupBy("host", "h").agg(F.count("*").alias("n"))
    return lines.filter(F.col("n") >= least).join(hosts, "host").filter((F.col("n") > share * F.col("docs")) | (F.col("n") >= F.lit(most)) if most else F.col("n") > share * F.col("docs")).select("host", "h")


def verdicts(found: DataFrame, share: float = LINE_SHARE, least: int = LINE_DOCUMENTS, most: int | None = None) -> DataFrame:
    """host, digest, kept, n_lines_removed, n_words_left, removed array<long>: of distinct (host, text). found: features(), stored."""
    first = [F.first(c).alias(c) for c in ("n_words", "base_failed", "lines")]
    texts = stored(found.groupBy("host", "digest").agg(*first))
    common = small_or_not(stored(boilerplate(texts, share, least, most)))
    hit = texts.select("host", "digest", F.explode("lines").alias("x")).select("host", "digest", F.col("x.h").alias("h"), F.col("x.words").alias("words"))
    hit = hit.join(common, ["host", "h"]).groupBy("host", "digest").agg(F.count("*").alias("n_lines_removed"), F.sum("words").alias("lost"), F.collect_set("h").alias("removed"))
    left = F.col("n_words") - F.coalesce("lost", F.lit(0))
    out = texts.select("host", "digest", "n_words", "base_failed").join(hit, ["host", "digest"], "left")
    depleted = F.col("lost").isNotNull() & ((left < LEFT_WORDS) | (left < LEFT_SHARE * F.col("n_words")))
    return out.select("host", "digest", (~F.col("base_failed") & ~depleted).alias("kept"), F.coalesce("n_lines_removed", F.lit(0)).alias("n_lines_removed"), left.alias("n_words_left"), "removed")


def judge(docs: DataFrame, share: float = LINE_SHARE, least: int = LINE_DOCUMENTS) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept, n_lines_removed, n_words_left: one row for each row of docs."""
    found = stored(features(docs))
    out = found.drop("lines").join(verdicts(found, share, least), ["host", "digest"])
    return out.select("doc_id", *COUNTS, "base_failed", "kept", "n_lines_removed", "n_words_left")


def clean(docs: DataFrame, share: float = LINE_SHARE, least: int = LINE_DOCUMENTS, most: int | None = MOST_DOCUMENTS) -> DataFrame:
    """docs without the rejected, and without boilerplate lines in text; n_chars, if there, is counted anew where a line went.

    Only verdicts that change a document are joined, broadcast if a count proves them few; else texts move once.
    """
    found = stored(features(docs))
    own = own_names(docs, "host", "digest", "kept", "removed", "new")
    changed = stored(verdicts(found, share, least, most).filter(~F.col("kept") | F.col("removed").isNotNull()).select(F.col("host").alias(own["host"]), F.col("digest").alias(own["digest"]), F.col("kept").alias(own["kept"]), F.col("removed").alias(own["removed"])))
    out = docs.withColumns({own["host"]: F.coalesce("source", F.lit("")), own["digest"]: digest(F.col("text"))}).join(small_or_not(changed), [own["host"], own["digest"]], "left")
    out = out.filter(F.coalesce(own["kept"], F.lit(True)))
    normal = lambda x: F.trim(F.regexp_replace(ascii_lower(x), r"[\x20\x09-\x0D]+", " "))
    lines = F.filter(F.split("text", "\n", -1), lambda x: ~F.array_contains(own["removed"], F.xxhash64(normal(x))))
    out = out.withColumn(own["new"], F.when(F.col(own["removed"]).isNotNull(), F.array_join(lines, "\n")).otherwise(F.col("text")))
    kinds = dict(docs.dtypes)
    return out.select(*[F.col(own["new"]).alias("text") if c == "text" else F.when(F.col(own["removed"]).isNotNull(), F.length(own["new"])).otherwise(F.col(c)).cast(kinds[c]).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


_WORD = r"[^\x20\x09-\x0D]"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE_SQL = f"""
with d as (select doc_id, coalesce(source, '') as host, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_WORD}+') as w from documents),
grams as (select doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') as g from (select doc_id, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) as i from d)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from grams) where n > 1),
covered as (select doc_id, count(distinct k) as n from (select doc_id, unnest(generate_series(i, i + {WINDOW - 1})) as k from twice) group by doc_id),
texts as (select distinct host, text from d),
lines as (
  select host, text, line, array_to_string(regexp_extract_all(translate(line, '{_UPPER}', '{_UPPER.lower()}'), '{_WORD}+'), ' ') as norm, len(regexp_extract_all(line, '{_WORD}+')) as words
  from (select host, text, unnest(string_split(text, chr(10))) as line from texts) where regexp_matches(line, '{_WORD}')
),
hosts as (select host, count(*) as docs from texts group by host),
common as (
  select host, norm from (select host, norm, count(distinct text) as n from lines group by host, norm) join hosts using (host)
  where n >= {LINE_DOCUMENTS} and n > {LINE_SHARE} * docs
),
lost as (select host, text, count(*) as n, cast(sum(words) as bigint) as words from lines join common using (host, norm) group by host, text),
base as (
  select d.doc_id, len(w) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
    length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    len(list_filter(string_split(d.text, chr(10)), lambda x: regexp_matches(x, '{_WORD}'))) - len(list_distinct(list_filter(string_split(d.text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')))) as n_dup_lines,
    coalesce(c.n, 0) as n_repeat_words, coalesce(l.n, 0) as n_lines_removed, len(w) - coalesce(l.words, 0) as n_words_left, l.n is not null as cut
  from d left join covered c on c.doc_id = d.doc_id left join lost l on l.host = d.host and l.text = d.text
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed,
  not (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) and not (cut and (n_words_left < {LEFT_WORDS} or n_words_left < {LEFT_SHARE} * n_words)) as kept,
  n_lines_removed, n_words_left
from base
"""
