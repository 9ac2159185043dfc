"""Substring dedup by lines and paragraphs: texts are cut into pieces, runs of pieces are normalised and hashed, the
earliest occurrence of all stays, the rest go.

A piece ends with its line, with a sentence (a word that ends in . ! or ?) or with a word of LONG_WORD or more
characters, so that a passage has pieces of its own wherever it stands in a line. The units are runs of neighbouring
pieces: from each piece on, and up to each piece, the shortest run of LEAST or more characters, words parted by one
blank and pieces by a line end, A-Z lowered. So however short its lines and sentences are, a repeated passage of whole pieces goes in full if it
has LEAST characters: each of its pieces is in a unit that lies within it. A shorter repeat is no passage.

The earliest is by doc_id, then by place; a null id comes last. An occurrence that overlaps the one that stays loses
only what lies beyond it. Offsets are code points of the original text, the end exclusive; a piece takes the white space
after it along. What moves is a row of fixed size for each unit, never text; groups are summed to their earliest row
and count before they move, and the join back to units is one whose large partitions Spark splits, so a line that a
third of all documents hold is no task's alone. A row's spans are merged, one for a piece of its own text at most.

A null text has no pieces and stays null; texts without words have none removed. A very long text is cut in one pass
like any other. Rows that repeat an id and a text are one document and get the same result; so are rows that repeat a
text without an id. Different texts of one id, or without one, are documents of their own, in the order of their
hashes. Empty tables give no rows. Other columns stay, whatever their names, but for removed, which remove() sets.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own_names, small_or_not, stored

#: Characters that a unit has at least, and that a word has at least to end a piece.
LEAST = 120
LONG_WORD = 16
LAST = (1 << 63) - 1

#: What lies between pieces.
BREAK = re.compile(rf"[\x20\x09\x0B-\x0D]*\n[\x20\x09-\x0D]*|(?<=[.!?])[\x20\x09-\x0D]+|(?<=[^\x20\x09-\x0D]{{{LONG_WORD}}})[\x20\x09-\x0D]+")
UNIT = "digest:binary,start:int,end:int"
SPANS = "array<struct<start:int,end:int,kept_doc:long,kept_start:int>>"


def named() -> dict[str, Column]:
    """What a document is told by, in this order: its id, the last one if null, and a hash of its text."""
    return {"rank": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "name": F.xxhash64("text")}


def pieces(text: str) -> tuple[list[bytes], list[int]]:
    """The normalised pieces, and where each begins; one place more, where the last ends."""
    edges = [0, *(m.end() for m in BREAK.finditer(text)), len(text)]
    found, starts = [], []
    for a, b in pairwise(edges):
        if words := text[a:b].encode("utf-8", "surrogatepass").lower().split():
            found.append(b" ".join(words))
            starts.append(a)
    return found, [*starts, len(text)]


def units(text: str | None, least: int = LEAST) -> list[tuple[bytes, int, int]]:
    """digest, start, end of each unit of a text, each place once."""
    found, starts = pieces(text or "")
    size = [len(p) if p.isascii() else len(p.decode("utf-8", "surrogatepass")) for p in found]
    before = [0, *accumulate(n + 1 for n in size)]  # a run from a to b has before[b] - before[a] - 1 characters
    n, runs = len(found), []
    b = 0
    for a in range(n):
        while b < n and before[b] - before[a] - 1 < least:
            b += 1
        if before[b] - before[a] - 1 < least:
            break
        runs.append((a, b))
    a = 0
    for b in range(1, n + 1):
        while before[b] - before[a + 1] - 1 >= least:
            a += 1
        if before[b] - before[a] - 1 >= least:
            runs.append((a, b))
    return [(hashlib.sha256(b"\n".join(found[a:b])).digest()[:16], starts[a], starts[b]) for a, b in sorted(set(runs))]


def unit_rows(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """rank, name, units array of (digest, start, end): one row for each row of docs, without a shuffle."""
    kind = pa.list_(pa.struct([("digest", pa.binary()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, starts, ends, cuts = [], [], [], [0]
            for text in batch.column(2):
                for d, a, b in units(text.as_py(), least):
                    digests.append(d)
                    starts.append(a)
                    ends.append(b)
                cuts.append(len(digests))
            flat = pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], fields=list(kind.value_type))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), flat).cast(kind)], names=["rank", "name", "units"])

    return docs.select(*[c.alias(n) for n, c in named().items()], "text").mapInArrow(run, f"rank long, name long, units array<struct<{UNIT}>>")


def repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """rank, name, removed array of (start, end, kept_doc, kept_start): merged spans, of documents that have any."""
    each = stored(unit_rows(docs, least)).select("rank", "name", F.inline("units"))
    groups = each.groupBy("digest").agg(F.min(F.struct("rank", "name", "start", "end")).alias("kept"), F.count("*").alias("n")).filter("n > 1")
    groups = small_or_not(stored(groups.select("digest", "kept")))
    gone = each.join(groups, "digest").filter("rank <> kept.rank or name <> kept.name or start <> kept.start")
    own = (F.col("rank") == F.col("kept.rank")) & (F.col("name") == F.col("kept.name"))
    begin = F.when(own & (F.col("start") < F.col("kept.end")), F.col("kept.end")).otherwise(F.col("start"))
    spans = F.sort_array(F.collect_set(F.struct(begin.alias("start"), "end", F.expr(f"nullif(kept.rank, {LAST})").alias("kept_doc"), F.col("kept.start").alias("kept_start"))))
    return gone.groupBy("rank", "name").agg(spans.alias("spans")).select("rank", "name", merged().alias("removed"))


def merged() -> Column:
    """The spans, sorted by start, with those that touch made one, which has the earliest of what they keep; a null doc comes last."""
    kept = f"if(struct(coalesce(x.kept_doc, {LAST}) as d, x.kept_start as s) < struct(coalesce(l.kept_doc, {LAST}) as d, l.kept_start as s), x, l)"
    return F.expr(f"""aggregate(spans, struct(cast(array() as {SPANS}) as done, cast(null as struct<start:int,end:int,kept_doc:long,kept_start:int>) as l),
        (acc, x) -> if(acc.l is not null and x.start <= acc.l.end,
            struct(acc.done as done, transform(array(acc.l), l -> struct(l.start as start, greatest(l.end, x.end) as end, {kept}.kept_doc as kept_doc, {kept}.kept_start as kept_start))[0] as l),
            struct(if(acc.l is null, acc.done, array_append(acc.done, acc.l)) as done, x as l)),
        acc -> array_append(acc.done, acc.l))""")


def remove(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs without the repeated passages, and with removed, their original offsets. Texts move only if more documents change than may be broadcast."""
    own = own_names(docs, *named())
    spans = small_or_not(stored(repeats(docs, least).withColumnsRenamed(own)))
    out = docs.drop("removed").withColumns({own[n]: c for n, c in named().items()}).join(spans, list(own.values()), "left")
    cut = F.expr("""array_join(transform(sequence(0, size(removed)), i -> substring(text, if(i = 0, 0, removed[i - 1].end) + 1,
        if(i = size(removed), length(text), removed[i].start) - if(i = 0, 0, removed[i - 1].end))), '')""")
    removed = F.coalesce("removed", F.expr(f"cast(array() as {SPANS})"))
    return out.withColumn("text", F.when(F.size("removed") > 0, cut).otherwise(F.col("text"))).withColumn("removed", removed).drop(*own.values())


def report(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_removed spans, removed_chars, removed as start:end:kept_doc:kept_start comma-joined, and text, what is left."""
    out = remove(docs.select("doc_id", "text"), least)
    span = lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"), F.coalesce(x["kept_doc"].cast("string"), F.lit("")), x["kept_start"].cast("string"))
    chars = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["start"]))
    return out.select("doc_id", F.size("removed").cast("long").alias("n_removed"), chars.alias("removed_chars"), F.array_join(F.transform("removed", span), ",").alias("removed"), "text")


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A mark goes in behind each BREAK, which has white space before it; texts are taken to hold no such mark.
ORACLE_SQL = f"""
with cut as (
  select doc_id, text, string_split(regexp_replace(regexp_replace(text, '([.!?]|[^\\x20\\x09-\\x0D]{{{LONG_WORD}}})([\\x20\\x09-\\x0D]+)', '\\1\\2' || chr(1), 'g'),
    '([\\x20\\x09\\x0B-\\x0D]*\\n[\\x20\\x09-\\x0D]*)' || chr(1) || '?', '\\1' || chr(1), 'g'), chr(1)) as parts
  from documents where text is not null
),
part as (select doc_id, unnest(parts) as part, generate_subscripts(parts, 1) as k from cut),
placed as (
  select doc_id, k, coalesce(sum(length(part)) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0) as start,
    trim(regexp_replace(translate(part, '{UPPER}', '{UPPER.lower()}'), '[\\x20\\x09-\\x0D]+', ' ', 'g')) as norm
  from part
),
piece as (
  select p.doc_id, k, start, coalesce(lead(start) over w, length(d.text)) as stop, norm, sum(length(norm) + 1) over w as upto, sum(length(norm) + 1) over w - length(norm) - 1 as before
  from placed p join cut d on d.doc_id = p.doc_id where norm <> '' window w as (partition by p.doc_id order by k)
),
whole as (select doc_id, string_agg(norm, chr(10) order by k) as norm from piece group by doc_id),
run as (
  select a.doc_id, a.start, b.stop, a.before, b.upto from piece a asof join piece b on a.doc_id = b.doc_id and a.before + {LEAST + 1} <= b.upto
  union
  select b.doc_id, a.start, b.stop, a.before, b.upto from piece b asof join piece a on a.doc_id = b.doc_id and b.upto - {LEAST + 1} >= a.before
),
unit as (select r.doc_id, start, stop, md5(substr(w.norm, cast(before + 1 as bigint), cast(upto - before - 1 as bigint))) as name from run r join whole w on w.doc_id = r.doc_id),
ranked as (
  select *, first_value(doc_id) over w as kept_doc, first_value(start) over w as kept_start, first_value(stop) over w as kept_stop from unit window w as (partition by name order by doc_id, start)
),
gone as (select doc_id, case when doc_id = kept_doc and start < kept_stop then kept_stop else start end as a, stop as b, kept_doc, kept_start from ranked where doc_id <> kept_doc or start <> kept_start),
split as (select *, a > coalesce(max(b) over (partition by doc_id order by a, b, kept_doc, kept_start rows between unbounded preceding and 1 preceding), -1) as fresh from gone),
island as (select *, sum(cast(fresh as int)) over (partition by doc_id order by a, b, kept_doc, kept_start) as n from split),
span as (select doc_id, min(a) as a, max(b) as b, min(row(kept_doc, kept_start)) as kept from island group by doc_id, n),
apart as (select s.*, coalesce(lag(b) over (partition by doc_id order by a), 0) as past from span s),
left_over as (
  select s.doc_id, count(*) as n, sum(b - a) as chars, string_agg(concat_ws(':', cast(a as bigint), cast(b as bigint), kept[1], cast(kept[2] as bigint)), ',' order by a) as removed,
    string_agg(substr(d.text, cast(past + 1 as bigint), cast(a - past as bigint)), '' order by a) || substr(any_value(d.text), cast(max(b) + 1 as bigint)) as text
  from apart s join cut d on d.doc_id = s.doc_id group by s.doc_id
)
select d.doc_id, coalesce(l.n, 0) as n_removed, cast(coalesce(l.chars, 0) as bigint) as removed_chars, coalesce(l.removed, '') as removed, coalesce(l.text, d.text) as text
from documents d left join left_over l on l.doc_id = d.doc_id
"""
