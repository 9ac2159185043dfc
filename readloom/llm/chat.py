"""Chat formatting as relational steps: turns are collected and sorted, neighbours of one role are merged, the parts joined.

The template of a conversation is, for each run of turns of one role,

    <|turn|>ROLE<|text|>TEXT<|next|>TEXT<|end|>

where roles and texts have \\ written as \\\\ and <| as <\\|, so no text can hold a mark and every text is read back
as it was. Under the loss mask are just the texts of assistants.

Rows are ordered by turn, null turns last, ties by role and text. A null role or text is empty; rows without
conv_id are one conversation; repeated rows are repeated turns; empty tables give no rows. A conversation of more
than HOT_TURNS rows is first merged in blocks, in tasks of their own, so that what meets at the end is a few runs
and not its rows; the formatted conversation is one value, so one task must write it. Very long texts are escaped
and joined whole. Columns beside conv_id, turn, role and text play no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_or_not, stored

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
LEARNED = "assistant"
HOT_TURNS = 4096
BLOCK_TURNS = 1024


def escape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def merged(rows: DataFrame, *by: str) -> DataFrame:
    """by, runs: the array items of (role, texts) with neighbours of one role made one."""
    starts = F.expr("filter(sequence(0, size(items) - 1), i -> i = 0 or items[i].role <> items[i - 1].role)")
    run = F.expr("""transform(starts, (a, k) -> struct(items[a].role as role,
        flatten(transform(slice(items, a + 1, coalesce(get(starts, k + 1), size(items)) - a), x -> x.texts)) as texts))""")
    return rows.select(*by, "items", starts.alias("starts")).select(*by, run.alias("runs"))


def runs(turns: DataFrame) -> DataFrame:
    """conv_id, runs array of (role, texts)."""
    rows = turns.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit((1 << 63) - 1)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    collect = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    items = F.transform(collect, lambda x: F.struct(x["role"].alias("role"), F.array(x["text"]).alias("texts"))).alias("items")
    whole = lambda df, *by: merged(df.groupBy(*by).agg(items), *by)
    hot = stored(rows.groupBy("conv_id").count().filter(F.col("count") > HOT_TURNS).select("conv_id"))
    if hot.isEmpty():
        return whole(rows, "conv_id")
    hot = small_or_not(hot.select(F.col("conv_id").alias("hot_id")))
    same = F.col("conv_id").eqNullSafe(F.col("hot_id"))
    few = whole(rows.join(hot, same, "left_anti"), "conv_id")
    blocks = whole(rows.join(hot, same, "left_semi").withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS)), "conv_id", "block")
    many = blocks.groupBy("conv_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "runs"))), lambda x: x["runs"])).alias("items"))
    return few.unionByName(merged(many, "conv_id"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted string, segments array of (text, loss): the parts of formatted in order, each under the loss mask or not."""
    part = lambda x, loss: F.struct(x.alias("text"), F.lit(loss).alias("loss") if isinstance(loss, bool) else loss.alias("loss"))
    text = lambda run: F.transform(run["texts"], lambda x, i: F.array(part(F.when(i > 0, NEXT).otherwise(""), False), part(escape(x), run["role"] == LEARNED)))
    segments = F.flatten(F.transform("runs", lambda run: F.concat(F.array(part(F.concat(F.lit(TURN), escape(run["role"]), F.lit(TEXT)), False)), F.flatten(text(run)), F.array(part(F.lit(END), False)))))
    out = runs(turns).select("conv_id", F.filter(segments, lambda x: F.length(x["text"]) > 0).alias("segments"))
    return out.select("conv_id", F.array_join("segments.text", "").alias("formatted"), "segments")


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    literal = lambda mark: mark.replace("|", r"\|")
    run = F.filter(F.split(formatted, literal(END), -1), lambda x: x != "")
    halves = F.transform(run, lambda x: F.split(F.substring(x, len(TURN) + 1, 1 << 30), literal(TEXT), 2))
    return F.flatten(F.transform(halves, lambda x: F.transform(F.split(x[1], literal(NEXT), -1), lambda y: F.struct(unescape(x[0]).alias("role"), unescape(y).alias("text")))))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, as it was before escaping."""
    return F.array_join(F.transform(F.filter(segments, lambda x: x["loss"]), lambda x: unescape(x["text"])), "")


def digests(chats: DataFrame) -> DataFrame:
    """The columns of the contract, read back from format_chats()."""
    back = chats.select("conv_id", parse(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")


SAID = "</s>[INST] ok [/INST]"
_ESCAPED = "length(replace(replace({0}, '\\', '\\\\'), '<|', '<\\|'))"
ORACLE_SQL = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{SAID}' union all select -1, 1, '{LEARNED}', '{SAID}'
),
ran as (select *, lag(role) over (partition by conv_id order by turn, role, text) is distinct from role as first from turns)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = '{LEARNED}'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = '{LEARNED}'), '')) as loss_sha256,
  cast(sum({_ESCAPED.format("text")} + case when first then {_ESCAPED.format("role")} + {len(TURN + TEXT + END)} else {len(NEXT)} end) as bigint) as formatted_chars
from ran group by conv_id
"""
