"""Mixing sources to target weights, by Pfair scheduling of blocks.

Each source's documents, in an order drawn from doc_id, are cut into blocks of BLOCK documents. A source of weight w
has its block j (from 0) released at slot floor(j / w) and due by slot ceil((j + 1) / w); each slot goes to the
released block with the earliest deadline, ties to the lesser source. Weights that sum to 1 always meet all deadlines
that way, so at every slot each source that has blocks left is less than one block off its target. A source that runs
out leaves its slots empty: no row is dropped or repeated.

Weights are whole numbers k of a total: a weight times UNIT, rounded down, 1 at least. Windows come from k and the total by whole
numbers, with no period and no rounding that adds up, over all blocks that exist and any number of sources.

Earliest deadline first depends on all that went before, so blocks are scheduled in order, in steps of ROUNDS * TURNS
blocks: a step is one expression over one row, the state of each source, and leaves its picks and the next state in the
shared folder. Neither a task nor the driver ever holds more than a step, and a lost executor repeats one step.

Only DataFrame functions run on rows. What grows with the data is a narrow shuffle by (source, bucket of the order),
which a source of any size is spread over; ranks are counts of earlier buckets plus a row number in the own one. A block's
slot is joined by (source, block), a pair that BLOCK rows share at most.

A null source is the source ''; rows with null or repeated ids each have their own place, in no set order among equal ids.
Texts, null, empty or very long, are only carried. An empty table gives no rows. Other columns stay, whatever their names.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import own_names, shared_dir, small_or_not, stored

BLOCK = 64
#: Weights are whole multiples of 1 / UNIT.
UNIT = 1 << 36
#: A step's blocks, in rounds of turns.
ROUNDS, TURNS = 64, 128
#: Rows that a bucket of a source should have at most, on average.
BUCKET_ROWS = 20_000

PICKS = "step int, nth int, source string, block long, release_slot long, due_slot long, slot long, rows long"
SOURCE = "source string, k long, n long, blocks long, done long, at long, rest long"


def weighted(counts: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """source, k, n. counts: source, n. Weights not given are the square root of the source's count of rows, so that small sources are not drowned."""
    given = F.coalesce(*[F.when(F.col("source") == s, F.lit(float(w))) for s, w in weights.items()], F.sqrt("n")) if weights else F.sqrt("n")
    return counts.select("source", F.greatest(F.lit(1).cast("long"), F.floor(given * UNIT).cast("long")).alias("k"), F.col("n").cast("long").alias("n"))


def start(quotas: DataFrame) -> DataFrame:
    """One row: total, slot 0, and of each source its next block, with the slot at which that is released and what is left over of that division."""
    zero = F.lit(0).cast("long")
    each = F.struct("source", "k", "n", F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("blocks"), zero.alias("done"), zero.alias("at"), zero.alias("rest"))
    return quotas.agg(F.coalesce(F.sum("k"), zero).alias("total"), zero.alias("t"), F.array_sort(F.collect_list(each)).alias("q"))


def steps() -> Column:
    """From total, t and q: struct(t, q, picks array<array>) after ROUNDS * TURNS blocks, or as many as there are.

    A turn places a block: at the next slot, or where that is later, at the first release of all.
    """
    after = "struct(x.source as source, x.k as k, x.n as n, x.blocks as blocks, x.done + 1 as done, x.at + total div x.k + if(x.rest + total % x.k >= x.k, 1, 0) as at, (x.rest + total % x.k) % x.k as rest)"
    due = f"{after}.at + if({after}.rest > 0, 1, 0)"
    now = "greatest(s.t, array_min(transform(s.q, x -> if(x.done < x.blocks, x.at, null))))"
    pick = f"array_min(transform(s.q, (x, i) -> if(x.done < x.blocks and x.at <= now, struct({due} as due, i as i), null)))"
    # lambdas name what they use again: first the slot, then the pick
    turn = f"""if(not exists(s.q, x -> x.done < x.blocks), s, transform(array({now}), now -> transform(array({pick}), p -> struct(now + 1 as t,
        transform(s.q, (x, i) -> if(i = p.i, {after}, x)) as q,
        array_append(s.picks, struct(p.i as i, s.q[p.i].done as block, s.q[p.i].at as released, p.due as due, now as slot)) as picks))[0])[0])"""
    none = "cast(array() as array<struct<i:int,block:bigint,released:bigint,due:bigint,slot:bigint>>)"
    rounds = f"""aggregate(sequence(1, {ROUNDS}), struct(t as t, q as q, cast(array() as array<array<struct<i:int,block:bigint,released:bigint,due:bigint,slot:bigint>>>) as all),
        (r, u) -> transform(array(aggregate(sequence(1, {TURNS}), struct(r.t as t, r.q as q, {none} as picks), (s, v) -> {turn})), d -> struct(d.t as t, d.q as q, array_append(r.all, d.picks) as all))[0])"""
    return F.expr(rounds)


def picks(quotas: DataFrame) -> DataFrame:
    """PICKS: every block of every source, at its slot, earliest deadline first. quotas: source, k, n."""
    spark = quotas.sparkSession
    path = f"{shared_dir(spark)}/readloom/{uuid.uuid4().hex}"
    now, step = stored(start(quotas)), 0
    state = f"total long, t long, q array<struct<{', '.join(f'{n}:{k}' for n, k in (x.split() for x in SOURCE.split(', ')))}>>"
    while now.filter(F.exists("q", lambda x: x["done"] < x["blocks"])).count():
        now.select("total", steps().alias("r")).select("total", "r.t", "r.q", F.flatten("r.all").alias("picks")).write.parquet(f"{path}/step={step}")
        now = spark.read.schema(state).parquet(f"{path}/step={step}")
        step += 1
    if not step:
        return spark.createDataFrame([], PICKS)
    each = "array<struct<i:int,block:bigint,released:bigint,due:bigint,slot:bigint>>"
    rows = spark.read.schema(f"{state}, picks {each}, step int").parquet(path).select("step", "q", F.posexplode("picks").alias("nth", "p"))
    rows = rows.select("step", "nth", F.expr("q[p.i].source").alias("source"), "p.block", F.col("p.released").alias("release_slot"), F.col("p.due").alias("due_slot"), "p.slot", F.expr(f"least({BLOCK}, q[p.i].n - p.block * {BLOCK})").alias("rows"))
    return stored(rows.select(*[x.split()[0] for x in PICKS.split(", ")]))


def plan(docs: DataFrame, weights: dict[str, float] | None = None) -> tuple[DataFrame, int]:
    """picks() of docs, and the rows of the largest source."""
    counts = stored(docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n")))
    return picks(weighted(counts, weights)), counts.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def placed(docs: DataFrame, blocks: DataFrame, most: int, *carried: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns of their own for source, block, rank in it, and those named of blocks; and how these are called. most: rows of the largest source."""
    own = own_names(docs, "source", "order", "bucket", "before", "row", "block", "offset", "s", "b", *carried)
    rows = docs.withColumns({own["source"]: F.coalesce("source", F.lit("")), own["order"]: F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))})
    digits = max(1, math.ceil(math.log(max(most, BUCKET_ROWS) / BUCKET_ROWS, 16)))
    rows = rows.withColumn(own["bucket"], F.substring(own["order"], 1, digits))
    before = Window.partitionBy(own["s"]).orderBy(own["b"]).rowsBetween(Window.unboundedPreceding, -1)
    buckets = rows.groupBy(F.col(own["source"]).alias(own["s"]), F.col(own["bucket"]).alias(own["b"])).agg(F.count("*").alias("n"))
    buckets = small_or_not(stored(buckets.select(own["s"], own["b"], F.coalesce(F.sum("n").over(before), F.lit(0)).alias(own["before"]))))
    out = rows.withColumn(own["row"], F.row_number().over(Window.partitionBy(own["source"], own["bucket"]).orderBy(own["order"], "doc_id")))
    out = out.join(buckets, (F.col(own["source"]) == F.col(own["s"])) & (F.col(own["bucket"]) == F.col(own["b"]))).drop(own["s"], own["b"])
    rank = F.col(own["before"]) + F.col(own["row"]) - 1
    out = out.withColumns({own["block"]: F.floor(rank / BLOCK).cast("long"), own["offset"]: (rank % BLOCK).cast("long")})
    slots = small_or_not(blocks.select(F.col("source").alias(own["s"]), F.col("block").alias(own["b"]), *[F.col(c).alias(own[c]) for c in carried]))
    return out.join(slots, (F.col(own["source"]) == F.col(own["s"])) & (F.col(own["block"]) == F.col(own["b"]))), own


def schedule(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """doc_id, source, block, release_slot, due_slot, slot, place: one row for each row of docs, by narrow columns only."""
    docs = docs.select("doc_id", "source")
    out, own = placed(docs, *plan(docs, weights), "release_slot", "due_slot", "slot")
    return out.select("doc_id", *[F.col(own[c]).alias(c) for c in ("source", "block", "release_slot", "due_slot", "slot")], F.col(own["offset"]).alias("place"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """All rows of docs, in the order of the mix over its partitions and in each of them.

    How many rows come before a block follows from the schedule, so blocks are dealt to even partitions without sampling.
    """
    blocks, most = plan(docs, weights)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of = blocks.groupBy("step").agg(F.sum("rows").alias("all"))  # few rows: one a step
    of = of.select(F.col("step").alias("of"), F.coalesce(F.sum("all").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("past"), F.sum("all").over(Window.partitionBy()).alias("total"))
    inner = F.coalesce(F.sum("rows").over(Window.partitionBy("step").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("inner", inner).join(F.broadcast(of), F.col("step") == F.col("of"))
    blocks = stored(blocks.select("source", "block", "slot", F.expr(f"cast((past + inner) * {parts} div total as int)").alias("part")))
    out, own = placed(docs, blocks, most, "slot", "part")
    return out.repartitionById(parts, F.col(own["part"])).sortWithinPartitions(own["slot"], own["offset"]).select(*docs.columns)


ORACLE_SQL = f"""
with recursive counts as (select coalesce(source, '') as source, count(*) as n from documents group by 1),
quota as (select source, greatest(1, cast(floor(sqrt(n) * {UNIT}) as bigint)) as k, cast((n + {BLOCK - 1}) // {BLOCK} as bigint) as blocks from counts),
lists as (select list(k order by source) as ks, list(blocks order by source) as bs, list(source order by source) as names, cast(sum(k) as bigint) as total, cast(sum(blocks) as bigint) as all_blocks from quota),
free as (
  select cast(0 as bigint) as n, cast(0 as bigint) as t, list_transform(ks, lambda k: cast(0 as bigint)) as done, cast(0 as bigint) as pick, cast(0 as bigint) as slot, cast(0 as bigint) as block from lists
  union all
  select n + 1, now + 1, list_transform(done, lambda d, i: d + case when i = p then 1 else 0 end), p, now, done[p]
  from (
    select n, done, now, ks, list_min(list_filter(list_transform(ks, lambda k, i: case when done[i] < bs[i] and (cast(done[i] as hugeint) * total) // k <= now
        then row(cast(((cast(done[i] as hugeint) + 1) * total + k - 1) // k as bigint), i) end), lambda x: x is not null))[2] as p
    from (
      select n, done, ks, bs, total, greatest(t, list_min(list_filter(list_transform(ks, lambda k, i: case when done[i] < bs[i] then cast((cast(done[i] as hugeint) * total) // k as bigint) end), lambda x: x is not null))) as now
      from free, lists where n < all_blocks
    )
  )
),
slots as (
  select names[pick] as source, block, slot, cast((cast(block as hugeint) * total) // ks[pick] as bigint) as release_slot, cast(((cast(block as hugeint) + 1) * total + ks[pick] - 1) // ks[pick] as bigint) as due_slot
  from free, lists where n > 0
),
ranked as (select doc_id, coalesce(source, '') as source, row_number() over (partition by coalesce(source, '') order by md5(coalesce(cast(doc_id as varchar), '')), doc_id) - 1 as r from documents)
select doc_id, s.source, s.block, s.release_slot, s.due_slot, s.slot, cast(r % {BLOCK} as bigint) as place
from ranked r join slots s on s.source = r.source and s.block = r.r // {BLOCK}
"""
