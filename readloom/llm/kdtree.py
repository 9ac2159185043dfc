"""Exact top-k by inner product, over a KD-tree for each shard.

A component x counts as floor(1024 * x), so scores are exact integers. A shard's tree splits the widest side of a
node at its median and keeps the tight box of each node. A box bounds a query's score from above, so best-first
traversal opens nodes by falling bound and ends when no bound reaches the k-th score found. That k-th score goes on:
each block of queries searches one shard first, and what it finds there is where the search of all others begins.

Shards and blocks are of bounded size, dealt by a hash of the id, and meet pair by pair in tasks of their own; a
query brings k rows back from a shard at most. Nothing is broadcast or collected.

An empty table gives no rows; a table without queries or candidates none. Columns beside vec_id and embedding play no part,
whatever their names; very long vectors are split by their widest sides like any others.

Rows whose vector is null or has a null or non-finite component take no part. Shorter vectors are filled up with
zeros. Rows that repeat an id are candidates each; as queries, equal rows ask once, and no row of the query's own id
is an answer. Components beyond 2^31 after scaling are compared in unbounded integers; scores beyond a long are its ends.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SCALE = 1024
LEAF = 64
#: Rows of a shard and queries of a block at most, on average: what a task holds. Large ones keep copies few, as each shard
#: goes to each block; with few rows, shards of FEW_ROWS give every core some.
SHARD_ROWS = 131_072
BLOCK_QUERIES = 65_536
FEW_ROWS = 4_096


class Tree:
    """A KD-tree over rows of numbers that a float64 holds exactly."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.nodes: list[tuple[int, int, int]] = []  # begin, end, left child (the right one follows it) or 0
        order = np.arange(len(ids))
        low, high = [], []
        self.nodes.append((0, len(ids), 0))
        at = 0
        while at < len(self.nodes):
            begin, end, _ = self.nodes[at]
            part = rows[order[begin:end]]
            lo, hi = part.min(axis=0), part.max(axis=0)
            low.append(lo)
            high.append(hi)
            if end - begin > LEAF and (hi > lo).any():
                side, middle = int((hi - lo).argmax()), (end - begin) // 2
                order[begin:end] = order[begin:end][np.argpartition(part[:, side], middle)]
                self.nodes[at] = (begin, end, len(self.nodes))
                self.nodes += [(begin, begin + middle, 0), (begin + middle, end, 0)]
            at += 1
        self.ids, self.rows, self.low, self.high = ids[order], rows[order], np.array(low), np.array(high)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray) -> list[list[tuple[int, int]]]:
        """The k best (score, id) of each query, of scores of at least its floor; ties by smaller id."""
        found = []
        for at in range(0, len(queries), 256):
            some = queries[at : at + 256]
            bounds = np.maximum(some, 0) @ self.high.T + np.minimum(some, 0) @ self.low.T
            found += [self.best(q, i, b, k, f) for q, i, b, f in zip(some, query_ids[at : at + 256], bounds.tolist(), floors[at : at + 256].tolist(), strict=True)]
        return found

    def best(self, query: np.ndarray, own: int, bounds: list[float], k: int, floor: float) -> list[tuple[int, int]]:
        top: list[tuple[float, int]] = []  # a heap of (score, -id), the k-th first
        todo = [(-bounds[0], 0)]
        while todo and -todo[0][0] >= floor:
            begin, end, left = self.nodes[heapq.heappop(todo)[1]]
            if left:
                for child in (left, left + 1):
                    if bounds[child] >= floor:
                        heapq.heappush(todo, (-bounds[child], child))
                continue
            scores = self.rows[begin:end] @ query
            for j in np.flatnonzero(scores >= floor).tolist():
                if (i := int(self.ids[begin + j])) != own:
                    item = (scores[j], -i)
                    if len(top) < k:
                        heapq.heappush(top, item)
                    elif item > top[0]:
                        heapq.heapreplace(top, item)
            if len(top) == k:
                floor = max(floor, top[0][0])
        return [(s, -i) for s, i in top]


def exact(*vectors: np.ndarray) -> bool:
    """Whether all inner products of the rows are exact in float64."""
    high = [float(np.abs(v).max(initial=0)) for v in vectors]
    return high[0] * high[1] * max(1, vectors[0].shape[1]) < 2**53


def filled(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for k, v in enumerate(rows):
        out[k, : len(v)] = v
    return out


def found_in(k: int):
    def search(queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(queries) and len(shard):
            width = max(queries["v"].map(len).max(), shard["v"].map(len).max())
            q, v = filled(queries["v"], width), filled(shard["v"], width)
            ids, asked = shard["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
            if exact(q, v):
                hits = Tree(ids, v).search(asked, q, k, queries["floor"].fillna(-math.inf).to_numpy(float))
                out = [(int(a), int(i), int(s)) for a, h in zip(asked, hits, strict=True) for s, i in h]
            else:
                whole = [[int(x) for x in row] for row in v]
                for a, row in zip(asked, q, strict=True):
                    row = [int(x) for x in row]
                    all_ = sorted((-sum(map(int.__mul__, row, w)), int(i)) for i, w in zip(ids, whole, strict=True) if i != a)
                    out += [(int(a), i, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for s, i in all_[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return search


def top_k(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score for each row whose vec_id is divisible by every."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.filter(F.col("embedding").isNotNull() & whole & F.col("vec_id").isNotNull())
    rows = stored(rows.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("double")).alias("v")))
    asked = stored(rows.filter(F.col("vec_id") % every == 0).distinct())
    n, m = rows.count(), asked.count()
    cores = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards, blocks = max(1, math.ceil(n / SHARD_ROWS), min(cores, n // FEW_ROWS)), max(1, math.ceil(m / BLOCK_QUERIES))
    shard, block = F.pmod(F.xxhash64("vec_id", F.lit("shard")), F.lit(shards)), F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks))
    home = F.pmod(F.col("block"), F.lit(shards))
    held = rows.withColumn("shard", shard).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    asked = asked.withColumn("block", block).withColumn("floor", F.lit(None).cast("double"))
    schema = "query_id long, vec_id long, score long"
    meet = lambda q, v: q.groupBy("shard", "block").cogroup(v.groupBy("shard", "block")).applyInPandas(found_in(k), schema)
    first = stored(meet(asked.withColumn("shard", home), held.filter(F.col("shard") == home)))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = first
    if shards > 1:
        floors = first.withColumn("r", F.row_number().over(best)).filter(F.col("r") == k).select("query_id", F.col("score").cast("double").alias("floor"))
        others = asked.drop("floor").join(floors, F.col("vec_id") == F.col("query_id"), "left").drop("query_id")
        others = others.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>"))).filter(F.col("shard") != home)
        found = first.unionByName(meet(others, held.filter(F.col("shard") != home)))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id
),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""
