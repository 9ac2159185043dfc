"""SimHash near-duplicates, compared as bit planes.

A document's fingerprint has a bit for each bit that is set in over half of its shingles' hashes. Fingerprints that
could link share a block key; the fingerprints of a key stand in blocks of 64 lanes, stored as one 64-bit word for
each bit plane. A query is compared with 64 others at once: its bit, spread over a word, is XORed with the plane, and
the differences are added to bitwise counters, two planes at a time by a carry-save adder. Counters start such that
they overflow just beyond the radius; comparisons whose 64 lanes have all overflowed are abandoned.

Block keys are either exact (EXACT: for a radius of 2, the fingerprint's 16-bit quarters, of which two must agree, so
six keys) or of minima of the shingles' hashes (NEAR: for a similarity of 5-word shingles of 0.8, of which a simhash of
64 bits, let alone a radius of 2, says little). Equal fingerprints are one before anything is compared. Keys with more
than TILE fingerprints are cut into tiles, and each pair of tiles is a task's group, so no group is unbounded, and what
a group returns is a spanning forest of its links, not its pairs; links between different fingerprints are all found.

A method with a similarity takes fingerprints only as a filter. Texts of the same set of shingles are one before
anything is compared. What the filter connects is compared again, by the sets themselves, each of which moves once for
each tile that its component has; only pairs whose sets have the similarity are links. A pair that links join already
needs no look at its sets.

What links is the fingerprint, or the set of shingles, not the row: a class's id is the least id of all rows whose
fingerprints are connected. A row without an id links like any other and gets its class's id, null only if no row of
the class has one; an id that stands at several texts is in the class of each.

A null or wordless text has the fingerprint zero and links like any other. Repeated rows are equal fingerprints. A very
long text is hashed shingle by shingle, its counts a block of hashes at a time. Empty tables give no rows. Other columns
play no part, whatever their names; keep_one() returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, own_names, small_or_not, stored
from .components import components

TILE = 2048
#: Comparisons of a query with 64 lanes that are worked on at once.
AT_ONCE = 1 << 15
#: Rows that a task gathers before it compares; a key's rows, 2 * TILE at most, are never parted.
GATHER = 1 << 16
SEED = 42
#: Bytes of shingle sets that a tile should have at most, on average, and that a task gathers before it compares.
TILE_BYTES = 1 << 24
GATHER_BYTES = 1 << 26


@dataclass(frozen=True)
class Method:
    """words of a shingle; 64-bit words of a fingerprint; the radius; bands and rows of minima, or no bands for the exact keys; per cent of all shingles of two that both have, or 0 to link by fingerprints alone."""

    shingle: int
    width: int
    radius: int
    bands: int = 0
    rows: int = 0
    percent: int = 0


EXACT = Method(shingle=3, width=1, radius=2)
#: Similar by 0.8: 256 bits differ in 39 on average, give or take 6, so a radius of 60 passes over 1 pair in 10,000; of twenty bands of four minima one at least agrees with probability 0.99998.
NEAR = Method(shingle=5, width=4, radius=60, bands=20, rows=4, percent=80)


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of k words, A-Z lowered, joined by a space; of all words if they are fewer; of none, none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, xx = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([xx(joined, SEED)], np.uint64)
    ends = [n + i for i, n in enumerate(accumulate(map(len, words)))]
    starts = [0, *[e + 1 for e in ends]]
    return np.array([xx(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :], strict=False)], np.uint64)


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of a hash; the 0th is itself."""
    if not k:
        return h
    h = (h ^ np.uint64((0x9E3779B97F4A7C15 * k) & (1 << 64) - 1)) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(29))


def fingerprint(h: np.ndarray, width: int = 1) -> list[int]:
    """Words of 64 bits, each bit set if over half of the hashes have it."""
    out = []
    for k in range(width):
        count = np.zeros(64, np.int64)
        for at in range(0, len(h), 8192):
            bits = np.unpackbits(mixed(h[at : at + 8192], k).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            count += bits.sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * count > len(h), bitorder="little").view("<u8")[0]))
    return out


def minima(h: np.ndarray, n: int) -> np.ndarray:
    """The least of each of n further hashes, over all hashes; zeros if there are none."""
    if not len(h):
        return np.zeros(n, np.uint64)
    out = np.full(n, np.iinfo(np.uint64).max)
    factors = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) & (1 << 64) - 1 | 1 for k in range(n)], np.uint64)
    for at in range(0, len(h), 2048):
        x = (h[at : at + 2048, None] ^ (factors >> np.uint64(7))) * factors
        out = np.minimum(out, (x ^ (x >> np.uint64(31))).min(axis=0))
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, method: Method) -> DataFrame:
    """doc_id, text_hash, fp array<long>, bands array<long>, name binary, of the set of shingles if the method has a similarity: one row for each row of docs, without a shuffle."""
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, bands, names = [], [], []
            for t in batch.column(2):
                h = shingle_hashes(t.as_py(), method.shingle)
                if method.percent:
                    h = np.unique(h)
                names.append(xxhash.xxh128_digest(h.tobytes()) if method.percent else None)
                fps.append([signed(x) for x in fingerprint(h, method.width)])
                low = minima(h, method.bands * method.rows).tolist()
                bands.append([signed(xxhash.xxh64_intdigest(repr((k, low[k * method.rows : (k + 1) * method.rows])))) for k in range(method.bands)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, longs), pa.array(bands, longs), pa.array(names, pa.binary())], names=["doc_id", "text_hash", "fp", "bands", "name"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text"), run, "doc_id long, text_hash long, fp array<long>, bands array<long>, name binary")


def exact_keys(fp: Column) -> Column:
    """Of the four 16-bit quarters of a fingerprint, each two with their places: of 2 differing bits two quarters are free."""
    part = [F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    pairs = [(a, b) for a in range(4) for b in range(a)]
    return F.array(*[F.shiftleft(F.lit(n).cast("long"), 32).bitwiseOR(F.shiftleft(part[a], 16)).bitwiseOR(part[b]) for n, (a, b) in enumerate(pairs)])


def near_lanes(key: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), j < i, of rows with equal keys whose fingerprints differ in at most radius bits. key is sorted; fp has a row of words each."""
    n, one = len(key), np.uint64(1)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if n else np.empty(0, np.int64)
    size = np.diff(np.r_[first, n])
    place = np.arange(n) - np.repeat(first, size)
    blocks = (size + 63) // 64
    block_of = np.repeat(np.cumsum(blocks) - blocks, size) + place // 64
    lane = (place % 64).astype(np.uint64)
    begins = np.flatnonzero(np.r_[True, block_of[1:] != block_of[:-1]]) if n else first
    planes = [np.add.reduceat(((fp[:, b // 64] >> np.uint64(b % 64)) & one) << lane, begins) if n else None for b in range(64 * fp.shape[1])]
    filled = np.add.reduceat(one << lane, begins) if n else None
    todo = np.where(place > 0, place // 64 + 1, 0)
    todo[(place % 64 == 0) & (place > 0)] -= 1  # the first of a block has none before it there
    bits = max(1, radius.bit_length())
    start = (1 << bits) - 1 - radius
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    ends = np.cumsum(todo)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, side="right")))
        count = todo[at:to]
        q = np.repeat(np.arange(at, to), count)
        if len(q):
            k = np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count)
            block = block_of[q] - place[q] // 64 + k
            over = ~filled[block]
            own = block == block_of[q]
            over[own] |= ~((one << lane[q[own]]) - one)
            counter = [np.full(len(q), full if start >> c & 1 else np.uint64(0)) for c in range(bits)]
            for b in range(0, len(planes), 2):
                x, y = (planes[b + d][block] ^ (np.uint64(0) - ((fp[q, (b + d) // 64] >> np.uint64((b + d) % 64)) & one)) for d in (0, 1))
                half = counter[0] ^ x
                carry = (counter[0] & x) | (half & y)
                counter[0] = half ^ y
                for c in range(1, bits):
                    counter[c], carry = counter[c] ^ carry, counter[c] & carry
                over |= carry
                if b % 8 == 6:
                    live = over != full
                    if 4 * np.count_nonzero(live) < 3 * len(live):
                        q, block, over, counter = q[live], block[live], over[live], [c[live] for c in counter]
                        if not len(q):
                            break
            live = over != full
            q, block, over = q[live], block[live], over[live]
            if len(q):
                hit, which = np.nonzero(np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                yield q[hit], begins[block[hit]] + which
        at = to


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least row that each of n rows reaches over pairs."""
    root = np.arange(n)
    for a, b in pairs:
        while len(a):
            ra, rb = root[a], root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (root[root] != root).any():
                root = root[root]
    return root


def tiled(rows: DataFrame, tiles: DataFrame) -> DataFrame:
    """rows once for each pair of tiles (i, j) that its tile is in. rows: key, node and more; tiles: key, tiles of the keys with over one; stored."""
    zero = F.lit(0).cast("long")
    more = [c for c in rows.columns if c != "key"]
    if tiles.isEmpty():
        return rows.select("key", zero.alias("i"), zero.alias("j"), *more)
    rows = rows.join(small_or_not(tiles), "key", "left").withColumn("t", F.pmod(F.xxhash64("node"), F.coalesce("tiles", F.lit(1))))
    other = F.explode(F.sequence(zero, F.coalesce("tiles", F.lit(1)) - 1))
    return rows.withColumn("o", other).select("key", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), *more)


def compared(rows: DataFrame, method: Method) -> DataFrame:
    """a, b: of each group (key, i, j) of rows a forest of links of near fingerprints, and of sets that are alike if rows have shingles."""
    exact = "shingles" in rows.columns

    def compare(batch: pa.Table) -> pa.RecordBatch:
        key = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")])
        change = np.r_[False, (key[:, 1:] != key[:, :-1]).any(axis=0)]
        fp = batch.column("fp").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, method.width)
        node = batch.column("node").to_numpy()
        pairs = near_lanes(np.cumsum(change), fp, method.radius)
        root = alike(pairs, [np.frombuffer(x.as_buffer(), "<u8") for x in batch.column("shingles")], method.percent) if exact else forest(len(node), pairs)
        moved = root != np.arange(len(root))
        return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[root[moved]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if len(held) < GATHER and held.nbytes < GATHER_BYTES:
                continue
            key = np.stack([held.column(c).to_numpy() for c in ("key", "i", "j")])
            last = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0))
            if len(last):
                yield compare(held.slice(0, last[-1] + 1).combine_chunks())
                held = held.slice(last[-1] + 1)
        if held is not None and len(held):
            yield compare(held.combine_chunks())

    return map_batches(rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), run, "a long, b long").filter("a <> b")


def links(nodes: DataFrame, method: Method) -> DataFrame:
    """a, b: enough links of near fingerprints to connect all that are connected. nodes: node long, fp array<long>, keys array<long>; stored."""
    rows = nodes.select(F.explode(F.array_distinct("keys")).alias("key"), "node", "fp")
    crowded = stored(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > TILE).select("key", F.ceil(F.col("n") / TILE).alias("tiles")))
    return compared(tiled(rows, crowded), method)


def set_links(rows: DataFrame, method: Method) -> DataFrame:
    """a, b: enough links of sets that are alike to connect all that are connected. rows: sets(), stored."""
    tiles = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum(F.length("shingles")) / TILE_BYTES))
    crowded = stored(rows.groupBy("key").agg(tiles.alias("tiles")).filter("tiles > 1"))
    return compared(tiled(rows, crowded), method)


def sets(docs: DataFrame, connected: DataFrame, method: Method) -> DataFrame:
    """key, node, fp array<long>, shingles binary (sorted hashes) of docs whose text's hash is a node. connected: node, root; its root is the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [np.unique(shingle_hashes(t.as_py(), method.shingle)) for t in batch.column(2)]
            fps = pa.array([[signed(x) for x in fingerprint(x, method.width)] for x in h], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps, pa.array([x.astype("<u8").tobytes() for x in h], pa.binary())], names=["key", "node", "fp", "shingles"])

    rows = docs.select(F.xxhash64("text").alias("node"), "text").join(small_or_not(connected), "node").select(F.col("root").alias("key"), "node", "text")
    return map_batches(rows.dropDuplicates(["key", "node", "text"]), run, "key long, node long, fp array<long>, shingles binary")


def alike(pairs: Iterator[tuple[np.ndarray, np.ndarray]], shingles: list[np.ndarray], percent: int) -> np.ndarray:
    """The least row that each row reaches over those pairs whose sets have the similarity."""
    root = np.arange(len(shingles))
    size = np.array([len(x) for x in shingles], np.int64)

    def top(i: int) -> int:
        while root[i] != i:
            i = int(root[i])
        return i

    for a, b in pairs:
        fit = 100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b])
        a, b = a[fit], b[fit]
        for at in range(0, len(a), 4096):
            x, y = a[at : at + 4096], b[at : at + 4096]
            apart = root[x] != root[y]
            for i, j in zip(x[apart].tolist(), y[apart].tolist(), strict=True):
                if (ri := top(i)) == (rj := top(j)):
                    continue
                few, many = sorted((shingles[i], shingles[j]), key=len)
                place = np.searchsorted(many, few)
                both = int(np.count_nonzero(many[np.minimum(place, len(many) - 1)] == few)) if len(few) else 0
                if 100 * both >= percent * (len(few) + len(many) - both):
                    root[max(ri, rj)] = min(ri, rj)
            while (root[root] != root).any():
                root = root[root]
    return root


def classes(docs: DataFrame, method: Method) -> DataFrame:
    """doc_id, text_hash, fp array<long>, component_id: one row for each row of docs.

    A node is a fingerprint, or of sets the least hash of the texts that have the set.
    """
    found = stored(fingerprints(docs, method))
    if method.percent:
        unique = found.groupBy("name").agg(F.min("doc_id").alias("least"), F.min("text_hash").alias("node"), F.first("fp").alias("fp"), F.first("bands").alias("keys"))
    else:
        found = found.withColumn("name", F.col("fp")[0])
        unique = found.groupBy("name").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp")).withColumns({"node": F.col("name"), "keys": exact_keys(F.col("name"))})
    unique = stored(unique)
    joined = components(links(unique, method))
    if method.percent:
        joined = components(set_links(stored(sets(docs, stored(joined), method)), method))
    linked = stored(unique.select("name", "node", "least").join(joined, "node"))
    of = linked.select("name", "root").join(linked.groupBy("root").agg(F.min("least").alias("of")), "root").select("name", "of")
    # stored, so that the join to rows is one that Spark splits where very many rows have one name
    of = small_or_not(stored(unique.select("name", "least").join(of, "name", "left").select("name", F.coalesce("of", "least").alias("component_id"))))
    return found.select("doc_id", "text_hash", "fp", "name").join(of, "name").select("doc_id", "text_hash", "fp", "component_id")


def near_duplicates(docs: DataFrame, method: Method = EXACT) -> DataFrame:
    """doc_id, fingerprint in hex, component_id: one row for each row of docs."""
    word = lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")
    return classes(docs, method).select("doc_id", F.array_join(F.transform(F.reverse("fp"), word), "").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, method: Method = NEAR) -> DataFrame:
    """docs without those whose class has an earlier id. A row without an id goes if its class has one, else it stays.

    Only ids and hashes of texts that go are joined, broadcast if a count proves them few; else texts move once.
    """
    own = own_names(docs, "id", "hash")
    gone = classes(docs, method).filter("doc_id > component_id or doc_id is null and component_id is not null")
    gone = small_or_not(stored(gone.select(F.col("doc_id").alias(own["id"]), F.col("text_hash").alias(own["hash"])).distinct()))
    return docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(own["id"])) & (F.xxhash64("text") == F.col(own["hash"])), "left_anti")
