import random

import numpy as np
import xxhash

from readloom.llm import simhash
from readloom.llm.components import components

SCHEMA = "doc_id long, text string, fp string, key string, component_id string"


def brute_fp(text, k=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [b" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(docs):
    fps = {i: brute_fp(t) for i, t in docs}
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2:
                ra, rb = sorted((find(a), find(b)))
                root[rb] = ra
    return {i: (f"{fps[i]:016x}", find(i)) for i in fps}


def corpus():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdé") for _ in range(4)) for _ in range(300)]
    docs = []
    for k in range(60):
        base = [rnd.choice(words) for _ in range(rnd.choice([3, 40, 400]))]
        docs.append(" ".join(base))
        for _ in range(rnd.choice([0, 0, 3])):
            copy = list(base)
            copy[rnd.randrange(len(copy))] = rnd.choice(words)
            docs.append("\n".join(copy))
        if k % 9 == 0:
            docs += [docs[-1].upper()] * 3
    docs += [None, "", " \n", "one", "One two", "x" * 50_000]
    return list(enumerate(docs, 10))


def run(spark, docs, **kw):
    df = spark.createDataFrame([(i, t, "", "", "") for i, t in docs], SCHEMA)
    return {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df, **kw).collect()}


def test_against_brute_force(spark):
    docs = corpus()
    assert run(spark, docs) == brute(docs)


def test_crowded_keys_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 3)
    docs = corpus()
    assert run(spark, docs) == brute(docs)


def test_planes_against_counts():
    rng = np.random.default_rng(1)
    for width, radius in ((1, 2), (4, 48), (1, 3), (1, 0)):
        n = 700
        key = np.sort(rng.integers(0, 9, n))
        fp = rng.integers(0, 1 << 63, (20, width)).astype(np.uint64)[rng.integers(0, 20, n)]
        for i in range(n):
            for b in rng.integers(0, 64 * width, rng.integers(0, radius + 3)).tolist():
                fp[i, b // 64] ^= np.uint64(1 << b % 64)
        got = {p for a, b in simhash.near_lanes(key, fp, radius) for p in zip(a.tolist(), b.tolist(), strict=True)}
        assert got == {(i, j) for i in range(n) for j in range(i) if key[i] == key[j] and sum(bin(int(x)).count("1") for x in fp[i] ^ fp[j]) <= radius}


def test_null_ids_repeats_and_empty(spark):
    text = " ".join(f"w{k}" for k in range(50))
    df = spark.createDataFrame([(None, text, "", "", ""), (4, text, "", "", ""), (4, text, "", "", ""), (None, "alone here now", "", "", "")], SCHEMA)
    got = sorted(((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(-1, 4), (4, 4), (4, 4), (-1, None)], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in simhash.keep_one(df).collect()) == ["4", "4", "None"]


def by_hand(spark, monkeypatch, rows, method):
    """Classes of rows (doc_id, fingerprint), each with a text of its own."""
    made = "doc_id long, text_hash long, fp array<long>, bands array<long>, name binary"
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, m: spark.createDataFrame([(i, f, [f], [], None) for i, f in rows], made))
    return sorted(((r.doc_id if r.doc_id is not None else -1, r.component_id) for r in simhash.classes(None, method).collect()), key=str)


def test_rows_without_an_id_link_and_an_id_of_two_texts_joins_no_others(spark, monkeypatch):
    assert by_hand(spark, monkeypatch, [(1, 0b0), (None, 0b11), (2, 0b1111)], simhash.EXACT) == [(-1, 1), (1, 1), (2, 1)]
    far = [(5, 0), (5, -65536), (2, -65535)]
    assert by_hand(spark, monkeypatch, far, simhash.EXACT) == [(2, 2), (5, 2), (5, 5)]
    assert by_hand(spark, monkeypatch, [(None, 7), (None, 7), (None, 5)], simhash.EXACT) == [(-1, None)] * 3


def test_near_method_with_null_and_repeated_ids(spark):
    rnd = random.Random(4)
    base, other = ([f"{c}{rnd.randrange(9000)}" for _ in range(200)] for c in "xy")
    near = [*base[:100], "edit", *base[101:]]
    rows = [(7, base), (None, near), (9, near), (7, other), (3, [*other, "more"]), (None, ["alone"] * 9)]
    df = spark.createDataFrame([(i, " ".join(t), "", "", "") for i, t in rows], SCHEMA)
    assert sorted((str(r.doc_id), r.text.split()[0][0]) for r in simhash.keep_one(df).collect()) == [("3", "y"), ("7", "x"), ("None", "a")]


def test_recall_at_the_threshold_over_many_pairs(spark):
    """Copies of a similarity of 0.8 to 0.9 among texts of 60 to 400 words: at least 0.99 of them go, and no other text."""
    rnd = random.Random(21)
    docs, gone = [], set()
    for k in range(300):
        base = [f"w{rnd.randrange(200_000)}" for _ in range(rnd.randint(60, 400))]
        copy, like = edited(rnd, base, rnd.choice([0.8, 0.82, 0.86, 0.9]))
        docs += [base, copy]
        gone.add(2 * k + 1)
        assert like >= 0.8
    df = spark.createDataFrame([(i, " ".join(t), "", "", "") for i, t in enumerate(docs)], SCHEMA)
    left = {r.doc_id for r in simhash.keep_one(df).collect()}
    assert len(gone - left) >= 0.99 * len(gone) and not set(range(len(docs))) - gone - left


def test_near_method_keeps_one_of_each(spark):
    rnd = random.Random(3)
    docs, kept = [], set()
    for k in range(80):
        base = [f"w{rnd.randrange(5000)}" for _ in range(300)]
        kept.add(len(docs))
        docs.append(base)
        for _ in range(3):
            copy = list(base)
            for _ in range(3):  # similarity about 0.9
                copy[rnd.randrange(300)] = "edit"
            docs.append(copy)
    df = spark.createDataFrame([(i, " ".join(t), "", "", "") for i, t in enumerate(docs)], SCHEMA)
    got = {r.doc_id for r in simhash.keep_one(df).collect()}
    assert kept <= got and len(got) <= len(kept) + 2


def edited(rnd, base, share):
    """base with words replaced until its 5-word shingles have just no less than this similarity, and how much that is."""
    sets = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    copy, like = list(base), 1.0
    for n in range(len(base)):
        more = list(copy)
        more[rnd.randrange(len(base))] = f"new{n}"
        a, b = sets(base), sets(more)
        if len(a & b) < share * len(a | b):
            return copy, like
        copy, like = more, len(a & b) / len(a | b)
    return copy, like


def test_near_copies_are_decided_by_their_shingles(spark, monkeypatch):
    rnd = random.Random(8)
    docs, gone = [], set()
    for share in (0.6, 0.65, 0.7, 0.75, 0.78, 0.8, 0.85):
        for _ in range(30):
            base = [f"w{rnd.randrange(50_000)}" for _ in range(400)]
            copy, like = edited(rnd, base, share)
            docs.append(base)
            if like >= 0.8:
                gone.add(len(docs))
            docs.append(copy)
    loop = [f"w{k}" for k in range(60)]
    docs += [loop * 40, loop * 40 + [f"x{k}" for k in range(60)]]  # nearly one multiset, half the set
    df = spark.createDataFrame([(i, " ".join(t), "", "", "") for i, t in enumerate(docs)], SCHEMA)
    want = set(range(len(docs))) - gone
    assert len(gone) >= 60 and {r.doc_id for r in simhash.keep_one(df).collect()} == want
    monkeypatch.setattr(simhash, "TILE_BYTES", 1024)
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == want


def test_components(spark):
    rnd = random.Random(1)
    pairs = [(k, k + 1) for k in range(100, 140)] + [(1, k) for k in range(2, 60)] + [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(120)] + [(5, 5)]
    root = {x: x for p in pairs for x in p}
    for _ in range(200):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if any(k in p and p[0] != p[1] for p in pairs)}
