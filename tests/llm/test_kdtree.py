import math
import random

import pytest

from readloom.llm import kdtree

SCHEMA = "vec_id long, embedding array<float>, label int, score long, rank int, floor double"


def brute(rows, every, k):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in {(i, tuple(v)) for i, v in ok}:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in ok if j != i)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


def vectors(n, dims, seed, values=None):
    rnd = random.Random(seed)
    pick = (lambda: rnd.choice(values)) if values else (lambda: float(f"{rnd.gauss(0, 0.3):.4f}"))
    import numpy as np

    return [(k, [float(np.float32(pick())) for _ in range(dims)]) for k in range(n)]


def run(spark, rows, every=10, k=10):
    df = spark.createDataFrame([(i, v, 0, 0, 0, 0.0) for i, v in rows], SCHEMA)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in kdtree.top_k(df, every, k).collect())


@pytest.mark.parametrize("dims,values", [(2, None), (8, None), (64, None), (3, [0.0, 1.0]), (1, [0.5])])
def test_against_brute_force(spark, monkeypatch, dims, values):
    monkeypatch.setattr(kdtree, "SHARD_ROWS", 150)
    monkeypatch.setattr(kdtree, "BLOCK_QUERIES", 20)
    rows = vectors(600, dims, dims, values)
    assert run(spark, rows) == brute(rows, 10, 10)


def test_odd_vectors(spark):
    rows = vectors(30, 4, 1) + [(100, None), (110, [1.0, None, 2.0, 3.0]), (120, [float("nan")] * 4), (130, [float("inf"), 0.0, 0.0, 0.0]), (140, []), (150, [1.0]), (None, [1.0] * 4), (20, [0.5] * 4), (21, [0.5] * 4), (21, [0.5] * 4)]
    got, want = run(spark, rows), brute(rows, 10, 10)
    assert {r for r in got if r[0] != 20} == {r for r in want if r[0] != 20}
    assert len([r for r in got if r[0] == 20]) == 10  # two vectors of one id share its ranks


def test_few_rows_and_none(spark):
    assert run(spark, vectors(3, 2, 1)) == brute(vectors(3, 2, 1), 10, 10)
    assert run(spark, [(0, [1.0])]) == [] and run(spark, []) == []


def test_huge_components_are_exact(spark):
    rows = [(0, [3.0e30, 1.0]), (1, [3.0e30, 2.0]), (2, [-3.0e30, 0.0]), (3, [0.0, 1.0])]
    assert [(r[2], r[3]) for r in run(spark, rows)] == [(1, (1 << 63) - 1), (3, 1024 * 1024), (2, -(1 << 63))]
