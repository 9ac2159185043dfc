from collections import Counter, defaultdict
from fractions import Fraction

import odd
import pytest

from readloom.llm import mixing


def quotas(spark, weights, blocks):
    rows = [(f"s{k:04}", float(w), n * mixing.BLOCK) for k, (w, n) in enumerate(zip(weights, blocks, strict=True))]
    frame = spark.createDataFrame(rows, "source string, w double, n long")
    return mixing.weighted(frame, {s: w for s, w, _ in rows})


def by_heap(ks, blocks):
    """The same schedule from its definition: release floor(j * total / k), due ceil((j + 1) * total / k), a slot at a time or where the next release is."""
    total, done, t, out = sum(ks), [0] * len(ks), 0, []
    while any(d < b for d, b in zip(done, blocks, strict=True)):
        open_ = [s for s in range(len(ks)) if done[s] < blocks[s]]
        t = max(t, min(done[s] * total // ks[s] for s in open_))
        _, s = min((-(-(done[s] + 1) * total // ks[s]), s) for s in open_ if done[s] * total // ks[s] <= t)
        out.append((s, done[s], t))
        done[s] += 1
        t += 1
    return out


@pytest.mark.parametrize("weights", [[1.0], [3.0, 1.0], [7.0] * 3, [0.5] + [0.5 / 19] * 19, [2**0.5, 3**0.5, 5**0.5, 1e-4], [0.0004, 0.9991, 0.0005]])
def test_schedule_stays_within_a_block_of_the_given_weights(spark, monkeypatch, weights):
    monkeypatch.setattr(mixing, "ROUNDS", 16)
    shares = [Fraction(w) / sum(map(Fraction, weights)) for w in weights]
    blocks = [int((10_000 if min(weights) == 0.0004 else 2100) * w) + 3 for w in shares]
    frame = quotas(spark, weights, blocks)
    got = sorted((r.slot, int(r.source[1:]), r.block, r.release_slot, r.due_slot) for r in mixing.picks(frame).collect())
    assert [(s, j, t) for t, s, j, _, _ in got] == by_heap([r.k for r in frame.orderBy("source").collect()], blocks)
    done, full = [0] * len(weights), min(b / w for b, w in zip(blocks, shares, strict=True))
    for n, (t, s, j, a, d) in enumerate(got):
        assert j == done[s] and a <= t < d
        done[s] += 1
        assert abs(shares[s] * (t + 1) - done[s]) < 1 + Fraction(1, 1000)
        if n % 50 == 0 and t < full:
            assert all(abs(w * (t + 1) - x) < 1 + Fraction(1, 1000) for w, x in zip(shares, done, strict=True))


def test_every_row_has_its_place(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 4)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 8)
    docs = odd.documents()
    got = mixing.schedule(odd.frame(spark, docs)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in docs)
    by = defaultdict(list)
    for r in got:
        by[r.source].append((r.block, r.place, r.slot, r.release_slot, r.due_slot))
    for source, rows in by.items():
        rows.sort()
        assert [(b, p) for b, p, *_ in rows] == [(k // 4, k % 4) for k in range(len(rows))], source
        assert all(a <= s < d for _, _, s, a, d in rows)
    assert len({(r.slot, r.place) for r in got}) == len(got)


def test_given_weights_and_order(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 2)
    docs = [(k, f"t{k}", "en", "ab"[k % 2]) for k in range(400)]
    df = odd.frame(spark, docs)
    out = mixing.mix(df, {"a": 3.0, "b": 1.0})
    assert out.columns == df.columns
    rows = out.rdd.glom().collect()
    mixed = [r.source for part in rows for r in part]
    assert Counter(mixed) == {"a": 200, "b": 200}
    for n in range(1, 260):
        assert abs(mixed[:n].count("a") - 0.75 * n) <= 5


def test_the_mix_keeps_a_target_of_a_half_beside_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 1)
    docs = [(k, f"t{k}", "en", "a" if k < 1000 else f"s{k % 100:02}") for k in range(2000)]
    rows = [r.source for part in mixing.mix(odd.frame(spark, docs), {"a": 0.5} | {f"s{k:02}": 0.005 for k in range(100)}).rdd.glom().collect() for r in part]
    assert len(rows) == 2000
    for n in range(1, 1900):
        assert abs(rows[:n].count("a") - n / 2) <= 1


def test_the_mix_takes_any_number_of_sources(spark):
    docs = [(k, f"t{k}", "en", f"s{k % 1203}") for k in range(2500)]
    assert sorted(r.doc_id for r in mixing.mix(odd.frame(spark, docs)).collect()) == list(range(2500))


def test_the_schedule_takes_any_number_of_sources(spark):
    got = mixing.schedule(odd.frame(spark, [(k, "", "", f"s{k % 501}") for k in range(1002)])).collect()
    assert sorted(r.doc_id for r in got) == list(range(1002)) and all(r.release_slot <= r.slot < r.due_slot for r in got)


def test_no_python_on_the_way(spark):
    plan = mixing.mix(odd.frame(spark))._jdf.queryExecution().executedPlan().toString() + mixing.schedule(odd.frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_clashing_columns_stay(spark):
    frame = odd.frame(spark).withColumnsRenamed({"row": "__row", "slot": "__slot", "node": "__source", "digest": "s"})
    assert mixing.mix(frame).columns == frame.columns and Counter(mixing.mix(frame).collect()) == Counter(frame.collect())


def test_empty_table(spark):
    assert mixing.schedule(odd.frame(spark, [])).count() == 0 and mixing.mix(odd.frame(spark, [])).count() == 0
