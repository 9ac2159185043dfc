import hashlib
import random
from collections import Counter

import odd
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from readloom.llm import bpe, common, mixing, quality, secrets, simhash
from readloom.llm.queries import vocabulary


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def similar(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def corpus():
    rnd = random.Random(9)
    docs = []
    for k in range(40):
        docs.append(" ".join(f"w{rnd.randrange(9000)}" for _ in range(120)) + (f' token = "{rnd.getrandbits(160):040x}"' if k % 4 == 0 else ""))
    copies = [docs[k] for k in range(5) for _ in range(6)]
    near = [docs[k].replace(docs[k].split()[60], "edited", 1) for k in range(5, 10)]
    junk = ["short text", "again and again " * 40, None, ""]
    lines = docs + copies + near + junk
    return [(k, t, "en", f"s{k % 3}") for k, t in enumerate(lines)]


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = corpus()
    text = dict((i, t) for i, t, _, _ in docs)
    odd.frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5

    kept = stages["quality rules"](spark, now, str(tmp_path))
    left = {r.doc_id: r.text for r in kept.collect()}
    assert set(left) == {i for i, t in text.items() if (c := quality.measure(t)[0])[0] >= 20 and 100 * c[4] <= 30 * c[0]}
    assert all(left[i] == text[i] for i in left) and kept.columns == now.columns

    kept = stages["SimHash near-dedup"](spark, kept, str(tmp_path))
    first = [i for i in sorted(left) if not any(similar(left[i], left[j]) >= 0.8 for j in sorted(left) if j < i)]
    assert sorted(r.doc_id for r in kept.collect()) == first and kept.columns == now.columns

    kept = stages["secret scans"](spark, kept, str(tmp_path))
    find = secrets.finder(secrets.RULES)
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows) == first and kept.columns == now.columns
    assert all(("[assign]" in r.text) == bool(find(text[r.doc_id])) and "token = " in r.text or not find(text[r.doc_id]) for r in rows)

    mixed = stages["mixing sources to target weights"](spark, kept, str(tmp_path))
    assert Counter(mixed.collect()) == Counter(rows) and mixed.columns == now.columns

    library = Tokenizer.from_file(vocabulary())
    want = {r.doc_id: hashlib.sha256(" ".join(map(str, library.encode(r.text, add_special_tokens=False).ids)).encode()).hexdigest() for r in rows}
    assert {r.doc_id: r.ids_sha256 for r in stages["BPE encoding and decoding"](spark, mixed, str(tmp_path)).collect()} == want
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == want


def test_the_order_of_the_mix_is_in_what_a_run_returns(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 2)
    rnd = random.Random(12)
    docs = [(k, " ".join(f"w{rnd.randrange(9000)}" for _ in range(40)), "en", "abb"[k % 3]) for k in range(300)]
    odd.frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    mixed = mixing.mix(odd.frame(spark, docs)).rdd.glom().collect()
    assert len({(r.mix_part, r.mix_row) for r in rows}) == 300
    assert [r.doc_id for r in sorted(rows, key=lambda r: (r.mix_part, r.mix_row))] == [r.doc_id for part in mixed for r in part]


def test_odd_and_empty_documents(spark, tmp_path):
    for name, docs in (("odd", odd.documents()), ("none", [])):
        odd.frame(spark, docs).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert bool(out) == bool(docs)


def test_columns_of_any_name_stay_through_all_stages_but_the_last(spark):
    names = {"kept": "__kept", "row": "__host", "blob": "__blob", "node": "__new", "slot": "__rank", "removed": "__removed", "digest": "__digest"}
    docs = odd.frame(spark, corpus() + odd.documents()[-8:]).withColumnsRenamed(names)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() > 0


STEPS = {
    "features": quality.features,
    "fingerprints": lambda docs: simhash.fingerprints(docs, simhash.NEAR),
    "sets": lambda docs: simhash.sets(docs, docs.selectExpr("xxhash64(text) as node", "0L as root"), simhash.NEAR),
    "scan": lambda docs: secrets.scan(docs.selectExpr("cast(cast(doc_id as string) as binary) as blob", "text"), secrets.RULES),
    "encoding": lambda docs: bpe.encode_documents(docs, vocabulary()),
}


@pytest.mark.parametrize("step", STEPS)
def test_python_workers_get_few_bytes_at_once(spark, monkeypatch, step):
    frame = type(spark.range(0))

    def bounded(run):
        def checked(batches):
            for batch in batches:
                assert batch.nbytes < 4 << 20
                yield batch

        return lambda batches: run(checked(batches))

    monkeypatch.setattr(frame, "mapInArrow", lambda self, run, schema, plain=frame.mapInArrow: plain(self, bounded(run), schema))
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    text = "concat_ws(' ', transform(sequence(1, 2500), i -> concat('w', pmod(xxhash64(id, i), 1000)))) as text"
    docs = common.stored(spark.range(0, 1000, 1, 1).selectExpr("id as doc_id", text, "'a' as source")).coalesce(1)
    assert STEPS[step](docs).count() == 1000
