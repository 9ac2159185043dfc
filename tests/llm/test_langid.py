import random
from itertools import product
from zlib import crc32

import numpy as np
import odd
import pytest

from readloom.llm import langid

WORDS = {"xx": "the and of with this that shadow window", "yy": "der und mit diese nicht wasser fenster", "zz": "что это как время окно слово рука", "ww": "και το είναι λόγος παράθυρο"}


def text(rnd, lang, n):
    return " ".join(rnd.choice(WORDS[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    rnd = random.Random(1)
    return [(k, text(rnd, lang := rnd.choice(sorted(WORDS)), rnd.randint(5, 60)), lang if k % 9 else None, "s") for k in range(400)]


def test_held_out_accuracy_and_odd_rows(spark, docs):
    more = [(1000, None, "xx", None), (1001, "", "yy", None), (1002, "12 34 ½ !", "yy", None), (None, text(random.Random(2), "yy", 30), None, None), (1003, "日本語", None, None), (1004, "w" * 300_000, None, None), docs[0], docs[0]]
    got = langid.identify(odd.frame(spark, docs + more)).collect()
    assert len(got) == len(docs + more)
    true = {i: lang for i, _, lang, _ in docs}
    for r in got:
        assert r.held_out == (crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 4 == 2) and 0 <= r.score <= 1
        if r.doc_id in (1000, 1001, 1002):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in WORDS
    right = [r.lang_pred == true[r.doc_id] for r in got if true.get(r.doc_id) and r.held_out]
    assert len(right) > 50 and sum(right) >= 0.97 * len(right)


def test_labels_of_held_out_rows_are_no_input(spark, docs):
    out = lambda i: crc32(str(i).encode()) % 4 == 2
    changed = [(i, t, "zz" if out(i) else lang, s) for i, t, lang, s in docs]
    a, b = (sorted(map(str, langid.identify(odd.frame(spark, d)).collect())) for d in (docs, changed))
    assert a == b


def test_spans_of_mixed_text(spark, docs):
    labeller = langid.Labeller(langid.fit(odd.frame(spark, docs)))
    rnd = random.Random(7)
    one, two, three = text(rnd, "xx", 30), text(rnd, "zz", 20), text(rnd, "yy", 25)
    whole = f"{one} {two}. {three}"
    spans = labeller.spans(whole)
    assert [x[2] for x in spans] == ["xx", "zz", "yy"]
    assert whole[spans[1][0] : spans[1][1]] == two
    assert [x[2] for x in labeller.spans(f"{one} und {one}")] == ["xx"]  # a word does not pay for two switches
    assert labeller.spans(None) == []


def path_score(s, path, penalty):
    return sum(s[t, k] for t, k in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:], strict=False))


def test_viterbi_and_its_shortcut_are_optimal():
    rng = np.random.default_rng(3)
    for n, k in ((1, 3), (2, 2), (5, 3), (7, 2)):
        for scale in (0.5, 2, 8):
            s = rng.normal(0, scale, (n, k))
            best = max(path_score(s, p, langid.PENALTY) for p in product(range(k), repeat=n))
            assert path_score(s, langid.viterbi(s, langid.PENALTY).tolist(), langid.PENALTY) == pytest.approx(best)
            labeller = langid.Labeller(langid.Model([str(i) for i in range(k)], np.zeros((langid.BUCKETS, k)), np.ones((len(langid.SCRIPTS), k), bool)))
            labeller.ids = {str(t): t for t in range(n)}
            labeller.scores[:n] = s
            assert path_score(s, labeller.path([str(t) for t in range(n)])[0].tolist(), langid.PENALTY) == pytest.approx(best)


def test_empty_and_unlabelled(spark):
    assert langid.identify(odd.frame(spark, [])).count() == 0
    got = langid.identify(odd.frame(spark, [(1, "some words", None, None)])).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]


def test_small_cache_gives_the_same(spark, docs, monkeypatch):
    model = langid.fit(odd.frame(spark, docs))
    texts = [t for _, t, _, _ in docs]
    want = langid.Labeller(model).labels(texts)
    monkeypatch.setattr(langid, "CACHE_WORDS", 5)
    small = langid.Labeller(model)
    assert [x for t in texts for x in small.labels([t])] == want


def test_runs_without_blanks_are_judged_to_their_end(spark):
    rnd = random.Random(11)
    han, kana, other = ("".join(map(chr, range(a, a + 40))) for a in (0x4E00, 0x3041, 0x6500))
    run = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    docs = [(k, run([han, kana, other][k % 3], 300), ["zh", "ja", "wu"][k % 3], None) for k in range(90)]
    labeller = langid.Labeller(langid.fit(odd.frame(spark, docs)))
    assert labeller.labels([run(han, 70) + run(kana, 200), run(han, 40) + run(kana, 20)]) == [("ja", 200 / 270), ("zh", 40 / 60)]
    assert labeller.labels([run(han, 64) + run(other, 640)])[0][0] == "wu"
    whole = run(han, 128) + run(kana, 70) + run(other, 100)
    assert [x[2] for x in labeller.spans(whole)][:2] == ["zh", "ja"] and labeller.spans(whole)[1][:2] == (128, 198)
    assert labeller.spans(whole)[-1][1:] == (298, "wu")
    for text in ("straße été", "a" * 65, "日本語テキスト", "x²½y", "\U0001d400bc"):
        assert "".join(langid.cut(langid.WORD.findall(text))) == "".join(langid.WORD.findall(text))


def plain_buckets(word):
    """Of one word, letter by letter in whole numbers, what grams() hashes in bulk."""
    c, one = [ord(x) for x in f"^{word}$"], (1 << 64) - 1
    k1, k2, k3 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
    two = [(a * k1 & one) ^ (b * k2 & one) for a, b in zip(c, c[1:], strict=False)]
    three = [(t * k2 & one) ^ (x * k3 & one) for t, x in zip(two, c[2:], strict=False)]
    spread = [(x + i * k3) * k1 & one for i, x in enumerate(c)]
    whole = sum(x ^ x >> 29 for x in spread) & one
    return [(h * k2 & one) >> 64 - langid.BITS for h in [x * k3 & one for x in c] + [t * k3 & one for t in two] + three + [whole]]


def test_scores_and_predictions_against_brute_force(spark, docs):
    """Counts, probabilities, scripts, scores, the best of all paths and its share of letters, by hand."""
    taught = [(t, lang) for i, t, lang, _ in docs if lang and crc32(str(i).encode()) % 4 != 2]
    languages = sorted({lang for _, lang in taught})
    counts, scripts = ({lang: {} for lang in languages} for _ in range(2))
    for t, lang in taught:
        for w in langid.cut(langid.WORD.findall(t.lower())):
            for b in plain_buckets(w):
                counts[lang][b] = counts[lang].get(b, 0) + 1
            scripts[lang][langid.script(w[0])] = scripts[lang].get(langid.script(w[0]), 0) + len(w)
    total = {lang: sum(counts[lang].values()) + langid.BUCKETS / 2 for lang in languages}
    uses = {lang: {s for s, n in scripts[lang].items() if n >= langid.SCRIPT_SHARE * sum(scripts[lang].values())} for lang in languages}

    def scores(w):
        buckets = plain_buckets(w)
        raw = [langid.WEIGHT * sum(np.log((counts[lang].get(b, 0) + 0.5) / total[lang]) for b in buckets) / len(buckets) for lang in languages]
        fit = [langid.script(w[0]) in uses[lang] for lang in languages]
        top = max((x for x, f in zip(raw, fit, strict=True) if f), default=0)
        return [x - top if f else -1e3 for x, f in zip(raw, fit, strict=True)] if any(fit) else [0.0] * len(languages)

    rnd = random.Random(4)
    texts = [" ".join(text(rnd, rnd.choice(sorted(WORDS)), rnd.randint(1, 3)) for _ in range(2)) for _ in range(40)]
    got = langid.predict(odd.frame(spark, [(k, t, None, None) for k, t in enumerate(texts)]), langid.fit(odd.frame(spark, docs))).orderBy("doc_id").collect()
    for t, r in zip(texts, got, strict=True):
        words = langid.cut(langid.WORD.findall(t.lower()))
        s = np.array([scores(w) for w in words])
        best = max(path_score(s, p, langid.PENALTY) for p in product(range(len(languages)), repeat=len(words)))
        shares = [{lang: sum(len(w) for w, k in zip(words, p, strict=True) if languages[k] == lang) / sum(map(len, words)) for lang in languages} for p in product(range(len(languages)), repeat=len(words)) if path_score(s, p, langid.PENALTY) >= best - 1e-9]
        assert any(x[r.lang_pred] == max(x.values()) == pytest.approx(r.score) for x in shares)
