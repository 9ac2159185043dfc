import random
import re

import odd

from readloom.llm import licenses

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PIECES = ["MIT License", "mit-license", "mit  license mit license", "Licensed under the Apache License, Version 2.0.", "GNU General Public License", "gnu general public", "CC BY", "CC-BY-NC 4.0", "Licensed under CC BY-SA 4.0", "SPDX-License-Identifier: GPL-3.0-or-later", "admit license", "mit licenses", "émit license", "all rights reserved", "foo bar", "cc", "by", "cc by cc by", "GPL v2 with the Classpath Exception", "this is not licensed under the GNU General Public License", "Dual licensed under the MIT and GPL licenses.", "licensed under MIT or Apache-2.0", "Permission is hereby granted, free of charge, to any person obtaining a copy"]


def words(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def base(text):
    w, hits = words(text), []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        hits += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    starts = [i for i, _ in hits]
    return len(w), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


def detections(text):
    p = " " + " ".join(words(text)) + " "
    out = []
    for k, r in enumerate(licenses.RULES):
        out += [(p[: m.start()].count(" ") - 1, p[: m.end()].count(" "), r.priority, k, r.label) for m in re.finditer(rf"(?<= )(?:{r.pattern})(?= )", p)]
    return out


def labels(text):
    found = detections(text)
    ranks = lambda d: (-d[2], d[0] - d[1], d[3])
    stay = [d for d in found if not any(e is not d and e[0] <= d[0] and e[1] >= d[1] and ranks(e) < ranks(d) for e in found)]
    kept = stay + [d for d in found if d[3] < len(licenses.BASE)]
    return ",".join(sorted({d[4] for d in kept})), max((d[2] for d in kept), default=0) / licenses.TOP


def test_against_brute_force(spark):
    rnd = random.Random(3)
    docs = odd.documents() + [(500 + k, rnd.choice([" ", "\n", ", "]).join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 9))), None, None) for k in range(120)] + [(900, "MIT License " * 3000, None, None)]
    small = [d for d in docs if len(d[1] or "") < 20_000]
    got = sorted(tuple(-1 if x is None else x for x in r) for r in licenses.scan(odd.frame(spark, small)).collect())
    want = sorted(tuple(-1 if x is None else x for x in (i, *base(t)[:4], base(t)[4], *labels(t))) for i, t, _, _ in small)
    assert got == want
    long = {r.doc_id: r for r in licenses.scan(odd.frame(spark, [d for d in docs if len(d[1] or "") >= 20_000])).collect()}
    assert (long[900].n_base, long[900].first_word, long[900].last_word, long[900].labels) == (3000, 0, 5998, "mit")


def test_rules_have_their_keywords():
    assert len(licenses.RULES) > 300
    for r in licenses.RULES:
        assert r.keyword and re.compile(r.pattern)
    assert [r.label for r in licenses.RULES[:4]] == ["gpl", "apache", "cc-by", "mit"]


def test_written_rules_have_their_keywords_and_denials_outrank_names(spark):
    for label, pattern, keyword, priority in licenses.WRITTEN:
        assert f" {keyword}" in f" {licenses.literal(pattern)}" or re.search(re.escape(keyword), re.sub(r"\(\?:|\)\??|\?", "", pattern)), pattern
        assert 1 <= priority <= licenses.TOP
    texts = ["This is not licensed under the GNU General Public License.", "GPL with the Classpath Exception", "released under the same terms as Perl itself"]
    got = {r.doc_id: r.labels for r in licenses.scan(odd.frame(spark, [(k, t, None, None) for k, t in enumerate(texts)])).collect()}
    assert got == {0: "gpl,no-license", 1: "gpl-with-classpath-exception", 2: "gpl-or-artistic"}  # the contract's gpl stays


def test_no_python_and_one_narrow_shuffle(spark):
    plan = licenses.scan(odd.frame(spark, []))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1


def test_empty_table(spark):
    assert licenses.scan(odd.frame(spark, [])).count() == 0
