import random
import re
from collections import Counter, defaultdict

import odd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from readloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeated(words):
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    return len({i + j for v in at.values() if len(v) > 1 for i in v for j in range(8)})


def base(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for x in w for c in x), len(lines) - len(set(lines)), repeated(w))
    return n, n[0] < 20 or 100 * n[4] > 30 * n[0]


def normal(line):
    return " ".join(WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in line)))


def brute(docs, share, least):
    """kept, lines removed, words left of each (host, text); boilerplate lines."""
    hosts = defaultdict(set)
    for _, t, _, s in docs:
        hosts[s or ""].add(t or "")
    bad = {h: {x for x, n in Counter(x for t in texts for x in {normal(y) for y in t.split("\n")} if x).items() if n >= least and n > share * len(texts)} for h, texts in hosts.items()}
    out = {}
    for h, texts in hosts.items():
        for t in texts:
            gone = [x for x in t.split("\n") if normal(x) in bad[h]]
            n = len(WORD.findall(t))
            left = n - sum(len(WORD.findall(x)) for x in gone)
            out[h, t] = not base(t)[1] and not (gone and (left < 10 or left < 0.3 * n)), len(gone), left
    return out, bad


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60))
def test_repeated_windows(words):
    assert quality.repeat_words(words) == repeated(words)


def test_against_brute_force(spark):
    docs = odd.documents()
    for share, least in ((0.1, 3), (0.9, 3), (0.0, 1)):
        want, bad = brute(docs, share, least)
        got = sorted(tuple(r) for r in quality.judge(odd.frame(spark, docs), share, least).collect() if r.doc_id is not None)
        assert got == sorted((i, *base(t)[0], base(t)[1], *want[s or "", t or ""]) for i, t, _, s in docs if i is not None)
        kept = quality.clean(odd.frame(spark, docs), share, least)
        assert kept.columns == odd.frame(spark, docs).columns
        lines = [(i, t, s) for i, t, _, s in docs if want[s or "", t or ""][0]]
        cut = sorted((i if i is not None else -1, "\n".join(x for x in t.split("\n") if normal(x) not in bad[s or ""])) for i, t, s in lines)
        rows = kept.collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in rows) == cut
        assert all(r.n_chars == len(r.text) for r in rows)


def test_boilerplate_is_found_and_copies_count_once(spark):
    rnd = random.Random(4)
    docs = [(k, odd.words(rnd, 60) + "\n" + odd.FOOT, "en", "h") for k in range(40)] + [(100 + k, "the same clean document again and again " + " ".join(map(str, range(30))), "en", "h") for k in range(500)]
    got = {r.doc_id: r for r in quality.judge(odd.frame(spark, docs)).collect()}
    assert all(r.kept for r in got.values())
    assert all(got[k].n_lines_removed == 1 for k in range(40)) and all(got[100 + k].n_lines_removed == 0 for k in range(500))


def test_clean_takes_a_line_of_many_documents_at_any_size_of_host(spark):
    rnd = random.Random(6)
    own = [odd.words(rnd, 40) for _ in range(900)]
    docs = [(k, f"{t}\n{odd.FOOT}" if k < 40 else f"{t}\nrare line" if k < 79 else t, "en", "h") for k, t in enumerate(own)]
    assert {r.doc_id: r.text for r in quality.clean(odd.frame(spark, docs)).collect()} == {k: f"{t}\nrare line" if 40 <= k < 79 else t for k, t in enumerate(own)}


def test_empty_table(spark):
    empty = odd.frame(spark, [])
    assert quality.judge(empty).count() == 0 and quality.clean(empty).count() == 0


@pytest.mark.parametrize("text", ["", "a", "a " * 19, "a " * 20, "a\n" * 20, " ".join("ab" * 30)])
def test_short_texts(text):
    assert quality.measure(text)[0] == base(text)[0]
