import random
import re

import odd
import xxhash

from readloom.llm import linededup

SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = linededup.LAST


def normal(text):
    return " ".join(WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text)))


def brute_pieces(text):
    """start and normalised text of each piece, by looking at every run of white space."""
    out, start, k = [], 0, 0
    while k <= len(text):
        if k == len(text) or text[k] in SPACE:
            end = k
            while end < len(text) and text[end] in SPACE:
                end += 1
            word = re.search(r"[^\x20\x09-\x0D]*$", text[:k])[0]
            if k == len(text) or "\n" in text[k:end] or word[-1:] in (".", "!", "?") or len(word) >= linededup.LONG_WORD:
                if n := normal(text[start:end]):
                    out.append((start, n))
                start = end
            k = max(end, k + 1)
        else:
            k += 1
    return out


def name_of(text):
    if text is None:
        return 42
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def brute(docs, least):
    """For each document the pieces of all repeated runs of least characters, not just of shortest ones, less what overlaps a run that stays."""
    places, starts = {}, {}
    for i, t, _, _ in docs:
        doc = (LAST if i is None else i, name_of(t))
        if doc in starts:
            continue
        found = brute_pieces(t or "")
        starts[doc] = [a for a, _ in found] + [len(t or "")]
        for a in range(len(found)):
            size = -1
            for b in range(a, len(found)):
                size += len(found[b][1]) + 1
                if size >= least:
                    places.setdefault(tuple(n for _, n in found[a : b + 1]), []).append((doc, a, b + 1))
                if size >= 4 * least:
                    break
    gone = {doc: set() for doc in starts}
    for at in places.values():
        doc0, a0, b0 = min(at)
        for doc, a, b in at:
            if (doc, a) != (doc0, a0):
                gone[doc] |= set(range(max(a, b0) if doc == doc0 else a, b))
    out = {}
    for doc, pieces in gone.items():
        spans = []
        for k in sorted(pieces):
            a, b = starts[doc][k], starts[doc][k + 1]
            if spans and spans[-1][1] == a:
                spans[-1] = (spans[-1][0], b)
            else:
                spans.append((a, b))
        out[doc] = spans
    return out


def test_against_brute_force(spark):
    rnd = random.Random(2)
    lines = [odd.words(rnd, 3 + k % 15) + rnd.choice([".", "", "!", " aVeryLongWordWithoutAnEnd"]) for k in range(40)]
    docs = [d for d in odd.documents() if len(d[1] or "") < 100_000]
    docs += [(500 + k, "".join((rnd.choice(lines).upper() if rnd.random() < 0.2 else rnd.choice(lines)) + rnd.choice(["\n", " ", "\r\n\n", "  "]) for _ in range(rnd.randint(1, 25))), None, None) for k in range(80)]
    docs += [(600, "again and again. " * 30, None, None), (601, "x " + "again and again. " * 40, None, None), (700, docs[-1][1], None, None), (700, docs[-2][1], None, None)]
    for least in (20, 120):
        got = {(r.rank, r.name): [(x.start, x.end) for x in r.removed] for r in linededup.repeats(odd.frame(spark, docs), least).collect()}
        want = brute(docs, least)
        assert got == {doc: spans for doc, spans in want.items() if spans} and len(got) > 40


def test_passages_in_lines_and_short_lines_go_and_one_copy_stays(spark):
    rnd = random.Random(5)
    sentences = [odd.words(rnd, 8).capitalize() + "." for _ in range(9)]
    own = [odd.words(rnd, 30) + "." for _ in range(40)]
    docs = []
    for k in range(40):
        passage = ["\n".join(sentences), " ".join(sentences), "  ".join(s.upper() for s in sentences)][k % 3]
        docs.append((k, f"{own[k]} {passage}\nend of {k}" if k % 2 else f"{own[k]}\n{passage}\nend of {k}", None, None))
    out = {r.doc_id: r for r in linededup.remove(odd.frame(spark, docs)).collect()}
    assert out[0].text == docs[0][1]
    for k in range(1, 40):
        (span,) = out[k].removed
        assert normal(docs[k][1][span.start : span.end]) == normal(" ".join(sentences)) and span.kept_doc == 0
        assert normal(out[k].text) == normal(f"{own[k]} end of {k}")


def test_recall_of_planted_passages_and_clean_documents_kept(spark):
    """Passages of over 50 words within lines, cut off in mid-sentence at both ends; other documents share only short things."""
    rnd = random.Random(11)
    prose = lambda n: " ".join(w.capitalize() + "." if rnd.random() < 0.1 else w for w in odd.words(rnd, n, "abcdefghijklmn").split())
    passages = [prose(rnd.randint(52, 120)) for _ in range(20)]
    short = [prose(6) for _ in range(10)]
    docs = [(k, f"{prose(40)} {passages[k % 20]} {prose(30)}\n{prose(20)}", None, None) for k in range(200)]
    docs += [(1000 + k, "\n".join([prose(50), rnd.choice(short), prose(80), rnd.choice(short)]), None, None) for k in range(200)]
    gone = {r.doc_id for r in linededup.report(odd.frame(spark, docs)).filter("n_removed > 0").collect()}
    assert sum(k in gone for k in range(20, 200)) >= 0.9 * 180
    assert not any(k in gone for k in range(20)) and not any(k >= 1000 for k in gone)


def test_odd_rows_and_clashing_columns(spark):
    docs = odd.documents()
    frame = odd.frame(spark, docs).withColumnsRenamed({"digest": "rank", "blob": "__rank", "node": "name", "slot": "start"})
    out = linededup.remove(frame)
    assert sorted(out.columns) == sorted(frame.columns) and out.count() == len(docs)
    got = linededup.report(frame).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_removed, r.text))
    assert by[302] == [(0, None)] and by[300] == [(0, "")] and by[301] == [(0, " \n\t\n")] and sorted(t is None for _, t in by[None]) == [False, True]
    assert len(set(by[4])) == 1 and len(by[4]) == 3 and all(t == "" for k in range(200, 205) for _, t in by[k])
    assert by[305][0] == (0, docs[-3][1]) and by[306][0][1] == "x" * 200_000


def test_empty_table(spark):
    assert linededup.report(odd.frame(spark, [])).count() == 0 and linededup.remove(odd.frame(spark, [])).count() == 0
