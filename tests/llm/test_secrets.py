import hashlib
import random
import re

import odd

from readloom.llm import secrets

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))


PIECES = ["token = \"" + "ab12" * 10 + "\"", "password:short", "PassWord = 'longenough'", "api_key=abcdefgh", "apikey : x", "AKIA" + "B" * 12, "AKIA1234", "AKIAAKIA" + "Z9" * 6, "0123456789abcdef" * 2, "deadbeef" * 3, "ghp_" + "a" * 36, "ſecret=abcdefghij", "passwd" + "=" * 9, "secret: token=abcdefgh", "https://u:passw0rd@host/x", "eyJabcdefgh.eyJabcdefgh.abcdefgh", "-----BEGIN RSA PRIVATE KEY-----\nAAAA\n-----END RSA PRIVATE KEY-----", "\U0001f600", "plain words"]


def corpus():
    rnd = random.Random(2)
    docs = odd.documents() + [(500 + k, rnd.choice([" ", "\n", ""]).join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 8))), "en", "hot") for k in range(80)]
    return docs + [(700, docs[-1][1], None, None), (701, "a" * 100_000, None, None)]


def test_base_spans_against_brute_force(spark):
    docs = corpus()
    key = lambda i: -1 if i is None else i
    want = sorted((key(i), *(sum(x[0] == k for x in brute(t)) for k in ("assign", "access", "hex")), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute(t)).encode()).hexdigest()) for i, t, _, _ in docs)
    found = secrets.digests(secrets.find_secrets(odd.frame(spark, docs))).collect()
    assert sorted((key(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in found) == want
    for i, t, _, _ in docs:
        base = {f"{k}:{a}:{b}" for k, a, b in brute(t)}
        assert all(base <= set(r.spans.split(",")) | ({""} if not base else set()) for r in found if r.doc_id == i and r.doc_id is not None and not (i == 4))


def test_each_added_kind():
    find = secrets.finder(secrets.RULES)
    kinds = {x[0] for p in PIECES for x in find(p)}
    assert {"forge", "login", "jwt", "pem"} <= kinds
    assert find("plain words and a number 123456") == []


def test_ledger_scans_only_what_it_lacks(spark, tmp_path):
    ledger = secrets.Ledger(spark, f"file://{tmp_path}/ledger")
    docs = corpus()
    texts = {t or "" for _, t, _, _ in docs}
    assert ledger.update(odd.frame(spark, docs[:50])) == len({t or "" for _, t, _, _ in docs[:50]})
    assert ledger.update(odd.frame(spark, docs)) == len(texts) - len({t or "" for _, t, _, _ in docs[:50]})
    assert ledger.update(odd.frame(spark, docs)) == 0
    fewer = secrets.RULES[:3]
    assert ledger.update(odd.frame(spark, docs), fewer) == len(texts)
    one, two = (sorted(map(str, secrets.find_secrets(odd.frame(spark, docs), ledger=x).collect())) for x in (ledger, None))
    assert one == two


def test_the_second_run_of_the_query_scans_nothing(spark, tmp_path, monkeypatch):
    from readloom.llm import queries

    monkeypatch.setattr(secrets, "LEDGER", f"ledger-{random.getrandbits(64)}")
    scanned, scan = [], secrets.scan
    monkeypatch.setattr(secrets, "scan", lambda blobs, rules: scanned.append(blobs.count()) or scan(blobs, rules))
    docs = corpus()
    odd.frame(spark, docs[:-20]).write.parquet(f"{tmp_path}/one/documents.parquet")
    odd.frame(spark, docs).write.parquet(f"{tmp_path}/two/documents.parquet")
    first, again, more = (sorted(map(str, queries.op5_secret_scans(spark, f"{tmp_path}/{at}").collect())) for at in ("one", "one", "two"))
    texts = [{t or "" for _, t, _, _ in d} for d in (docs[:-20], docs)]
    assert first == again and scanned == [len(texts[0]), 0, len(texts[1] - texts[0])]
    fresh = secrets.find_secrets(odd.frame(spark, docs), ledger=secrets.Ledger(spark, f"file://{tmp_path}/fresh"))
    assert more == sorted(map(str, secrets.digests(fresh).collect()))


def test_long_passwords_in_urls():
    find = secrets.finder(secrets.RULES)
    for n in (3, 64, 65, 5000):
        text = f"see mongodb+srv://{'u' * n}:{'p' * n}@host/x"
        assert [text[c:d] for kind, _, _, c, d in find(text) if kind == "login"] == ["p" * n]
    assert not find("a." * 100_000 + "://" + "z" * 100_000)


def test_redaction(spark):
    docs = corpus()
    before = odd.frame(spark, docs).withColumnsRenamed({"node": "__blob", "slot": "__spans", "digest": "__new"})
    after = secrets.redact(before)
    assert after.columns == before.columns and after.count() == before.count()
    find = secrets.finder(secrets.RULES)
    for r in after.collect():
        assert r.text is None or (r.n_chars == len(r.text) and not [x for x in find(r.text) if "[" not in r.text[x[3] - 1 : x[4] + 1]])
    clean = {i: t for i, t, _, _ in docs if i is not None and not find(t or "")}
    assert all(r.text == clean[r.doc_id] for r in after.collect() if r.doc_id in clean)


def test_empty_table(spark):
    assert secrets.digests(secrets.find_secrets(odd.frame(spark, []))).count() == 0 and secrets.redact(odd.frame(spark, [])).count() == 0
