import hashlib
import random

import odd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from readloom.llm import bpe
from readloom.llm.queries import vocabulary

TEXTS = ["", " ", "It's 'S we'LL I'D they'Re", "ÀÉé İstanbul ΣΑΣ Σ ǅ ﬁ ſ K Å", "<|endoftext|>a<|startoftext|> <|EndOfText|>", "\x85a\xa0b c\x1cd\x00e﻿", "日本語テキスト \U0001f600\U0001f468‍\U0001f469 ªº ²³ ½ ٣", "a" * 2000, "ha" * 500, "é ́ ä", "!!!!????....''''''", "1234567890", "x\n\ny\tz\r\n"]


@pytest.fixture(scope="module")
def own():
    return bpe.model(vocabulary())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


def same(own, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", TEXTS)
def test_odd_texts(own, library, text):
    same(own, library, text)


@settings(max_examples=400, deadline=None)
@given(st.text())
def test_any_text(text):
    same(bpe.model(vocabulary()), Tokenizer.from_file(vocabulary()) if not hasattr(test_any_text, "t") else test_any_text.t, text)


test_any_text.t = Tokenizer.from_file(vocabulary())


def test_random_words(own, library):
    rnd = random.Random(1)
    for alphabet in ("ab", "aab", "etaoinshr", "thein'.,!"):
        for _ in range(1500):
            same(own, library, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 24))))


def test_small_cache_gives_the_same(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    for text in ["one two three four, five. one two", *TEXTS]:
        same(own, library, text)


def test_documents(spark, library):
    docs = odd.documents() + [(800 + k, t, None, None) for k, t in enumerate(TEXTS)]
    key = lambda i: -1 if i is None else i
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t, _, _ in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((key(i), len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)), ids))
    got = bpe.encode_documents(odd.frame(spark, docs), vocabulary(), with_ids=True).collect()
    assert sorted((key(r.doc_id), *tuple(r)[1:]) for r in got) == sorted(want)
    assert bpe.encode_documents(odd.frame(spark, []), vocabulary()).count() == 0
