"""BPE encoding and decoding with a public vocabulary, by dynamic programming over prefixes.

For each prefix of a word at most one token can come last in the word's encoding. An automaton over all
tokens finds those that end at a position; the one is kept whose pair with the last token of the prefix before
it stands, that is, no merge across their border comes before the merges that built the two. Back-pointers
from the end of the word then give the ids. Time is linear in the word's length times the matches at a position,
so one word of a million letters is no special case.

Nulls are empty texts: no ids, an empty decoding. Repeated rows give repeated results; a null doc_id stays null. Empty
tables give no rows; columns that are not carried play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Words whose encoding a Python worker keeps, twice: when they are more, those before the last so many go.
CACHE_WORDS = 150_000

#: Stands for no token, and is the mask of a token in a key of two.
NONE = (1 << 17) - 1
PRINTED = re.compile("[!-~]+")

#: Without one of these, a text is of composed Latin letters, ASCII and white space: normalising is lower-casing.
ODD = re.compile("[^\t-\r\x20-\x7e\xa1-\u012f\u0131-\u024f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A BPE with word ends, lower-casing and NFC, read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["decoder"] is not None or not model["end_of_word_suffix"]:
            raise ValueError("needs a BPE vocabulary with a word end and no decoder")
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.path, self.library = path, None
        self.symbols = byte_symbols()
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        born: dict[int, int] = {}
        for r, (a, b) in enumerate(model["merges"]):
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            if z in self.parts or max(born.get(x, -1), born.get(y, -1)) >= r:
                raise ValueError("merges are not in the order of training")
            self.rank[x, y], self.parts[z], born[z] = r, (x, y), r
        self.automaton = ahocorasick.Automaton()
        self.left = lru_cache(maxsize=None)(lambda t: self.spine(t, 0))
        self.right = lru_cache(maxsize=None)(lambda t: self.spine(t, 1))
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        for t, i in self.vocab.items():
            if self.reached(i):  # the others are never in an encoding
                s = self.closed(t)
                self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()
        self.decimal = {i: str(i) for i in self.tokens}
        self.words: dict[str, tuple[int, str, str]] = {}
        self.before: dict[str, tuple[int, str, str]] = {}  # the words of the last full cache

    def closed(self, token: str) -> str:
        """A token with its word end folded into its last character, so that every symbol is one character."""
        return token[: -len(self.end) - 1] + chr(0xE000 + ord(token[-len(self.end) - 1])) if token.endswith(self.end) and token != self.end else token

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens at one edge of a token as its merges are undone, each with the rank of the merge that uses it up."""
        found, until = [(token, float("inf"))], None
        while parts := self.parts.get(token):
            until, token = self.rank[parts], parts[side]
            found.append((token, until))
        return found

    def crossed(self, a: int, b: int, but: tuple[int, int] | None = None) -> bool:
        """Whether some merge across the border of a and b comes before those that build them. Of equal ranks the left one comes first."""
        for x, x_until in self.right(a):
            for y, y_until in self.left(b):
                r = self.rank.get((x, y))
                if r is not None and r < x_until and r <= y_until and (x, y) != but:
                    return True
        return False

    def stands(self, key: int) -> bool:
        """Whether the tokens a, b of the key a << 17 | b may stand side by side; a is NONE at a word's start."""
        if len(self.pairs) > 300_000:
            self.pairs.clear()
        got = self.pairs[key] = key >> 17 == NONE or not self.crossed(key >> 17, key & NONE)
        return got

    def reached(self, token: int) -> bool:
        """Whether a token's own characters are encoded as that token."""
        if (known := self.alone.get(token)) is None:
            p = self.parts.get(token)
            known = self.alone[token] = p is None or self.reached(p[0]) and self.reached(p[1]) and not self.crossed(*p, but=p)
        return known

    def encode_word(self, word: str) -> list[int]:
        s = word if PRINTED.fullmatch(word) else "".join([self.symbols[b] for b in word.encode()])
        s = s[:-1] + chr(0xE000 + ord(s[-1]))
        pairs = self.pairs
        last: list[int | None] = [NONE] + [None] * len(s)
        size = [0] * (len(s) + 1)
        for end, (token, n) in self.automaton.iter(s):
            end += 1
            if last[end] is None and (a := last[end - n]) is not None:
                key = a << 17 | token
                ok = pairs.get(key)
                if self.stands(key) if ok is None else ok:
                    last[end], size[end] = token, n
        ids, at = [], len(s)
        while at:
            if last[at] is None:
                raise ValueError(f"no encoding of {word!r}")
            ids.append(last[at])
            at -= size[at]
        return ids[::-1]

    def chunks(self, text: str) -> list[str]:
        """The normalised text, split at white space; no word of the splitter's crosses it."""
        if not ODD.search(text):
            return text.lower().split()
        return self.tokenizer().normalizer.normalize_str(text).split(" ")

    def pieces(self, chunk: str) -> list[str]:
        if not ODD.search(chunk):
            return self.split.findall(chunk)
        back = {c: b for b, c in enumerate(self.symbols)}
        return [bytes(back[c] for c in w).decode() for w, _ in self.tokenizer().pre_tokenizer.pre_tokenize_str(chunk)]

    def tokenizer(self):
        """The library's normaliser and splitter, for characters whose classes depend on its tables."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return self.library

    def known(self, chunk: str) -> tuple[int, str, str]:
        """How many ids a chunk has, these in decimal, and its decoding, each joined by spaces."""
        if got := self.before.get(chunk):
            pass
        elif len(pieces := self.pieces(chunk)) == 1:
            ids = self.encode_word(pieces[0])
            got = len(ids), " ".join([self.decimal[i] for i in ids]), self.decode(ids)
        else:
            each = [self.words.get(w) or self.known(w) for w in pieces]
            got = sum(x[0] for x in each), " ".join([x[1] for x in each]), " ".join([x[2] for x in each])
            if len(pieces) > 2:
                return got
        if len(chunk) <= 100:
            if len(self.words) >= CACHE_WORDS:
                self.before, self.words = self.words, {}
            self.words[chunk] = got
        return got

    def coded(self, text: str | None) -> list[tuple[int, str, str]]:
        """known() of each chunk that has ids."""
        if not text:
            return []
        out: list[tuple[int, str, str]] = []
        cache = self.words
        for part in self.cut.split(text) if self.cut and self.cut.search(text) else [text]:
            if part in self.special:
                i = self.special[part]
                out.append((1, str(i), part))
            elif part:
                out += [cache.get(w) or self.known(w) for w in self.chunks(part) if w]
        return out

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for n, ids, _ in self.coded(text) if n for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file, tokens are joined by a space."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])


@lru_cache(maxsize=2)
def model(path: str) -> WordBpe:
    return WordBpe(path)


def encode_documents(docs: DataFrame, path: str, *, with_ids: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids array<int>, then the carried columns of longs: one row for each row of docs, without a shuffle."""
    kept = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())] + [pa.field("ids", pa.list_(pa.int32()))] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            n, ids, plain, lists = [], [], [], []
            for text in batch.column(1):
                got = bpe.coded(text.as_py())
                joined = " ".join([x[1] for x in got])
                n.append(sum([x[0] for x in got]))
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                plain.append(hashlib.sha256(" ".join([x[2] for x in got]).encode()).hexdigest())
                if with_ids:
                    lists.append([int(i) for i in joined.split(" ")] if joined else [])
            cols = [batch.column(0), *map(pa.array, (n, ids, plain), (f.type for f in kept[:3]))]
            cols += [pa.array(lists, kept[3].type)] if with_ids else []
            yield pa.RecordBatch.from_arrays(cols + batch.columns[2:], names=["doc_id", *(f.name for f in kept), *carried])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + "".join(f", {c} long" for c in carried)
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text", *carried), run, schema)
