"""Language identification: scripts narrow the candidates, per-word scores and a switching penalty label spans.

The model is fitted on the labelled rows that are not held out, at most about SAMPLE_DOCUMENTS of them: log
probabilities, by language, of a word's hashed character n-grams, in a table of BUCKETS rows whatever the data's
size, and the scripts of each language's letters. A word is a run of letters of one script, LONGEST at most: longer
runs, as of text without blanks, are cut, and each piece is a word with scores of its own. A word's script leaves the
languages that use it. Over a text's words the best path is Viterbi's: scores minus PENALTY for each switch. A text
whose every deviation from its best single language gains less than the penalty needs no search: the single language
is then the best path.

A text that is null or without letters is und, score 0. Rows without a label, and held-out rows, teach nothing;
with no labelled row all texts are und. Repeated rows give repeated results; a null id counts as '' in the hold-out.
A very long text is judged to its end. Empty tables give no rows. Columns beside doc_id, text and lang play no part.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: About how many labelled documents the model is fitted on, drawn by a hash of doc_id.
SAMPLE_DOCUMENTS = 20_000
BITS = 15
BUCKETS = 1 << BITS
#: What a switch of language costs, in nats; a word scores the mean of its n-grams' log probabilities, times WEIGHT.
PENALTY = 6.0
WEIGHT = 2.0
#: A language is a candidate for a script that holds this share of its letters.
SCRIPT_SHARE = 0.01
CACHE_WORDS = 300_000
LONGEST = 64
#: Texts whose new words are learned together.
AT_ONCE = 64
WORD = re.compile(r"[^\W\d_]+")

#: Where ranges of code points of a script begin, in order.
SCRIPT_STARTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"),
    (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB13, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x40000, "other"),
]
STARTS = [s for s, _ in SCRIPT_STARTS]
SCRIPTS = sorted({s for _, s in SCRIPT_STARTS})


def script(c: str) -> int:
    return SCRIPTS.index(SCRIPT_STARTS[bisect_right(STARTS, ord(c)) - 1][1])


def _pieces() -> re.Pattern[str]:
    ends = [*STARTS[1:], 0x110000]
    ranges = {name: "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for (a, s), b in zip(SCRIPT_STARTS, ends, strict=True) if s == name) for name in SCRIPTS}
    return re.compile("|".join(f"[{ranges[name]}]{{1,{LONGEST}}}" for name in ["latin", *(x for x in SCRIPTS if x != "latin")]))


#: The longest piece of a run that is of one script.
PIECE = _pieces()


def cut(runs: list[str]) -> list[str]:
    """The words of runs of letters: pieces of one script, of at most LONGEST letters."""
    return [w for r in runs for w in ((r,) if len(r) <= LONGEST and (r.isascii() or PIECE.fullmatch(r)) else PIECE.findall(r))]


def letters(word: str) -> str:
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 1- to 3-grams, with its ends, and of the whole of each lower-case word, and the word's place in the list."""
    text = [f"^{w}$" for w in words]
    c = np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, text), np.int64, len(text))
    begin = np.cumsum(size) - size
    of = np.repeat(np.arange(len(text)), size)
    k1, k2, k3 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
    two = (c[:-1] * k1) ^ (c[1:] * k2)
    three = (two[:-1] * k2) ^ (c[2:] * k3)
    place = (np.arange(len(c)) - np.repeat(begin, size)).astype(np.uint64)
    spread = (c + place * k3) * k1
    whole = np.add.reduceat(spread ^ (spread >> np.uint64(29)), begin)
    in2, in3 = of[:-1] == of[1:], of[:-2] == of[2:]
    h = np.concatenate([c * k3, two[in2] * k3, three[in3], whole]) * k2
    return (h >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate([of, of[:-1][in2], of[:-2][in3], np.arange(len(text))])


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log: np.ndarray  # BUCKETS x languages
    uses: np.ndarray  # scripts x languages, boolean


def held_out(docs: DataFrame) -> DataFrame:
    return docs.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2)


def fit(docs: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> Model:
    """Counts n-grams and scripts by language in the tasks; what comes to the driver is of the model's size, not the data's."""
    rows = held_out(docs.select("doc_id", "text", "lang")).filter("not held_out and lang is not null and text is not null")
    share = min(1.0, sample / max(1, rows.count()))
    rows = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            seen: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                seen.setdefault(lang.as_py(), Counter()).update(cut(WORD.findall(text.as_py().lower())))
            for lang, words in seen.items():
                at = counts.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS), np.int64))
                known = [(w, own, n) for w, n in words.items() if (own := letters(w))]
                if known:
                    where, of = grams([w for w, _, _ in known])
                    at[:BUCKETS] += np.bincount(where, np.array([n for _, _, n in known])[of], BUCKETS).astype(np.int64)
                for _, own, n in known:
                    at[BUCKETS + script(own[0])] += n * len(own)
        for lang, at in counts.items():
            used = np.flatnonzero(at)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(at[used])], names=["lang", "at", "n"])

    counted = rows.select("text", "lang").mapInArrow(run, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(counted.column("lang").to_pylist()))
    at = np.zeros((BUCKETS + len(SCRIPTS), len(languages)))
    if languages:
        at[counted.column("at").to_numpy(), [languages.index(x) for x in counted.column("lang").to_pylist()]] = counted.column("n").to_numpy()
    grams_, scripts = at[:BUCKETS] + 0.5, at[BUCKETS:]
    return Model(languages, np.log(grams_ / grams_.sum(axis=0)), scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1))


class Labeller:
    """Paths over texts, with the scores of words kept."""

    def __init__(self, model: Model):
        self.model, self.ids = model, {}
        self.scores = np.zeros((1024, len(model.languages)))
        self.sizes = np.zeros(1024, np.int64)

    def learn(self, words: list[str]) -> None:
        first, last = len(self.ids), len(self.ids) + len(words)
        if last > len(self.sizes):
            more = max(last, 2 * len(self.sizes)) - len(self.sizes)
            self.scores, self.sizes = np.pad(self.scores, ((0, more), (0, 0))), np.pad(self.sizes, (0, more))
        self.ids.update(zip(words, range(first, last), strict=True))
        own = [letters(w) for w in words]
        where, of = grams(words)
        count = np.bincount(of, minlength=len(words))
        s = np.stack([WEIGHT * np.bincount(of, log[where], len(words)) / count for log in self.model.log.T], axis=1)
        uses = np.array([self.model.uses[script(x[0])] if x else np.zeros(s.shape[1], bool) for x in own])
        s = np.where(uses, s - np.where(uses, s, -np.inf).max(axis=1, initial=-1e9, keepdims=True), -1e3)
        s[~uses.any(axis=1)] = 0.0  # a script of no language tells nothing
        self.scores[first:last], self.sizes[first:last] = s, [len(x) for x in own]

    def prepare(self, texts: list[list[str]]) -> None:
        """Learns the words that these texts need, at once."""
        new = dict.fromkeys(w for words in texts for w in words if w not in self.ids)
        if len(self.ids) + len(new) > CACHE_WORDS:
            self.ids = {}
            new = dict.fromkeys(w for words in texts for w in words)
        if new:
            self.learn(list(new))

    def path(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The language of each word, all prepared, on the best path, and its letters."""
        at = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        s, n = self.scores[at], self.sizes[at]
        best = int(s.sum(axis=0).argmax())
        gain = np.cumsum(s - s[:, best : best + 1], axis=0)
        low = np.minimum.accumulate(np.vstack([np.zeros_like(gain[:1]), gain[:-1]]), axis=0)
        if (gain - low).max() <= PENALTY:  # no stretch of words in another language pays for its switch
            return np.full(len(words), best), n
        return viterbi(s, PENALTY), n

    def split(self, text: str | None) -> list[str]:
        return cut(WORD.findall(text.lower())) if text and self.model.languages else []

    def labels(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language that most letters of a text are in, and their share."""
        each = [self.split(t) for t in texts]
        self.prepare(each)
        return [self.label(words) for words in each]

    def label(self, words: list[str]) -> tuple[str, float]:
        if not words:
            return "und", 0.0
        path, n = self.path(words)
        if not (total := n.sum()):
            return "und", 0.0
        shares = np.bincount(path, n, len(self.model.languages))
        k = int(shares.argmax())
        return self.model.languages[k], float(shares[k] / total)

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """start, end, language of each longest run of words of one language; offsets are of text.lower()."""
        found = [(r.start() + m.start(), m[0]) for r in WORD.finditer(text.lower()) for m in PIECE.finditer(r[0])] if text and self.model.languages else []
        if not found:
            return []
        words = [w for _, w in found]
        self.prepare([words])
        path = self.path(words)[0]
        edges = np.flatnonzero(np.r_[True, path[1:] != path[:-1], True])
        return [(found[a][0], found[b - 1][0] + len(words[b - 1]), self.model.languages[path[a]]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def viterbi(s: np.ndarray, penalty: float) -> np.ndarray:
    """The labels of the path with the highest sum of s less penalty for each switch; ties stay, then go to the lesser label."""
    n, k = s.shape
    came = np.empty((n, k), np.int32)
    now, own = s[0].tolist(), list(range(k))
    rows = s.tolist()
    for t in range(1, n):
        top = max(now)
        via, top = now.index(top), top - penalty
        back = [i if x >= top else via for i, x in enumerate(now)]
        came[t] = back
        now = [(x if x >= top else top) + y for x, y in zip(now, rows[t], strict=True)]
    path = np.empty(n, np.int64)
    path[-1] = own[now.index(max(now))]
    for t in range(n - 1, 0, -1):
        path[t - 1] = came[t, path[t]]
    return path


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row for each row of docs, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        for batch in batches:
            texts = batch.column(2)
            got = [g for at in range(0, len(texts), AT_ONCE) for g in labeller.labels(texts[at : at + AT_ONCE].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return held_out(docs.select(F.col("doc_id").cast("long"), "text")).select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> DataFrame:
    return predict(docs, fit(docs, sample))
