"""Toxicity by noisy-channel deobfuscation.

A token that may be disguised (look-alike digits and signs, separators between letters, letters drawn out or
spaced apart) becomes a lattice: each character offers the letters it may stand for, separators may vanish,
runs may shrink, and between spaced letters a word may end. A Viterbi pass under a character trigram model picks the likeliest reading. The
model counts the words of the whole corpus; its alphabet is fixed (at most 60 symbols), so its table is
bounded while its counts are not.

Restored words are scored by a lexicon learned from a bounded sample: up to `per_class` labelled
rows of each label, the first in the order of a hash of the id, and no more than `sample_bytes` of text; near copies among them count once.
An entry is a word, or a word beginning with how many different words of a text have it (1 to 4): where words are built from
parts, one with a beginning means little and several much. Entries are proposed by one half of the sample and kept
if they hold on the other. Of these the lexicon takes, greedily, those that explain most toxic rows less the rows that
they'd accuse wrongly, until each row is explained COVER times. A text's score combines what its entries are
worth (noisy or), starting from the rate among texts without any.

Cases: null and empty texts score the rate of texts without lexicon words; null labels don't count, and
an id labelled twice counts with its higher label; without toxic labels all scores are 0, without other
labels 1, without any 0; repeated rows are scored alike; very long texts and tokens are read whole; an empty
table gives no rows.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import log
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, worker_model
from .compression_quality import labelled_sample

LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
#: The letters that a character may stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "*": "aeiou"}
SUBSTITUTED, VANISHED, SEPARATED, SHRUNK, BROKEN = -1.0, -9.0, -0.5, -0.5, -1.0
PLAIN = re.compile(r"[^\w@$]*([^\W\d_]+)(?:['’][^\W\d_]+)?\W*")
DRAWN_OUT = re.compile(r"([^\W\d_])\1\1")
WORDS = re.compile(r"[^\W\d_]+")
ONE = r"[^\w\s]{0,3}\S[^\w\s]{0,3}"
SPACED = re.compile(rf"(?<!\S)(?:{ONE}[ \t]+){{2,}}{ONE}(?!\S)")
MAX_MEMO = 400_000
#: Entries that explain a toxic row before it counts as explained; the most words with a beginning that are told apart.
COVER, MOST = 3, 4


class CharacterModel:
    """Interpolated trigrams; ^ begins and ends a word, ? is any other letter."""

    def __init__(self, trigrams: dict[str, int]) -> None:
        self.three, self.two, self.one = trigrams, Counter(), Counter()
        for t, n in trigrams.items():
            self.two[t[1:]] += n
            self.one[t[2]] += n
        self.before = Counter()
        self.before1 = Counter()
        for t, n in trigrams.items():
            self.before[t[:2]] += n
            self.before1[t[1]] += n
        self.total = sum(self.one.values())
        self.memo: dict[str, float] = {}

    def score(self, before: str, ch: str) -> float:
        key = before + (ch if ch in LETTERS or ch == "^" else "?")
        s = self.memo.get(key)
        if s is None:
            p = (self.one[key[2]] + 1) / (self.total + len(LETTERS) + 2)
            p = (self.two[key[1:]] + 5 * p) / (self.before1[key[1]] + 5)
            p = (self.three.get(key, 0) + 5 * p) / (self.before[key[:2]] + 5)
            s = self.memo[key] = log(p)
        return s


def word_trigrams(word: str) -> Iterator[str]:
    w = "^^" + "".join(c if c in LETTERS else "?" for c in word) + "^"
    return (w[i : i + 3] for i in range(len(w) - 2))


def corpus_trigrams(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """Counts over the words of all texts; each task sends one row a trigram."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: Counter = Counter()

        def settle(words: Counter) -> None:
            for w, n in words.items():
                if m := PLAIN.fullmatch(w):
                    for t in word_trigrams(m[1]):
                        out[t] += n

        words: Counter = Counter()
        for b in batches:
            for x in b.column(0):
                words.update((x.as_py() or "").lower().split())
                if len(words) > MAX_MEMO:
                    settle(words)
                    words = Counter()
        settle(words)
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], ["t", "n"])

    rows = docs.select(text_col).mapInArrow(counted, "t string, n long").groupBy("t").agg(F.sum("n").alias("n"))
    return {r["t"]: r["n"] for r in rows.collect()}  # at most 60 ** 3 rows


class Restorer:
    def __init__(self, model: CharacterModel) -> None:
        self.model = model

    def options(self, token: str, inner: bool = False) -> list[list[tuple[str, float]]]:
        """The lattice: for each run of one character, (reading, cost)."""
        runs = [m[0] for m in re.finditer(r"(.)\1*", token, re.S)]
        out = []
        for i, run in enumerate(runs):
            c, n, edge = run[0], len(run), i in (0, len(runs) - 1) and not (inner and len(runs) == 1)
            if c.isalpha():
                out.append([(run, 0.0)] if n == 1 else [(c, SHRUNK * (n == 2) * 4), (2 * c, 0.0)])
            elif c in LOOKALIKES:
                out.append([(k * x, SUBSTITUTED + SHRUNK * (n - k > 0)) for x in LOOKALIKES[c] for k in range(1, min(n, 2) + 1)] + [("", VANISHED if c.isdigit() or not edge else SEPARATED)])
            else:
                out.append([("", SEPARATED)])
        return out

    def decode(self, *tokens: str) -> str:
        """The likeliest reading; states are the last two letters. Between tokens a word may end, which reads as a space."""
        score = self.model.score
        states: dict[str, tuple[float, tuple]] = {"^^": (0.0, ())}
        for k, token in enumerate(tokens):
            if k and (ends := [(s + score(at, "^") + BROKEN, (p, " ")) for at, (s, p) in states.items() if at != "^^"]):
                states["^^"] = max([*ends, *([states["^^"]] if "^^" in states else [])])
            for choices in self.options(token, 0 < k < len(tokens) - 1):
                new: dict[str, tuple[float, tuple]] = {}
                for before, (s, path) in states.items():
                    for reading, cost in choices:
                        t, at = s + cost, before
                        for ch in reading:
                            t += score(at, ch)
                            at = at[1] + (ch if ch in LETTERS else "?")
                        if at not in new or t > new[at][0]:
                            new[at] = (t, (path, reading) if reading else path)
                states = new
        _, path = max((s + score(at, "^"), p) for at, (s, p) in states.items())
        parts = []
        while path:
            path, reading = path
            parts.append(reading)
        return "".join(reversed(parts))

    def words(self, token: str) -> list[str]:
        """Restored words of a lower-case token without white space."""
        m = PLAIN.fullmatch(token)
        if m and not DRAWN_OUT.search(token):
            return [m[1]]
        parts = WORDS.findall(token)
        if sum(map(len, parts)) < 2 and not any(c in LOOKALIKES for c in token[1:-1]):
            return parts
        plain = [p for p in parts if len(p) > 1] if not DRAWN_OUT.search(token) else []
        return [*plain, self.decode(token)]

    def spaced(self, text: str) -> Iterator[str]:
        for m in SPACED.finditer(text):
            yield from self.decode(*m[0].split()).split()


def beginnings(word: str) -> list[str]:
    return [word[:k] for k in range(4, min(len(word), 8))]


def row_features(words: set[str]) -> set:
    """The words, and (beginning, n) for each of 1 to MOST different words with it."""
    counts = Counter(b for w in words for b in beginnings(w))
    return words | {(b, m) for b, n in counts.items() for m in range(1, min(n, MOST) + 1)}


class Model:
    def __init__(self, trigrams: dict[str, int], sample: list[tuple[str, int]], shares: dict[int, int], least: int = 3) -> None:
        self.key, self.trigrams, self.lexicon = uuid.uuid4().hex, trigrams, {}
        self.constant = 1.0 if shares.get(1) and not shares.get(0) else 0.0 if not shares.get(1) else None
        if self.constant is not None:
            return
        restorer = Restorer(CharacterModel(trigrams))
        memo: dict[str, list[str]] = {}
        rows: tuple[dict, dict] = defaultdict(list), defaultdict(list)  # those of each half that have a feature
        toxic: list[int] = []
        seen: set[tuple] = set()
        for text, y in sample:
            found, t = set(), text.lower()
            for token in set(t.split()):
                if token not in memo:
                    memo[token] = restorer.words(token)
                found.update(memo[token])
            found.update(restorer.spaced(t))
            sketch = (y, *(min((crc32(f.encode(), k) for f in found), default=0) for k in (1, 2)))
            if sketch in seen:
                continue
            seen.add(sketch)
            for f in row_features(found):
                rows[len(toxic) % 2][f].append(len(toxic))
            toxic.append(y)
        n1, n0 = sum(toxic), len(toxic) - sum(toxic)
        weigh = (shares[0] / max(n0, 1)) / (shares[1] / max(n1, 1))  # of a row that isn't toxic
        count = lambda at: (good := sum(toxic[i] for i in at), weigh * (len(at) - good))
        kept = {}
        for f, at in rows[0].items():
            if len(at) >= least:
                good, bad = count(at)
                other = rows[1].get(f, [])
                good2, bad2 = count(other)
                if good >= least and good >= 0.8 * (good + bad) and good2 >= 2 and good2 >= 0.7 * (good2 + bad2):
                    kept[f] = (good + good2, bad + bad2, {i for i in at + other if toxic[i]})
        left = dict.fromkeys((i for i, y in enumerate(toxic) if y), COVER)
        unexplained = set(left)
        while kept:
            gain, _, f = max((sum(i in left for i in at) - bad, str(f), f) for f, (_, bad, at) in kept.items())
            if gain < least:
                break
            good, bad, at = kept.pop(f)
            self.lexicon[f] = (good + 1) / (good + bad + 2)
            unexplained -= at
            for i in at & left.keys():
                left[i] -= 1
                if not left[i]:
                    del left[i]
        clean = shares[0] / shares[1] * n1
        self.rate = (len(unexplained) + 0.5) / (len(unexplained) + clean + 1)

    def scorer(self) -> Scorer:
        return worker_model(self.key, lambda: Scorer(self))


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model, self.restorer, self.memo = model, Restorer(CharacterModel(model.trigrams)), {}
        whole = [f for f in model.lexicon if isinstance(f, str)]
        self.known = {re.sub(r"(.)\1", r"\1", f): f for f in whole} | {f: f for f in whole}  # a doubled letter may be read once
        self.begins = {f[0] for f in model.lexicon if isinstance(f, tuple)}

    def telling(self, words: list[str]) -> tuple[str, ...]:
        """The words that the lexicon may know."""
        return tuple(self.known.get(w, w) for w in words if w in self.known or any(b in self.begins for b in beginnings(w)))

    def score(self, text: str) -> float:
        m = self.model
        if m.constant is not None:
            return m.constant
        found: set[str] = set()
        t, memo = text.lower(), self.memo
        for token in set(t.split()):
            e = memo.get(token)
            if e is None:
                if len(memo) > MAX_MEMO:
                    memo.clear()
                e = memo[token] = self.telling(self.restorer.words(token))
            if e:
                found.update(e)
        found.update(self.telling(list(self.restorer.spaced(t))))
        miss = 1 - m.rate
        for value in sorted(m.lexicon[f] for f in row_features(found) if f in m.lexicon):
            miss *= 1 - value
        return 1 - miss


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", modulus: int = 4, remainder: int = 2, per_class: int = 2500, sample_bytes: int = 64 << 20) -> Model:
    sample, shares = labelled_sample(docs, labels, label_col, lambda c: ~held_out(c, modulus, remainder), per_class, sample_bytes, id_col, text_col)
    return Model(corpus_trigrams(docs, text_col), sample, shares)


def score_toxicity(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score of each row. The model is a lexicon from the bounded sample and the bounded trigram table."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sent.value.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.score(x.as_py() or "") for x in b.column(1)], pa.float64())], ["id", "score"])

    return src.mapInArrow(scored, f"id {src.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def toxicity_report(docs: DataFrame, labels: DataFrame, *, modulus: int = 4, remainder: int = 2, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    model = fit_toxicity(docs, labels, modulus=modulus, remainder=remainder)
    out = score_toxicity(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
