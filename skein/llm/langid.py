"""Language identification by multilingual mixture inference over n-gram likelihoods."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fold, table

#: Bins of the hashed letter n-grams (a power of two), and documents learned from for each language at most.
BINS, MOST_DOCS = 1 << 16, 600
ORDERS = (1, 2, 3, 4)
#: Characters of a step; a longer text is worked on in several, cut where no letter stands, with the counts of all.
STEP = 1 << 18
GAP = re.compile(r"[\W\d_]")


def pieces(text: str) -> Iterator[str]:
    """The text in pieces of STEP characters, each up to the next that isn't a letter: no word is cut."""
    at = 0
    while at < len(text):
        m = GAP.search(text, min(at + STEP, len(text)))
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def words_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes of letters with one 0 before each word and at the end, starts of the words)."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[codes]
    held = np.r_[np.uint32(0), np.where(letter, codes, 0).astype(np.uint32), np.uint32(0)]
    keep = (held != 0) | np.r_[held[1:] != 0, False] | np.r_[False, held[:-1] != 0]
    held = held[keep]
    held = held[(held != 0) | np.r_[True, held[:-1] != 0]]  # one gap between words
    return held, np.flatnonzero((held != 0) & np.r_[False, held[:-1] == 0])


def grams(held: np.ndarray, order: int) -> np.ndarray:
    """Bins of the n-gram that ends at each place from order - 1 on."""
    n = len(held) - order + 1
    h = np.full(max(n, 0), order, np.uint64)
    for i in range(order):
        h = (h * np.uint64(0x100000001B3)) ^ held[i : i + n].astype(np.uint64)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(48)).astype(np.int64) & (BINS - 1)


def counts(text: str) -> np.ndarray:
    """How often each bin of each order occurs in the words of a text: an array (orders, BINS)."""
    out = np.zeros((len(ORDERS), BINS), np.float32)
    for part in pieces(text):
        held, _ = words_of(part)
        for i, n in enumerate(ORDERS):
            out[i] += np.bincount(grams(held, n), minlength=BINS)
    return out


@dataclass
class Languages:
    """Letter n-gram models: log P(letter | three before) by interpolation, in `logp` (BINS, languages) by order."""

    names: list[str]
    logp: np.ndarray

    @classmethod
    def learn(cls, found: dict[str, np.ndarray], smooth: float = 0.5) -> Languages:
        """found: for each language the summed counts()."""
        names = sorted(found)
        out = np.zeros((len(ORDERS), BINS, len(names)), np.float32)
        for j, name in enumerate(names):
            c = found[name]
            out[:, :, j] = np.log((c + smooth) / (c.sum(1, keepdims=True) + smooth * BINS))
        return cls(names, out)

    def words(self, text: str) -> np.ndarray:
        """log likelihood of each word of the text for each language: the mean over orders of the n-grams' that end in it."""
        parts = []
        for part in pieces(text):
            held, start = words_of(part)
            if not len(start):
                continue
            ll = np.zeros((len(held), len(self.names)), np.float32)
            for i, n in enumerate(ORDERS[1:], 1):
                ll[n - 1 :] += self.logp[i][grams(held, n)]
            parts.append(np.add.reduceat(ll, start, 0) / (len(ORDERS) - 1))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.names)), np.float32)

    def mixture(self, text: str, rounds: int = 8) -> tuple[np.ndarray, list[int], np.ndarray]:
        """(proportions of the words by language, the selected languages, mean probability of each for a word).

        Expectation-maximisation of the proportions for the words' likelihoods. Languages enter the
        set, best first, as long as the log likelihood grows by more than log(words) / 2 + 2.
        """
        ll = self.words(text).astype(np.float64)
        if not len(ll):
            return np.full(len(self.names), 1 / len(self.names)), [], np.zeros(len(self.names))
        total = ll.sum(0)
        first = int(total.argmax())
        share = np.zeros(len(self.names))
        share[first] = 1.0
        if len(self.names) == 1:
            return share, [first], share
        like = np.exp(ll - ll.max(1, keepdims=True))
        tail, chosen, score = ll.max(1).sum(), [first], total[first]
        need = np.log(len(ll)) / 2 + 2
        weight = likely = (like / like.sum(1, keepdims=True)).mean(0)  # the first round's, from equal proportions
        for _ in range(rounds - 1):
            r = like * weight
            r /= r.sum(1, keepdims=True)
            weight = r.mean(0)
        for k in np.argsort(-weight):
            if k == first:
                continue
            trial = [*chosen, int(k)]
            part, w = like[:, trial], weight[trial] / weight[trial].sum()
            for _ in range(rounds):
                r = part * w
                r /= np.maximum(r.sum(1, keepdims=True), 1e-300)
                w = r.mean(0)
            got = np.log(np.maximum(part @ w, 1e-300)).sum() + tail
            if got <= score + need:
                break
            chosen, score = trial, got
            share[:] = 0
            share[trial] = w
        return share, chosen, likely

    def predict(self, text: str | None) -> tuple[str, float, list[str], list[float]]:
        """(language, score, the selected languages, their shares), largest share first; und, 0 and none without a letter.

        The score is the mean probability that a word of the text is of that language, each language
        taken as equally likely before: near 1 for a clear text in one language, less for a mixed or doubtful one.
        """
        if not text or not any(map(str.isalpha, text)) or not self.names:
            return "und", 0.0, [], []
        share, chosen, likely = self.mixture(text)
        chosen = sorted(chosen, key=lambda k: -share[k]) or [int(share.argmax())]
        return self.names[chosen[0]], float(min(1.0, likely[chosen[0]])), [self.names[k] for k in chosen], [float(share[k]) for k in chosen]


def learn(docs: DataFrame, most: int = MOST_DOCS) -> Languages:
    """Models from the text and lang of documents whose crc32 of doc_id mod 3 isn't 1.

    Every language that occurs is learned, each from about `most` of its documents, chosen by the
    hash of doc_id and text (all, if it has fewer). Null langs, texts and ids are left out.
    """
    own = docs.where("doc_id is not null and lang is not null and text is not null").where(fold(F.col("doc_id")) % 3 != 1)
    n = own.groupBy("lang").agg(F.count("*").alias("of_lang"))
    span = 1 << 30
    pick = F.pmod(F.xxhash64("doc_id", "text"), F.lit(span)) < F.ceil(F.lit(float(most * span)) / F.col("of_lang"))
    picked = own.select("doc_id", "lang", "text").join(F.broadcast(n), "lang").where(pick)

    def run(batches):
        got: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                c = counts(text)
                if lang in got:
                    got[lang] += c
                else:
                    got[lang] = c
        for lang, c in got.items():
            where = np.flatnonzero(c)
            cols = [pa.array([lang]), pa.array([where.astype(np.int32).tobytes()], pa.binary()), pa.array([c.ravel()[where].tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["lang", "at", "n"])

    found: dict[str, np.ndarray] = {}
    for r in picked.coalesce(12).mapInArrow(run, "lang string, at binary, n binary").toLocalIterator():
        c = found.setdefault(r["lang"], np.zeros((len(ORDERS), BINS), np.float32))
        c.ravel()[np.frombuffer(r["at"], np.int32)] += np.frombuffer(r["n"], np.float32)
    return Languages.learn(found)


def identify(docs: DataFrame, model: Languages) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, langs, shares) of each row of docs(doc_id, text), from the whole text.

    Null texts and texts without a letter: und, score 0, no languages. With nothing learned all are
    und. Rows without a doc_id have held_out null; repeated rows stay; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.names, model.logp.astype(np.float16)))  # names: as many as languages

    def run(batches):
        names, logp = sent.value
        m = Languages(names, logp.astype(np.float32))
        for b in batches:
            out = [m.predict(t) for t in b.column("text").to_pylist()]
            types = [pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64())]
            cols = [b.column("doc_id"), *(pa.array([x[i] for x in out], t) for i, t in enumerate(types))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang_pred", "score", "langs", "shares"])

    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, langs array<string>, shares array<double>")
    return got.select("doc_id", (fold(F.col("doc_id")) % 3 == 1).alias("held_out"), "lang_pred", "score", "langs", "shares")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, by models learned from the contract's part of the table; langs and shares more."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))
