"""Quality classifier: attention-based multiple-instance learning over a document's passages."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fold, table

#: Bytes of a passage; rows that the model learns from at most, and bytes of the longest of them; passages of a step.
PASSAGE, MOST_ROWS, MOST_BYTES, STEP = 512, 3000, 1 << 20, 1 << 12
KINDS = 16
FEATURES = KINDS * KINDS + 11


def _classes() -> np.ndarray:
    """Sixteen kinds of byte: by use in prose (vowels, consonants, capitals, figures, marks, ...)."""
    kind = np.full(256, 15, np.uint8)
    groups = ("aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "0123456789", " ", "\n\r", ".", ",;:", "!?", "'\"()[]{}", "|\t", "$%&#*", "<>=/\\_", "-+@^~`")
    for i, g in enumerate(groups):
        kind[list(g.encode())] = i
    return kind


CLASSES = _classes()


MIX = np.random.default_rng(11).integers(1, 1 << 62, 256, dtype=np.int64)


def _echoes(data, cut, of, doc, total: int, lags: tuple[int, ...]) -> list[np.ndarray]:
    """For each lag, the share of a passage's tokens (bytes between `cut` ones) that equal the one `lag` before.

    of, doc: the passage and the document of each byte; tokens don't reach into another document.
    """
    start = np.flatnonzero(~cut & np.r_[True, cut[:-1] | (doc[1:] != doc[:-1])]) if len(data) else data
    if not len(start):
        return [np.zeros(total, np.float32)] * len(lags)
    sums = np.add.reduceat(np.where(cut, 0, MIX[data]), start)  # of one token, as the bytes between weigh nothing
    where, own = of[start], doc[start]
    n = np.maximum(np.bincount(where, minlength=total), 1)
    out = []
    for lag in lags:
        same = np.r_[np.zeros(min(lag, len(sums)), bool), (sums[lag:] == sums[:-lag]) & (own[lag:] == own[:-lag])]
        out.append((np.bincount(where[same], minlength=total) / n).astype(np.float32))
    return out


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, number of passages of each text); an empty text has one passage.

    A text is cut evenly into passages of PASSAGE bytes at most. Features: square roots of the shares
    of pairs of neighbouring byte kinds; word and line length, size, doubled bytes, capitals, letters,
    marks, words and lines that repeat the ones before, and a constant.
    """
    count = np.array([max(1, -(-len(t) // PASSAGE)) for t in texts], np.int64)
    total = int(count.sum())
    d = np.zeros((total, PASSAGE), np.uint8)
    at = 0
    for t, n in zip(texts, count.tolist()):
        each = max(1, -(-len(t) // n))
        part = np.zeros(n * each, np.uint8)
        part[: len(t)] = np.frombuffer(t, np.uint8)
        d[at : at + n, :each] = part.reshape(n, each)
        at += n
    kind, live = CLASSES[d].astype(np.int32), d != 0
    size = live.sum(1)
    code = kind[:, :-1] * KINDS + kind[:, 1:] + (np.arange(total, dtype=np.int32) * (KINDS * KINDS))[:, None]
    pair = np.bincount(code[live[:, 1:]], minlength=total * KINDS * KINDS).reshape(total, -1)
    x = np.zeros((total, FEATURES), np.float32)
    x[:, : KINDS * KINDS] = np.sqrt(pair / np.maximum(size - 1, 1)[:, None])
    newline = (kind == 6) & live
    words, lines = (((kind == 5) & live) | newline).sum(1) + 1, newline.sum(1) + 1
    upper, letters = ((kind == 2) | (kind == 3)) & live, (kind <= 3) & live
    flat, of = live.ravel(), np.repeat(np.arange(total), PASSAGE)[live.ravel()]
    data = d.ravel()[flat]
    gap = np.isin(data, (9, 10, 13, 32))
    doc = np.repeat(np.arange(len(texts)), count)[of]
    more = [
        np.minimum(size / words, 40) / 10,
        np.log1p(size / lines) / 5,
        size / PASSAGE,
        ((d[:, 1:] == d[:, :-1]) & live[:, 1:]).mean(1),
        upper.sum(1) / np.maximum(letters.sum(1), 1),
        letters.sum(1) / np.maximum(size, 1),
        ((kind >= 9) & (kind <= 14) & live).sum(1) / words,
        *_echoes(data, gap, of, doc, total, (1, 2)),
        *_echoes(data, (data == 10) | (data == 13), of, doc, total, (1,)),
        np.ones(total),
    ]
    x[:, KINDS * KINDS :] = np.stack(more, 1)
    return x, count


@dataclass
class Attention:
    """Gated attention: h = tanh(W x); a = softmax over a bag of w (tanh(V h) * sigmoid(U h)); p = sigmoid(c sum(a h) + b)."""

    W: np.ndarray
    V: np.ndarray
    U: np.ndarray
    w: np.ndarray
    c: np.ndarray
    b: np.ndarray

    NAMES = ("W", "V", "U", "w", "c", "b")

    @classmethod
    def new(cls, features: int, hidden: int = 24, gate: int = 12, seed: int = 7) -> Attention:
        r = np.random.default_rng(seed)
        m = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        return cls(m(features, hidden), m(hidden, gate), m(hidden, gate), m(gate), m(hidden), np.zeros(1, np.float32))

    def forward(self, x: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, dict]:
        start = np.r_[0, np.cumsum(count)[:-1]]
        bag = np.repeat(np.arange(len(count)), count)
        h = np.tanh(x @ self.W)
        t, s = np.tanh(h @ self.V), 1 / (1 + np.exp(-(h @ self.U)))
        e = (t * s) @ self.w
        e = np.exp(e - np.maximum.reduceat(e, start)[bag])
        a = e / np.add.reduceat(e, start)[bag]
        z = np.add.reduceat(h * a[:, None], start, 0)
        p = 1 / (1 + np.exp(-np.clip(z @ self.c + self.b, -30, 30)))
        return p, {"h": h, "t": t, "s": s, "a": a, "z": z, "bag": bag, "start": start}

    def gradients(self, x, count, y, weight) -> dict[str, np.ndarray]:
        p, k = self.forward(x, count)
        h, t, s, a, bag = k["h"], k["t"], k["s"], k["a"], k["bag"]
        d = ((p - y) * weight / weight.sum()).astype(np.float32)
        dz = d[:, None] * self.c
        da = (dz[bag] * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, k["start"])[bag])
        dt, ds = de[:, None] * self.w * s * (1 - t * t), de[:, None] * self.w * t * s * (1 - s)
        dh = (dz[bag] * a[:, None] + dt @ self.V.T + ds @ self.U.T) * (1 - h * h)
        return {"W": x.T @ dh, "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": k["z"].T @ d, "b": d.sum(keepdims=True)}

    def fit(self, x, count, y, epochs: int = 25, batch: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Attention:
        """Adam on the weighted log loss; both labels weigh the same."""
        r = np.random.default_rng(seed)
        start = np.r_[0, np.cumsum(count)]
        share = y.mean()
        weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        m = {n: [np.zeros_like(getattr(self, n)), np.zeros_like(getattr(self, n))] for n in self.NAMES}
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(y))
            for i in range(0, len(y), batch):
                bags = order[i : i + batch]
                rows = np.concatenate([np.arange(start[j], start[j + 1]) for j in bags])
                g = self.gradients(x[rows], count[bags], y[bags], weight[bags])
                step += 1
                for n in self.NAMES:
                    v = getattr(self, n)
                    grad = g[n] + decay * v
                    m[n][0] = 0.9 * m[n][0] + 0.1 * grad
                    m[n][1] = 0.999 * m[n][1] + 0.001 * grad * grad
                    new = v - rate * (m[n][0] / (1 - 0.9**step)) / (np.sqrt(m[n][1] / (1 - 0.999**step)) + 1e-8)
                    setattr(self, n, new.astype(np.float32))
        return self

    def long(self, text: bytes, step: int = STEP) -> float:
        """The score of a text of many passages: all are encoded, `step` at a time, and weighed together at the end.

        The sums of weights and of weighted passages are kept with the greatest logit so far, so the memory doesn't
        grow with the text. (A passage's first words are compared with those before within its step.)
        """
        top, total, held = -np.inf, 0.0, np.zeros(len(self.c))
        for at in range(0, len(text), step * PASSAGE):
            h = np.tanh(passages([text[at : at + step * PASSAGE]])[0] @ self.W)
            e = (np.tanh(h @ self.V) * (1 / (1 + np.exp(-(h @ self.U))))) @ self.w
            new = max(top, float(e.max()))
            old, e = np.exp(top - new), np.exp(e - new)
            total, held, top = total * old + e.sum(), held * old + e @ h, new
        return float(1 / (1 + np.exp(-np.clip(held / total @ self.c + self.b[0], -30, 30))))

    def score(self, texts: list[str | None], step: int = STEP) -> np.ndarray:
        """Scores of the texts, in steps of about `step` passages; a text of more goes through long()."""
        out, part, at, size = np.zeros(len(texts)), [], [], 0

        def settle() -> None:
            if part:
                out[at] = self.forward(*passages(part))[0]
                part.clear()
                at.clear()

        for i, t in enumerate(texts):
            t = (t or "").encode()
            if len(t) > step * PASSAGE:
                out[i] = self.long(t, step)
                continue
            part.append(t)
            at.append(i)
            size += max(1, len(t) // PASSAGE)
            if size >= step:
                settle()
                size = 0
        settle()
        return out


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Attention | float:
    """Fit on the labels that aren't held out (crc32 of doc_id mod 5 isn't 0), of at most `most` documents.

    Those with the least hash of doc_id are taken, among texts of MOST_BYTES at most (of others no passage is
    left out, here or in scoring, but they aren't learned from); a document with several labels counts as 1 if any
    is; a doc_id with several rows gives as many, and `most` rows in all. Null labels and ids
    are left out. Without rows of both labels the model is a constant: that label's, or 0.5.
    """
    own = labels.where("doc_id is not null and quality is not null").where(fold(F.col("doc_id")) % 5 != 0)
    own = own.groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("y"))
    picked = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def run(batches):
        for b in batches:
            for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                x, _ = passages([(t or "").encode()])
                cols = [pa.array([y], pa.int32()), pa.array([len(x)], pa.int32()), pa.array([x.astype(np.float16).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["y", "n", "x"])

    short = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= MOST_BYTES)
    bags = short.join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(most).select("text", "y")
    rows = bags.mapInArrow(run, "y int, n int, x binary").collect()  # `most` at most
    ys = {r["y"] for r in rows}
    if len(ys) < 2:
        return float(ys.pop()) if ys else 0.5
    rows.sort(key=lambda r: (r["y"], r["n"], bytes(r["x"])))
    x = np.concatenate([np.frombuffer(r["x"], np.float16).reshape(-1, FEATURES) for r in rows]).astype(np.float32)
    return Attention.new(FEATURES).fit(x, np.array([r["n"] for r in rows]), np.array([r["y"] for r in rows], np.float32))


def _scores(model, texts) -> np.ndarray:
    return model.score(texts) if isinstance(model, Attention) else np.full(len(texts), model)


def classify(docs: DataFrame, model: Attention | float, at: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs(doc_id, text).

    Only the whole text is scored; null counts as empty and is scored too. Rows without a doc_id have
    held_out null; repeated rows stay; other columns are ignored.
    """
    def run(batches):
        for b in batches:
            s = _scores(model, b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return got.select("doc_id", (fold(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Attention | float, at: float = 0.3) -> DataFrame:
    """The rows of docs whose text scores `at` or more, unchanged; null texts are scored as empty ones, repeated rows alike."""

    @F.pandas_udf("double")
    def score(t):
        import pandas as pd

        return pd.Series(_scores(model, [x if isinstance(x, str) else None for x in t]))

    return docs.where(score("text") >= at)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, by a model of the labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))
