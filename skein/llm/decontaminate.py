"""Benchmark decontamination: a BM25 index of test items, queried by every passage with block-max WAND."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._common import table, written

TOKEN = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
#: BM25's constants; the share of an item's own score that retrieves it; postings of a block.
K1, B, RETRIEVE, BLOCK = 1.2, 0.75, 0.5, 64
#: Items of a zone, whose maxima rule out most passages before any cursor moves; words of a step of that; cells in a table.
ZONE, STEP, TABLE = 4, 1 << 15, 1 << 22
#: Words of a shingle, the share of an item's shingles that a passage must hold, and of its answer's words.
WIDTH, OVERLAP, ANSWER = 5, 0.8, 0.8
#: Characters of test items in one index; more items are searched in several passes over the documents.
INDEX_CHARS = 1 << 25


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def shingles(words: list[str], width: int = WIDTH) -> set[tuple[str, ...]]:
    """Runs of `width` words; of fewer words, all of them."""
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def question_answer(text: str | None) -> tuple[list[str], list[str]]:
    """The words before the last sentence and of it; one sentence, or a question of under five words, is all question."""
    parts = [w for w in map(tokens, SENTENCE.split(text or "")) if w]
    before = [w for p in parts[:-1] for w in p]
    return (before, parts[-1]) if len(before) >= WIDTH else (before + (parts[-1] if parts else []), [])


@dataclass
class Index:
    """Postings by term: item numbers in order, with BM25 shares of the item's own score, and their block maxima."""

    items: list[tuple[object, list[str], list[str]]]
    ids: dict[str, int] = field(default_factory=dict)
    posts: list[np.ndarray] = field(default_factory=list)
    shares: list[np.ndarray] = field(default_factory=list)
    block: list[np.ndarray] = field(default_factory=list)
    most: np.ndarray = field(default_factory=lambda: np.zeros(1))
    grams: list[set] = field(default_factory=list)
    span: int = 32
    zones: int = 1
    cells: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    peaks: np.ndarray = field(default_factory=lambda: np.zeros(0))
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    table: np.ndarray | None = None

    @classmethod
    def build(cls, items: list[tuple[object, list[str], list[str]]]) -> Index:
        """items: (id, question words, answer words); those without a word are left out."""
        self = cls([x for x in items if x[1] or x[2]])
        own = [Counter(q + a) for _, q, a in self.items]
        size = np.array([sum(c.values()) for c in own], float)
        mean, n = (size.mean() if len(size) else 1.0), len(own)
        df = Counter(t for c in own for t in c)
        idf = {t: np.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
        by_term: dict[str, list[tuple[int, float]]] = {}
        for i, c in enumerate(own):
            raw = {t: idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * size[i] / mean)) for t, f in c.items()}
            total = sum(raw.values()) or 1.0
            for t, v in raw.items():
                by_term.setdefault(t, []).append((i, v / total))
        for t, p in by_term.items():
            self.ids[t] = len(self.posts)
            self.posts.append(np.array([x[0] for x in p], np.int64))
            self.shares.append(np.array([x[1] for x in p]))
            self.block.append(np.maximum.reduceat(self.shares[-1], np.arange(0, len(p), BLOCK)))
        self.most = np.array([b.max() for b in self.block] + [0.0])  # the last is for words of no item
        # A term's cells are term * zones + zone, in order, each with the term's greatest share in the zone.
        self.zones = max(1, -(-n // ZONE))
        sizes = [len(p) for p in self.posts]
        if sizes:
            cell = np.repeat(np.arange(len(sizes)), sizes) * self.zones + np.concatenate(self.posts) // ZONE
            cut = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            self.cells, self.peaks = cell[cut], np.maximum.reduceat(np.concatenate(self.shares), cut)
        self.first = np.searchsorted(self.cells, np.arange(len(sizes) + 1) * self.zones)
        self.grams = [shingles(q + a) for _, q, a in self.items]
        self.span = max(32, int(size.max())) if len(size) else 32
        return self

    def wand(self, terms: list[int], least: float, zones: list[int] | None = None) -> list[tuple[int, float]]:
        """All (item, score) of at least `least` for a query of distinct terms, in the given zones alone if there are any.

        Cursors stand in order of their item. The pivot is the first where the terms' maxima reach
        `least`; if the maxima of the blocks at the pivot don't, the cursors move past the nearest
        end of these blocks; else the item is scored once all cursors before the pivot have come to it.
        """
        found = []
        at = [[int(self.posts[t][0]), 0, t] for t in terms]
        while at:
            at.sort()
            bound, p = 0.0, -1
            for p, (_, _, t) in enumerate(at):
                bound += self.most[t]
                if bound >= least:
                    break
            else:
                return found
            pivot = at[p][0]
            while p + 1 < len(at) and at[p + 1][0] == pivot:
                p += 1
            held, ends = 0.0, []
            dead = None
            if zones is not None:
                while zones and zones[0] < pivot // ZONE:
                    zones = zones[1:]
                if not zones:
                    return found
                if zones[0] > pivot // ZONE:
                    p, dead = len(at) - 1, zones[0] * ZONE
            for _, i, t in at[: p + 1] if dead is None else ():
                posts = self.posts[t]
                j = i + int(posts[i:].searchsorted(pivot)) if posts[i] < pivot else i
                b = j // BLOCK
                if b < len(self.block[t]):
                    held += self.block[t][b]
                    ends.append(int(posts[min((b + 1) * BLOCK, len(posts)) - 1]))
            if dead is not None:
                to = dead
            elif held < least:
                # No item up to the nearest block's end, or before the next cursor, can score enough.
                to = max(pivot + 1, min([*(e + 1 for e in ends), *(x[0] for x in at[p + 1 : p + 2])]))
            elif at[0][0] == pivot:
                score = sum(self.shares[t][i] for _, i, t in at[: p + 1])
                if score >= least:
                    found.append((pivot, float(score)))
                to = pivot + 1
            else:
                to = pivot
            moved = []
            for x in at[: p + 1]:
                if x[0] < to:
                    posts = self.posts[x[2]]
                    x[1] += int(posts[x[1] :].searchsorted(to))
                    if x[1] == len(posts):
                        continue
                    x[0] = int(posts[x[1]])
                moved.append(x)
            at = moved + at[p + 1 :]
        return found

    def peak(self, cell: np.ndarray) -> np.ndarray:
        """The greatest share in each cell, 0 in one without postings; by a table of all cells if it is small."""
        if len(self.posts) * self.zones <= TABLE:
            if self.table is None:
                self.table = np.zeros(len(self.posts) * self.zones)
                self.table[self.cells] = self.peaks
            return self.table[cell]
        at = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
        return np.where(self.cells[at] == cell, self.peaks[at], 0.0)

    def live(self, ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[int, list[int]]]:
        """(passage, zones) of the passages ids[start:end] where the terms' maxima in a zone reach RETRIEVE; no other can hold an item.

        As at WAND's pivot, the terms of least maxima that stay below RETRIEVE together can't retrieve
        an item alone: only zones of the other terms are looked at, and the lesser ones are added there.
        """
        size = end - start
        before = np.cumsum(size) - size
        p = np.repeat(np.arange(len(start)), size)
        t = ids[np.arange(len(p)) + (start - before)[p]]
        p, t = np.divmod(np.unique((p * len(self.posts) + t)[t >= 0]), len(self.posts))
        order = np.lexsort((self.most[t], p))
        t = t[order]  # p is in order as it is
        low = np.searchsorted(p, np.arange(len(start) + 1))
        sums = np.r_[0.0, np.cumsum(self.most[t])]
        strong = sums[1:] - sums[low[p]] >= RETRIEVE - 1e-9
        ends = low[:-1] + np.bincount(p[~strong], minlength=len(start))  # of the lesser terms
        rest = sums[ends] - sums[low[:-1]]
        n = (self.first[t + 1] - self.first[t]) * strong
        at = np.arange(n.sum()) + np.repeat(self.first[t] - (np.cumsum(n) - n), n)
        pair = np.repeat(p, n) * self.zones + self.cells[at] % self.zones
        order = np.argsort(pair, kind="stable")
        pair, by = pair[order], self.peaks[at][order]
        cut = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, np.int64)
        held = np.add.reduceat(by, cut) if len(pair) else by
        pair = pair[cut]
        p, zone = np.divmod(pair, self.zones)
        near = held + rest[p] >= RETRIEVE - 1e-9
        p, zone, held = p[near], zone[near], held[near]
        n = ends[p] - low[p]
        row = np.repeat(np.arange(len(p)), n)
        cell = t[np.arange(len(row)) + (low[p] - (np.cumsum(n) - n))[row]] * self.zones + zone[row]
        held += np.bincount(row, self.peak(cell), len(p))
        near = held >= RETRIEVE - 1e-9
        p, at = np.unique(p[near], return_index=True)
        return [(i, z.tolist()) for i, z in zip(p.tolist(), np.split(zone[near], at[1:]))]

    def search(self, text: str | None) -> dict[int, tuple[float, float, float]]:
        """For each item found in a passage of the text: the best (overlap, answer's overlap, score).

        Passages are 2 x span words, one every span words, and span is the longest item's length: each
        place of an item is whole in some passage. An item of n < WIDTH words is compared with the
        passage's runs of n words.
        """
        words = tokens(text)
        if not words or not self.items:
            return {}
        ids = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        total = np.r_[0.0, np.cumsum(self.most[ids])]
        start = np.arange(0, max(1, len(words) - self.span), self.span)
        end = np.minimum(start + 2 * self.span, len(words))
        best: dict[int, tuple[float, float, float]] = {}
        some = total[end] - total[start] >= RETRIEVE
        start, end = start[some], end[some]
        each = max(1, STEP // (2 * self.span))
        live = ((i + j, z) for i in range(0, len(start), each) for j, z in self.live(ids, start[i : i + each], end[i : i + each]))
        for i, zones in live:
            s, e = start[i], end[i]
            terms = np.unique(ids[s:e])
            terms = terms[terms >= 0]
            if self.most[terms].sum() < RETRIEVE:
                continue
            hits = self.wand(terms.tolist(), RETRIEVE, zones)
            if not hits:
                continue
            part = words[s:e]
            held, bag = {}, Counter(part)  # held: the passage's runs by their width
            for i, score in hits:
                answer = Counter(self.items[i][2])
                width = min(WIDTH, len(self.items[i][1]) + len(self.items[i][2]))
                if width not in held:
                    held[width] = shingles(part, width)
                both = len(self.grams[i] & held[width]) / len(self.grams[i])
                of_answer = sum((answer & bag).values()) / sum(answer.values()) if answer else 1.0
                best[i] = max(best.get(i, (0.0, 0.0, 0.0)), (both, of_answer, score))
        return best

    def leaks(self, text: str | None) -> list[tuple[int, float, float, float]]:
        return [(i, *x) for i, x in sorted(self.search(text).items()) if x[0] >= OVERLAP and x[1] >= ANSWER]


def indexes(benchmark: DataFrame) -> Iterator[tuple[Index, bool]]:
    """Indexes of benchmark(item_id, text), or (item_id, question, answer), each of about INDEX_CHARS characters, and whether more follow.

    The items' size is counted first; each index is built from its own block of them when it is asked for, so the
    driver holds one at a time. Items that are null or without a word match nothing; those of under WIDTH
    words match wherever all their words stand in a row.
    """
    cols = ["question", "answer"] if "question" in benchmark.columns else ["text"]
    chars = benchmark.agg(*[F.coalesce(F.sum(F.length(c)), F.lit(0)) for c in cols], F.count("*")).first()
    blocks = -(-(sum(chars[:-1]) + 64 * chars[-1]) // INDEX_CHARS)
    for b in range(blocks):
        spot = F.pmod(F.xxhash64("item_id", *cols), F.lit(blocks))
        rows = benchmark.where(spot == b).select("item_id", *cols).collect()
        rows = sorted(rows, key=lambda r: (r[0] is None, str(r[0]), r[1] or ""))
        qa = [(r[0], *(question_answer(r[1]) if len(r) == 2 else (tokens(r[1]), tokens(r[2])))) for r in rows]
        yield Index.build(qa), b + 1 < blocks


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, overlap, answer_overlap, score) for each item that some passage of a document leaks.

    docs(doc_id, text): every passage of every whole text queries the index; null and empty texts leak
    nothing. An item with several rows of the same words is found as each. Repeated rows of docs give
    repeated results; other columns are ignored. item_id keeps its type. Of several indexes each is
    searched, its results written and itself released before the next is built.
    """
    item = benchmark.schema["item_id"].dataType
    schema = f"doc_id long, item_id {item.simpleString()}, overlap double, answer_overlap double, score double"
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = docs.sparkSession.createDataFrame([], schema)
    for index, more in indexes(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(index)  # INDEX_CHARS characters at most

        def run(batches, sent=sent):
            ix = sent.value
            for b in batches:
                found = [(d, ix.items[i][0], *x) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for i, *x in ix.leaks(t)]
                types = [pa.int64(), to_arrow_type(item), *[pa.float64()] * 3]
                cols = [pa.array([f[k] for f in found], x) for k, x in enumerate(types)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "overlap", "answer_overlap", "score"])

        part = base.mapInArrow(run, schema)
        if more:
            part = written(part)
            sent.destroy()
        out = out.union(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that leak no item, unchanged; null texts leak nothing, repeated rows go or stay alike."""
    for index, more in indexes(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(index)
        docs = docs.where(_free_of(sent)("text"))
        if more:
            docs = written(docs)
            sent.destroy()
    return docs


def _free_of(sent):
    def free(t: pd.Series) -> pd.Series:
        return t.map(lambda x: not (isinstance(x, str) and sent.value.leaks(x))).astype(bool)

    return F.pandas_udf(free, "boolean")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak of a test item in the whole table, by leaks()."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
