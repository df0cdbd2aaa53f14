"""String similarity kernels, Arrow-batched; equal pairs within a batch are computed once.

The plain functions say what each measure is. On batches, names_alike() and ratios() give the same numbers
for many pairs at a time: pairs of like lengths lie side by side in blocks, and each step is one of numpy's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel (Hyyrö 2004)."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & at.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    """2 LCS / (both lengths); 0 if either is empty."""
    return 2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of the longer, windows cut at its ends included."""
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    n = len(a)
    best = max(ratio(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b)))
    return max(best, max(ratio(b, a[max(0, i) : i + n]) for i in range(1 - n, n))) if len(a) == len(b) else best


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised by a tenth for each of four common leading characters where it is over 0.7."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    used, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    swapped = sum(x != y for x, y in zip(left, (c for c, u in zip(b, used) if u))) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio between the common words and the common words with either side's own."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    one, two = (" ".join(filter(None, (both, " ".join(sorted(s))))) for s in (x - y, y - x))
    return 1.0 if both in (one, two) and both else max(ratio(both, one), ratio(both, two), ratio(one, two))


#: Letters of a block of pairs, about; and ones in the lowest bits.
BLOCK = 1 << 17
_ONES = np.array([(1 << k) - 1 for k in range(65)], np.uint64)


class _Pairs:
    """The different pairs of two columns, their strings as codes: 0 and 1 stand for no letter, on either side."""

    def __init__(self, a: pd.Series, b: pd.Series):
        coded = pa.array(pd.concat([a.fillna(""), b.fillna("")], ignore_index=True), pa.string()).dictionary_encode()
        at, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        pair, self.back = np.unique(at[: len(a)].astype(np.int64) * len(words) + at[len(a) :], return_inverse=True)
        self.a, self.b = pair // max(1, len(words)), pair % max(1, len(words))
        self.words, self.size = words, np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.cumsum(self.size) - self.size
        letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        known = np.flatnonzero(np.bincount(letters, minlength=1))
        code = np.zeros(known[-1] + 1 if len(known) else 1, np.uint8 if len(known) < 254 else np.uint32)
        code[known] = np.arange(2, len(known) + 2)
        self.flat = np.append(code[letters], np.zeros(1, code.dtype))

    def rows(self, ids: np.ndarray, width: int, none: int) -> np.ndarray:
        """(width, len(ids)): the codes of these strings, a string in a column."""
        at = np.arange(width)[:, None]
        inside = at < self.size[ids]
        return np.where(inside, self.flat[np.where(inside, self.start[ids] + at, 0)], self.flat.dtype.type(none))

    def blocks(self, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places, ids of the shorter string, of the longer) of pairs of like lengths."""
        turned = self.size[self.a] > self.size[self.b]
        short, long = np.where(turned, self.b, self.a), np.where(turned, self.a, self.b)
        which = which[np.lexsort((self.size[short[which]], self.size[long[which]]))]
        while len(which):
            # The largest come first: their lengths say how many fit.
            n = max(1, BLOCK // max(1, 2 * int(self.size[long[which[-1]]])))
            now, which = which[-n:], which[:-n]
            yield now, short[now], long[now]


def _braid(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each letter of b (N, pairs) the first letter of the windows that can't match it with one of a (M, pairs); -1: all can.

    LCS(a, b[i:j]) is the number of k from i to j - 1 whose value is below i (Tiskin's seaweeds, combed
    along the diagonals; two that have crossed don't cross again).
    """
    m, n, width = len(a), len(b), a.shape[1]
    kind = np.uint8 if m + n < 256 else np.uint32
    h = np.repeat(np.arange(m - 1, -1, -1, dtype=kind)[:, None], width, 1)
    v = np.repeat(np.arange(m + n - 1, m - 1, -1, dtype=kind)[:, None], width, 1)
    b = b[::-1].copy()
    for d in range(m + n - 1):
        i, j = max(0, d - n + 1), min(m, d + 1)
        x, y = h[i:j], v[n - 1 - d + i : n - 1 - d + j]
        turn = (a[i:j] == b[n - 1 - d + i : n - 1 - d + j]) | (x > y)
        moved = (x ^ y) * turn.view(np.uint8)
        x ^= moved
        y ^= moved
    out = v[::-1].astype(np.int64) - m
    return np.maximum(out, -1)


def _windows(first: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """partial_ratio's best of the windows of the longer strings, from _braid(); m and n: the lengths."""
    width, long, short = first.shape[1], len(first), int(m.max())
    lane, k = np.arange(width), np.arange(long)[:, None]
    # Letter k counts in the windows that begin behind `first` and reach it: one more from there, one less behind k.
    begin = np.maximum(np.where(first < 0, -short, first), k - m) + short
    there = k < n
    more = np.bincount((begin * width + lane)[there], minlength=(long + short) * width).reshape(-1, width)[: long + short]
    more[short:] -= there
    held = np.cumsum(more, 0)
    i = np.arange(1 - short, long + 1)[:, None]
    size = np.minimum(i + m, n) - np.maximum(i, 0)
    return np.where((i > -m) & (i < n), 2 * held / np.maximum(m + size, 1), 0.0).max(0)


def _by_length(p: _Pairs, windows: bool) -> tuple[np.ndarray, np.ndarray]:
    """ratio and (if wanted) partial_ratio of each pair."""
    whole, part = np.zeros(len(p.a)), np.zeros(len(p.a))
    for at, short, long in p.blocks(np.flatnonzero((p.size[p.a] > 0) & (p.size[p.b] > 0))):
        m, n = p.size[short], p.size[long]
        first = _braid(p.rows(short, int(m.max()), 0), p.rows(long, int(n.max()), 1))
        whole[at] = 2 * ((first < 0) & (np.arange(len(first))[:, None] < n)).sum(0) / (m + n)
        if windows:
            part[at] = _windows(first, m, n)
            same = np.flatnonzero(m == n)
            if len(same):
                turned = _braid(p.rows(long[same], int(n[same].max()), 0), p.rows(short[same], int(m[same].max()), 1))
                part[at[same]] = np.maximum(part[at[same]], _windows(turned, n[same], m[same]))
    return whole, part


def _winklers(p: _Pairs) -> np.ndarray:
    """jaro_winkler of each pair; strings over 64 letters one by one."""
    out, la, lb = np.zeros(len(p.a)), p.size[p.a], p.size[p.b]
    out[(p.a == p.b) & (la > 0)] = 1.0
    apart = (p.a != p.b) & (la > 0) & (lb > 0)
    for k in np.flatnonzero(apart & (np.maximum(la, lb) > 64)).tolist():
        out[k] = jaro_winkler(p.words[p.a[k]], p.words[p.b[k]])
    for at, _, _ in p.blocks(np.flatnonzero(apart & (np.maximum(la, lb) <= 64))):
        m, n = la[at], lb[at]
        a, b = p.rows(p.a[at], int(m.max()), 0), np.ascontiguousarray(p.rows(p.b[at], 64, 1).T)
        reach = np.maximum(m, n) // 2 - 1
        taken, left = np.zeros(len(at), np.uint64), np.zeros((len(at), len(a)), bool)
        for i, c in enumerate(a):
            free = np.packbits(b == c[:, None], axis=1, bitorder="little").view("<u8")[:, 0] & ~taken
            free &= _ONES[np.maximum(np.minimum(n, i + reach + 1), 0)] & ~_ONES[np.clip(i - reach, 0, 64)]
            bit = free & (~free + np.uint64(1))
            taken |= bit
            left[:, i] = bit != 0
        used = np.unpackbits(taken.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(bool)
        k = left.sum(1)
        swapped = np.bincount(np.nonzero(left)[0][a.T[left] != b[used]], minlength=len(at)) // 2
        some = np.maximum(k, 1)
        jaro = np.where(k > 0, (k / m + k / n + (k - swapped) / some) / 3, 0.0)
        alike = a[:4].T == b[:, : min(4, len(a))]
        prefix = np.cumprod(alike, 1).sum(1)
        out[at] = np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro)
    return out


@F.pandas_udf(StructType([StructField(k, DoubleType()) for k in ("ratio", "partial", "winkler")]))
def names_alike(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """ratio, partial_ratio and jaro_winkler of each pair."""
    p = _Pairs(a, b)
    whole, part = _by_length(p, True)
    return pd.DataFrame({"ratio": whole[p.back], "partial": part[p.back], "winkler": _winklers(p)[p.back]})


@F.pandas_udf(DoubleType())
def fuzz_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    p = _Pairs(a, b)
    return pd.Series(_by_length(p, False)[0][p.back])


@F.pandas_udf(DoubleType())
def fuzz_partial(a: pd.Series, b: pd.Series) -> pd.Series:
    p = _Pairs(a, b)
    return pd.Series(_by_length(p, True)[1][p.back])


@F.pandas_udf(DoubleType())
def winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    p = _Pairs(a, b)
    return pd.Series(_winklers(p)[p.back])


def _udf(f):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple, float] = {}
        out = []
        for x in zip(a.fillna(""), b.fillna("")):
            if x not in known:
                known[x] = f(*x)
            out.append(known[x])
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(run, DoubleType())


token_set = _udf(token_set_ratio)
