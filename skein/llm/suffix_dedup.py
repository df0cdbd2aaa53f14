"""Repeated 200-byte strings by a distributed merge sort of sampled suffixes.

Sorting every suffix would move two hundred times the text, so suffixes are sampled: a window's
anchor is the least hashed 8-byte gram of its first 104 bytes. Equal windows have their anchors at
equal places, and the 104 bytes from an anchor on, its core, lie within the window. So a record is a suffix from
an anchor on, with the bytes before it, as far as the windows of that anchor reach: 96 bytes
before and 200 from it at most. Two records share a window that starts s bytes before the anchor where
the suffixes have a common prefix of 200 - s bytes or more and the bytes before them a common end of s or more.

1. Every chunk of documents sends short hashes of its cores, with the number of their records, by
   value to tasks that send back which cores other chunks have too. (Prefix doubling's filter: a
   suffix that differs from all others early need not be sent. A collision costs a record sent in vain.)
2. Chunks sort the suffixes whose core does repeat to runs, front-coded: a suffix is sent without the prefix that
   it shares with the one before. Runs go to tasks by their core, so what has to meet does.
3. A loser tree merges a task's runs. It keeps each run's common prefix with the last winner and never
   compares those bytes again. The common prefixes of the merged order, and those of the bytes before the
   anchors sorted from their ends, part the records for each s: those in one part on both sides
   share the window.
4. The windows that are shared go back to the chunks, which remove what they cover.

A chunk sends a record once, however often it has it. A core with more than HOT records (a common
passage in very many contexts) isn't merged in one task: its windows themselves are sent as 64-bit hashes,
each to the task of its value and once for each chunk, which splits it to any number of tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

#: Bytes of a repeated string, of a gram, of a core; places of an anchor in a window.
LENGTH, GRAM, CORE = 200, 8, 104
PLACES = LENGTH - CORE + 1
#: Bytes of text in a chunk, of a step within it, of hashes and of decoded records in a task at most, on average.
CHUNK, STEP, HASHES, RECORDS = 4 << 20, 1 << 18, 4 << 20, 16 << 20
#: Records of one core that are merged in one task, and records whose windows are compared together.
HOT, BATCH = 4096, 1 << 15
MASK40 = np.uint64((1 << 40) - 1)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(random values of bytes, powers of an odd base modulo 2^64, powers of its inverse)."""
    value = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    base = 0x9E3779B97F4A7C15
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return value, np.cumprod(up), np.cumprod(down)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Slab:
    """Hashes of the strings of a stretch of at most STEP + 2 LENGTH bytes, by sums of byte values times powers."""

    def __init__(self, data: np.ndarray):
        value, up, down = _powers(STEP + 2 * LENGTH)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(value[data] * up[: len(data)], out=self.sums[1:])
        self.down = down

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def every(self, width: int) -> np.ndarray:
        """The hash of `width` bytes from each place on."""
        n = len(self.sums) - width
        return (self.sums[width:] - self.sums[:n]) * self.down[:n]


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` hashes the place of its least one, the first of equals."""
    n = len(h) - width + 1
    bits = 20  # over those of len(h); the same everywhere, as the choice must depend on the bytes alone
    key = (_mix(h) >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(h), dtype=np.uint64)
    full = np.full(-(-len(h) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(h)] = key
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return (np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & np.uint64((1 << bits) - 1)).astype(np.int64)


class Records(NamedTuple):
    """Anchors of a stretch: place, least and greatest s of their windows, hashes of core and of the whole record."""

    at: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    core: np.ndarray
    name: np.ndarray


class Chunk:
    """The distinct texts of a chunk, their bytes one after the other, and the records in them.

    A step's records are made at a time, so that the arrays don't grow with a text's length; of a record
    that occurs again only the first is kept, with `again` set.
    """

    def __init__(self, rows: pa.Table):
        self.texts: list[bytes] = list(dict.fromkeys(rows["text"].cast(pa.large_binary()).to_pylist()))
        sizes = np.array([len(t) for t in self.texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.bytes = b"".join(self.texts)
        self.data = np.frombuffer(self.bytes, np.uint8)
        self.usable = np.zeros(len(self.data), bool)  # windows start within one document
        for s, e in zip(self.starts.tolist(), self.ends.tolist()):
            self.usable[s : max(s, e - LENGTH + 1)] = True

    def steps(self) -> Iterator[Records]:
        for base in range(0, len(self.data) - LENGTH + 1, STEP):
            part = self.data[base : base + STEP + LENGTH - 1]
            windows = len(part) - LENGTH + 1
            w = np.flatnonzero(self.usable[base : base + windows])
            if not len(w):
                continue
            slab = Slab(part)
            a = least_places(slab.every(GRAM)[: windows + PLACES - 1], PLACES)[w]
            new = np.r_[True, (a[1:] != a[:-1]) | (w[1:] != w[:-1] + 1)]
            last = np.r_[new[1:], True]
            a, first, last = a[new], w[new], w[last]
            core = _mix(slab.hash(a, a + CORE))
            size = (last - first) * 256 + (a - first)
            name = _mix(slab.hash(first, last + LENGTH) ^ _mix(size.astype(np.uint64)) ^ core)
            yield Records(a + base, a - last, a - first, core, name)

    def distinct(self) -> tuple[Records, np.ndarray]:
        """(records, the first of equal ones; whether each occurs again in the chunk)."""
        parts, more = [], []
        for r in self.steps():
            _, i, n = np.unique(r.name, return_index=True, return_counts=True)
            parts.append(Records(*(x[i] for x in r)))
            more.append(n > 1)
        if not parts:
            none = np.zeros(0, np.int64)
            return Records(none, none, none, none.astype(np.uint64), none.astype(np.uint64)), np.zeros(0, bool)
        r = Records(*(np.concatenate(x) for x in zip(*parts)))
        _, i, back, n = np.unique(r.name, return_index=True, return_inverse=True, return_counts=True)
        again = n > 1
        np.logical_or.at(again, back, np.concatenate(more))
        return Records(*(x[i] for x in r)), again

    def windows(self, start: np.ndarray) -> np.ndarray:
        """The hashes of the windows at these sorted places."""
        out = np.zeros(len(start), np.uint64)
        for base in range(0, len(self.data), STEP):
            i, j = np.searchsorted(start, [base, base + STEP])
            if i < j:
                s = start[i:j] - base
                out[i:j] = _mix(Slab(self.data[base : base + STEP + LENGTH - 1]).hash(s, s + LENGTH) ^ np.uint64(3))
        return out


def _parts(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(the leading `bits` that occur in sorted keys, the bounds of their stretches)."""
    top = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, top[1:] != top[:-1]]) if len(top) else np.zeros(0, np.int64)
    return top[cut], np.r_[cut, len(top)]


def _short(h: np.ndarray) -> np.ndarray:
    """The low 40 bits of hashes as rows of five bytes; the leading ones are known from their part."""
    return (h & MASK40).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]


def hashes_of(rows: pa.Table, bits: int) -> pa.Table:
    """Step 1, out: (p, chunk, data), of the chunk's cores five bytes of hash and a byte, eight times log2 of their records."""
    core, n = np.unique(Chunk(rows).distinct()[0].core, return_counts=True)
    size = np.minimum(np.ceil(8 * np.log2(n)), 255).astype(np.uint8)
    p, cut = _parts(core, bits)
    both = np.concatenate([_short(core), size[:, None]], 1)
    data = [both[s:e].tobytes() for s, e in zip(cut, cut[1:])]
    return pa.table({"p": pa.array(p, pa.int64()), "chunk": pa.array([rows["chunk"][0].as_py()] * len(p), pa.int64()), "data": pa.array(data, pa.binary())})


def repeated(rows: pa.Table, hot: int = HOT) -> pa.Table:
    """Step 1, back: (chunk, p, data), for each of the chunk's cores a byte: 0 it has no other records, 1 it has, 2 over `hot`."""
    own = [np.frombuffer(x, np.uint8).reshape(-1, 6) for x in rows["data"].to_pylist()]
    every = np.concatenate(own)
    wide = np.zeros((len(every), 8), np.uint8)
    wide[:, :5] = every[:, :5]
    h = wide.view("<u8").ravel()
    _, back, chunks = np.unique(h, return_inverse=True, return_counts=True)
    records = np.bincount(back, 2.0 ** (every[:, 5] / 8))
    state = np.where(records > hot, 2, (chunks > 1) | (records > 1.01)).astype(np.uint8)[back]
    data = [x.tobytes() for x in np.split(state, np.cumsum([len(x) for x in own])[:-1])]
    return pa.table({"chunk": rows["chunk"], "p": rows["p"], "data": pa.array(data, pa.binary())})


def encode(run: list[tuple[bytes, bytes, int]]) -> bytes:
    """A sorted run of (suffix, what precedes it, the record's name), front-coded."""
    n = len(run)
    size = np.array([len(r[0]) for r in run], np.uint8)
    flat = np.frombuffer(b"".join(r[0].ljust(LENGTH, b"\0") for r in run), np.uint8).reshape(n, LENGTH)
    lcp = np.zeros(n, np.uint8)
    if n > 1:
        differ = flat[1:] != flat[:-1]
        first = np.where(differ.any(1), differ.argmax(1), LENGTH)
        lcp[1:] = np.minimum(first, np.minimum(size[1:], size[:-1]))
    head = np.stack([lcp, size, np.array([len(r[1]) for r in run], np.uint8)])
    names = np.array([r[2] for r in run], np.uint64)
    rest = b"".join(r[0][k:] + r[1] for r, k in zip(run, lcp.tolist()))
    return n.to_bytes(4, "little") + head.tobytes() + names.tobytes() + rest


def decode(blob: bytes) -> tuple[list[bytes], list[int], list[bytes], np.ndarray]:
    """(suffixes, common prefixes with the one before, what precedes them, names)."""
    n = int.from_bytes(blob[:4], "little")
    head = np.frombuffer(blob, np.uint8, 3 * n, 4).reshape(3, n)
    names = np.frombuffer(blob, np.uint64, n, 4 + 3 * n)
    at, last, suffixes, lefts = 4 + 11 * n, b"", [], []
    for k, size, before in zip(*head.tolist()):
        e = at + size - k
        last = last[:k] + blob[at:e]
        suffixes.append(last)
        lefts.append(blob[e : e + before])
        at = e + before
    return suffixes, head[0].tolist(), lefts, names


def common(a: bytes, b: bytes, k: int) -> int:
    """Length of the common prefix of a and b, of which k bytes are known."""
    n = min(len(a), len(b))
    if a[k:n] == b[k:n]:
        return n
    x = int.from_bytes(a[k:n], "big") ^ int.from_bytes(b[k:n], "big")
    return n - (x.bit_length() + 7) // 8


def merge(runs: list[tuple[list[bytes], list[int]]]):
    """Merges sorted runs (strings, common prefixes with the one before): yields (run, place, prefix).

    A loser tree. Every waiting head keeps its common prefix with the last winner: of two heads the
    one that shares more with it is the lesser, without a look at the strings; only equal prefixes
    are compared, from their end on. prefix: what the yielded string shares with the one before.
    """
    k = 1
    while k < len(runs):
        k *= 2
    place, shared = [0] * k, [0] * k
    ended = [i >= len(runs) or not runs[i][0] for i in range(k)]

    def beats(i: int, j: int) -> bool:
        """Whether i's head comes first; sets the loser's prefix to that with the winner."""
        if ended[i] or ended[j]:
            return not ended[i]
        if shared[i] != shared[j]:
            return shared[i] > shared[j]  # the loser's prefix with the winner is its own still
        a, b = runs[i][0][place[i]], runs[j][0][place[j]]
        c = common(a, b, shared[i])
        first = a[c : c + 1] < b[c : c + 1] or (a[c : c + 1] == b[c : c + 1] and i < j)
        shared[j if first else i] = c
        return first

    lost = [0] * k
    level = list(range(k))
    width = k
    while width > 1:
        width //= 2
        new = []
        for t in range(width):
            i, j = level[2 * t], level[2 * t + 1]
            first = beats(i, j)
            lost[width + t] = j if first else i
            new.append(i if first else j)
        level = new
    win, prefix = level[0], 0
    while not ended[win]:
        yield win, place[win], prefix
        place[win] += 1
        if place[win] == len(runs[win][0]):
            ended[win] = True
        else:
            shared[win] = runs[win][1][place[win]]
        t = (win + k) // 2
        while t:
            if beats(lost[t], win):
                win, lost[t] = lost[t], win
            t //= 2
        prefix = shared[win]


def shared_windows(prefix: list[int], sizes: np.ndarray, lefts: list[bytes]) -> np.ndarray:
    """For records in merged order and each s, whether another record has the window that starts s bytes before the anchor.

    prefix: each suffix's common prefix with the one before, as the merge knows it; sizes: the suffixes'
    lengths; lefts: what precedes them. A stretch of the order with prefixes of 200 - s and more is one
    part; so is, with the bytes before sorted from their ends, one with common ends of s and more.
    """
    n = len(lefts)
    out = np.zeros((n, PLACES), bool)
    held = np.array(prefix, np.int16)
    held[0] = 0
    lo, hi = LENGTH - sizes, np.array([len(x) for x in lefts], np.int64)
    ends = [x[::-1] for x in lefts]
    order = np.array(sorted(range(n), key=ends.__getitem__))
    flat = np.frombuffer(b"".join(ends[i].ljust(PLACES - 1, b"\0") for i in order), np.uint8).reshape(n, PLACES - 1)
    same = np.zeros(n, np.int16)
    if n > 1:
        differ = flat[1:] != flat[:-1]
        same[1:] = np.minimum(np.where(differ.any(1), differ.argmax(1), PLACES - 1), np.minimum(hi[order][1:], hi[order][:-1]))
    part = np.zeros(n, np.int64)
    for s in range(PLACES):
        cut = held < LENGTH - s
        ok = np.flatnonzero((lo <= s) & (s <= hi) & ~(cut & np.r_[cut[1:], True]))  # alone in its stretch: none shares it
        if len(ok) < 2:
            continue
        part[order] = np.cumsum(same < s)
        key = np.cumsum(cut)[ok] * (n + 1) + part[ok]
        by = np.argsort(key, kind="stable")
        equal = key[by][1:] == key[by][:-1]
        out[ok[by[1:][equal]], s] = True
        out[ok[by[:-1][equal]], s] = True
    return out


def _empty(*types: str) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return pa.table({n: pa.array([], kinds[t]) for n, t in (x.split() for x in types)})


def sorted_runs(chunk: pa.Table, marks: pa.Table, bits: int, wide: int) -> pa.Table:
    """Step 2: (q, chunk, hot, data), the chunk's records whose core repeats, in sorted runs by the core's leading bits.

    For hot cores, the distinct hashes of their windows by their own leading bits, and whether each occurs twice here.
    """
    if not chunk.num_rows:
        return _empty("q long", "chunk long", "hot long", "data binary")
    c = Chunk(chunk)
    r, _ = c.distinct()
    cores, back = np.unique(r.core, return_inverse=True)
    p, cut = _parts(cores, bits)
    states = {x: d for x, d in zip(marks["p"].to_pylist(), marks["data"].to_pylist())}
    state = np.frombuffer(b"".join(states[x] for x in p.tolist()), np.uint8)[back]
    pick = np.flatnonzero(state == 1)
    runs: dict[int, list[tuple[bytes, bytes, int]]] = {}
    q = (r.core[pick] >> np.uint64(64 - wide)).tolist()
    for part, a, lo, hi, name in zip(q, *(x[pick].tolist() for x in (r.at, r.lo, r.hi, r.name))):
        runs.setdefault(part, []).append((c.bytes[a : a + LENGTH - lo], c.bytes[a - hi : a], name))
    rows = []
    for part, run in runs.items():
        run.sort()
        rows.append((part, 0, encode(run)))
    pick = np.flatnonzero(state == 2)
    if len(pick):
        n = r.hi[pick] - r.lo[pick] + 1
        start = np.repeat(r.at[pick] - r.hi[pick] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        h, twice = np.unique(c.windows(np.sort(start)), return_counts=True)
        for part, s, e in (lambda q, cut: zip(q.tolist(), cut, cut[1:]))(*_parts(h, wide)):
            rows.append((part, 1, h[s:e].tobytes() + (twice[s:e] > 1).astype(np.uint8).tobytes()))
    return pa.table({
        "q": pa.array([x[0] for x in rows], pa.int64()), "chunk": pa.array([chunk["chunk"][0].as_py()] * len(rows), pa.int64()),
        "hot": pa.array([x[1] for x in rows], pa.int64()), "data": pa.array([x[2] for x in rows], pa.binary()),
    })


def places_of(rows: pa.Table, batch: int = BATCH) -> pa.Table:
    """Step 3: (chunk, hot, data), for each run its records' names and the windows that others have too.

    At most `batch` records and those of one core, HOT at most, are compared together. For hot
    windows: the hashes that several chunks sent, or one that has it twice.
    """
    of = rows["hot"].to_pylist()
    chunks, blobs = rows["chunk"].to_pylist(), rows["data"].to_pylist()
    merged = [i for i, hot in enumerate(of) if not hot]
    runs = [decode(blobs[i]) for i in merged]
    out = [np.zeros((len(r[0]), -(-PLACES // 8)), np.uint8) for r in runs]
    held: list[tuple[int, int]] = []
    prefixes: list[int] = []

    def settle() -> None:
        if len(held) > 1:
            sizes = np.array([len(runs[i][0][j]) for i, j in held])
            bits = np.packbits(shared_windows(prefixes, sizes, [runs[i][2][j] for i, j in held]), axis=1)
            for (i, j), b in zip(held, bits):
                out[i][j] = b
        held.clear()
        prefixes.clear()

    for i, j, prefix in merge([(r[0], r[1]) for r in runs]):
        if prefix < CORE and len(held) >= batch:  # another core: no window can be equal across
            settle()
        held.append((i, j))
        prefixes.append(prefix)
    settle()
    sent = []
    for i, r, o in zip(merged, runs, out):
        some = o.any(1)
        if some.any():
            sent.append((chunks[i], 0, int(some.sum()).to_bytes(4, "little") + r[3][some].tobytes() + o[some].tobytes()))
    hot = [(i, *(np.frombuffer(b, t, len(b) // 9, at) for t, at in (("<u8", 0), (np.uint8, len(b) // 9 * 8)))) for i, b in enumerate(blobs) if of[i]]
    if hot:
        known, back, n = np.unique(np.concatenate([h for _, h, _ in hot]), return_inverse=True, return_counts=True)
        more = n > 1
        np.logical_or.at(more, back, np.concatenate([t for *_, t in hot]) > 0)
        for i, h, _ in hot:
            own = h[more[np.searchsorted(known, h)]]
            if len(own):
                sent.append((chunks[i], 1, own.tobytes()))
    return pa.table({"chunk": pa.array([x[0] for x in sent], pa.int64()), "hot": pa.array([x[1] for x in sent], pa.int64()), "data": pa.array([x[2] for x in sent], pa.binary())})


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def covered(c: Chunk, places: pa.Table) -> np.ndarray:
    """Which bytes of the chunk go: those in windows at `places`, and in records that the chunk itself has twice."""
    width = -(-PLACES // 8)
    name, bits, hot = [np.zeros(0, np.uint64)], [np.zeros((0, width), np.uint8)], [np.zeros(0, np.uint64)]
    for kind, x in zip(places["hot"].to_pylist(), places["data"].to_pylist()):
        if kind:
            hot.append(np.frombuffer(x, np.uint64))
            continue
        n = int.from_bytes(x[:4], "little")
        name.append(np.frombuffer(x, np.uint64, n, 4))
        bits.append(np.frombuffer(x, np.uint8, n * width, 4 + 8 * n).reshape(n, width))
    r, again = c.distinct()
    own = np.sort(r.name[again])
    name, bits, hot = np.concatenate(name), np.concatenate(bits), np.sort(np.concatenate(hot))
    order = np.argsort(name)
    name, bits = name[order], bits[order]
    starts = np.zeros(len(c.data) + 1, bool)

    def found(x: np.ndarray, among: np.ndarray) -> np.ndarray:
        return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x if len(among) else np.zeros(len(x), bool)

    for x in c.steps():
        for i in np.flatnonzero(found(x.name, own)).tolist():
            starts[x.at[i] - x.hi[i] : x.at[i] - x.lo[i] + 1] = True
        some = np.flatnonzero(found(x.name, name))
        for i in range(0, len(some), 1 << 14):
            few = some[i : i + (1 << 14)]
            row, place = np.nonzero(np.unpackbits(bits[np.searchsorted(name, x.name[few])], axis=1, count=PLACES))
            starts[x.at[few][row] - place] = True
    if len(hot):
        for base in range(0, len(c.data) - LENGTH + 1, STEP):
            w = base + np.flatnonzero(c.usable[base : base + STEP])
            starts[w[found(c.windows(w), hot)]] = True
    at = np.flatnonzero(starts)
    change = np.zeros(len(c.data) + 1, np.int32)
    change[at] += 1
    change[at + LENGTH] -= 1
    return np.cumsum(change[:-1], dtype=np.int32) > 0


def removed(chunk: pa.Table, places: pa.Table, keep_text: bool = False) -> pa.Table:
    """Step 4: a row for each document, with what stays of it once the windows at `places` are removed."""
    names, types = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], [pa.int64()] * 4 + [pa.string()]
    if keep_text:
        names, types = [*names, "kept"], [*types, pa.binary()]
    if not chunk.num_rows:
        return pa.table([pa.array([], t) for t in types], names)
    c = Chunk(chunk)
    gone = covered(c, places)
    texts = chunk["text"].cast(pa.large_binary())
    copies = dict(zip(*(x.to_pylist() for x in (lambda v: (v.field("values"), v.field("counts")))(pc.value_counts(texts)))))
    result = {}
    for t, s, e in zip(c.texts, c.starts.tolist(), c.ends.tolist()):
        g = gone[s:e] if copies[t] == 1 else np.ones(e - s, bool)  # a text that is here twice repeats as a whole
        n = int(g.sum())
        kept = t if not n else c.data[s:e][~g].tobytes()
        spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if n else 0
        result[t] = (e - s, n, spans, hashlib.sha256(kept).hexdigest(), *([kept] if keep_text else []))
    rows = [(d, *result[t]) for d, t in zip(chunk["doc_id"].to_pylist(), texts.to_pylist())]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def dedup(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of docs(doc_id, text).

    Every byte is removed that a LENGTH-byte string covers which also starts anywhere else, in this
    or another document; null texts count as empty, and texts under LENGTH bytes stay whole, without a
    shuffle. keep_text: also the remaining bytes, `kept` (their characters may be cut). Repeated rows stay as
    rows, and repeat each other; rows without a doc_id too; other columns are ignored; an empty table
    gives an empty one. Strings are compared by their bytes; only those of a core with over HOT records by a
    64-bit hash of all 200.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = F.octet_length("text")
    short = base.where(size < LENGTH).select(
        "doc_id", size.cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"), *([F.encode("text", "UTF-8").alias("kept")] if keep_text else []),
    )
    base = base.where(size >= LENGTH)
    total = base.agg(F.sum(size.cast("long"))).first()[0] or 0
    chunks = max(1, math.ceil(total / CHUNK))
    bits = max(5, math.ceil(math.log2(max(1, total * 6 / (PLACES / 2) / HASHES))))
    wide = max(5, math.ceil(math.log2(max(1, total * 5 / RECORDS))))
    # The place of the row's block in its file parts even rows that are equal throughout.
    spot = F.xxhash64("doc_id", "text", F.input_file_name(), F.input_file_block_start())
    chunked = base.withColumn("chunk", F.pmod(spot, F.lit(chunks)).cast("long")).repartition(chunks, "chunk")
    by_chunk = chunked.groupBy("chunk")
    sent = by_chunk.applyInArrow(lambda t: hashes_of(t, bits), "p long, chunk long, data binary")
    marks = sent.groupBy("p").applyInArrow(lambda t: repeated(t), "chunk long, p long, data binary")
    runs = by_chunk.cogroup(marks.groupBy("chunk")).applyInArrow(lambda a, b: sorted_runs(a, b, bits, wide), "q long, chunk long, hot long, data binary")
    places = runs.groupBy("q").applyInArrow(lambda t: places_of(t), "chunk long, hot long, data binary")
    schema = RESULT + (", kept binary" if keep_text else "")
    return by_chunk.cogroup(places.groupBy("chunk")).applyInArrow(lambda a, b: removed(a, b, keep_text), schema).union(short)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's row for each document, by dedup() over the whole table."""
    return dedup(table(spark, sf_dir, "documents"))
