"""SimHash near-duplicates by Golay-code fuzzy hashing.

The 64 bits are four segments of 16. Two fingerprints that differ in three bits at most have, in
the ring of segments, some segment X without error whose next segment Y has one error at most:
if only one segment is whole, the others have one error each; if two are, the errors of the other
two are 1 and 2 at most, and one of the four ring steps meets the condition; if three or four are,
some whole segment is followed by a whole one. So the key (X, codeword index of Y) of the one and
the keys (X, codeword indices of Y with up to one bit turned) of the other meet. The perfect binary
Golay code (23, 12) gives every word one nearest codeword, within three bits; a 16-bit segment is a
word with seven leading zeros, and its 17 nearby words decode to about five indices.

The near-duplicate stage (first_of_each) has a setting of its own, for texts whose five-word shingles have a
similarity of 0.8 or more. One word in about 45 may differ then, too much for three bits of shingles; so
the SimHash is of the distinct words, with TABLES independent groups of 39 bits (in as many hashes of 64). A group's key is 16 of them
as they are and a codeword index of a whole 23-bit Golay word: words that differ in two bits at most have a
nearby codeword in common, so each has about six keys. A pair that meets is verified by its shingles.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import by_key, components, hex16, remove, table, unused, written

SEED = 42
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, the generator of the (23, 12) code.
GENERATOR = 0xC75
STEP = 1 << 15
#: The stage's groups of bits, plain bits of a key, words of a shingle, least similarity, and the bits of 128 others by which a pair may differ.
TABLES, PLAIN, WIDTH, SIMILAR, APART = 8, 16, 5, 0.8, 18
#: Rows of one key that are looked at together, and neighbours by order that a row is compared with.
BLOCK, BESIDE = 1 << 15, 8
#: Keys with more rows are looked at one by one, in steps, when their rows are compared in full.
FEW = 32
#: A share of 1 / HOT of all ends of pairs makes an id hot.
HOT = 1000
#: Rows and bytes of text that are compared in full at a time, about; and columns of their matrix.
TILE, TILE_BYTES, COLUMNS = 1 << 11, 1 << 25, 1 << 11
#: Pairs that are held before they are brought down to edges.
PAIRS = 1 << 20


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of the text's shingles of `width` lower-cased words, repeats included.

    Fewer words: their whole sequence is the one shingle. None: 0. Shingles are hashed in steps, so
    a very long text needs no more memory than its words.
    """
    words = (text or "").encode().lower().split()  # bytes: A-Z alone are lowered, white space is 20 and 09-0D
    if not words:
        return 0
    if len(words) < width:
        words = [b" ".join(words)]
        width = 1
    n, digest = len(words) - width + 1, xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        part = words[at : at + STEP + width - 1]
        runs = zip(*(part[i:] for i in range(width)))
        h = np.fromiter((digest(b" ".join(r), SEED) for r in runs), ">u8", min(STEP, n - at))
        votes += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


@cache
def _errors() -> tuple[np.ndarray, np.ndarray]:
    """For each 11-bit syndrome the error of weight <= 3; the syndromes of the 2^16 short words."""

    def syndrome(v: int) -> int:
        for b in range(22, 10, -1):
            if v >> b & 1:
                v ^= GENERATOR << (b - 11)
        return v

    unit = [syndrome(1 << b) for b in range(23)]
    error = np.zeros(2048, np.int64)
    for w in (1, 2, 3):
        for bits in combinations(range(23), w):
            s = e = 0
            for b in bits:
                s, e = s ^ unit[b], e | 1 << b
            error[s] = e
    syn = np.zeros(1 << 16, np.int64)
    for b in range(16):
        syn[1 << b : 2 << b] = syn[: 1 << b] ^ unit[b]
    return error, syn


def decode(word: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each word below 2^16."""
    error, syn = _errors()
    return (word ^ error[syn[word]]) >> 11


@cache
def _nearby() -> list[np.ndarray]:
    """For each word below 2^16, the distinct codeword indices of itself and its 16 neighbours."""
    words = np.arange(1 << 16)
    all_ = np.stack([decode(words), *(decode(words ^ (1 << b)) for b in range(16))], 1)
    all_.sort(1)
    fresh = np.concatenate([np.ones((1 << 16, 1), bool), all_[:, 1:] != all_[:, :-1]], 1)
    return [r[f] for r, f in zip(all_, fresh)]


def keys(fp: int) -> tuple[list[int], list[int]]:
    """(index keys, probe keys) of a fingerprint: one and about five for each step of the ring."""
    seg = [fp >> 48 & 0xFFFF, fp >> 32 & 0xFFFF, fp >> 16 & 0xFFFF, fp & 0xFFFF]
    near = _nearby()
    index, probe = [], []
    for i in range(4):
        x, y = i << 28 | seg[i] << 12, seg[(i + 1) % 4]
        index.append(x | int(decode(np.array([y]))[0]))
        probe += [x | int(k) for k in near[y]]
    return index, probe


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of each row of docs(doc_id, text)."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints fps(fp) that differ in three bits at most."""

    def run(frames):
        for f in frames:
            k, at, role = [], [], []
            for i, fp in enumerate(f["fp"].tolist()):
                index, probe = keys(fp & (1 << 64) - 1)
                k += index + probe
                at += [i] * (len(index) + len(probe))
                role += [True] * len(index) + [False] * len(probe)
            yield pd.DataFrame({"k": k, "index": role, "fp": f["fp"].values[at]})

    keyed = fps.select("fp").mapInPandas(run, "k long, index boolean, fp long")
    known = keyed.where("index").select("k", F.col("fp").alias("a"))
    asked = keyed.where("not index").select("k", F.col("fp").alias("b"))
    # Each of two fingerprints probes for the other; the probe of the lower one suffices.
    hit = (F.col("b") < F.col("a")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 3)
    return known.join(asked, "k").where(hit).select("a", "b")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of each row of docs(doc_id, text): fingerprints within three bits linked.

    Distinct fingerprints are the nodes, so copies are never paired, and a doc_id with two texts joins
    nothing; the links between different fingerprints are all found. Null texts count as empty:
    fingerprint 0. Repeated rows stay as rows. Rows without a doc_id are linked like others, and name no
    component unless nothing else does (component_id null). Other columns are ignored.
    """
    own = written(fingerprints(docs))
    nodes = written(own.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")))
    found = written(links(nodes))
    linked = components(found).join(nodes.select(F.col("fp").alias("node"), "id"), "node")
    least = linked.groupBy("root").agg(F.min("id").alias("least"))
    named = linked.join(least, "root").select(F.col("node").alias("fp"), "least")
    side = nodes.join(named, "fp", "left").select("fp", F.coalesce("least", "id").alias("component_id"), "n")
    return by_key(own, written(side), "fp", "n").select("doc_id", "fp", "component_id")


@cache
def _lanes() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(23)
    return r.integers(1, 1 << 63, TABLES, dtype=np.uint64) | np.uint64(1), r.integers(1, 1 << 63, TABLES, dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def sketch(text: str | None) -> np.ndarray:
    """SimHashes (TABLES of 64 bits) of the text's distinct lower-cased words; zeros without a word."""
    words = set(words_of(text))
    if not words:
        return np.zeros(TABLES, np.uint64)
    h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    h.sort()
    times, plus = _lanes()
    votes = np.zeros(TABLES * 64, np.int64)
    for at in range(0, len(h), STEP):
        x = h[at : at + STEP, None] * times + plus
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        votes += np.unpackbits(x.view(np.uint8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(votes * 2 > len(h)).view(np.uint64)


@cache
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """The syndromes of the low 16 and of the high 7 bits of a 23-bit word."""
    _, low = _errors()
    unit = []
    for b in range(16, 23):
        v = 1 << b
        for k in range(22, 10, -1):
            if v >> k & 1:
                v ^= GENERATOR << (k - 11)
        unit.append(v)
    high = np.zeros(1 << 7, np.int64)
    for b in range(7):
        high[1 << b : 2 << b] = high[: 1 << b] ^ unit[b]
    return low, high


def codes(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 23-bit words the codeword indices of themselves and their 23 neighbours, sorted, and which are the first of equals."""
    error, _ = _errors()
    low, high = _syndromes()
    near = word[..., None] ^ np.concatenate([[0], 1 << np.arange(23)])
    index = (near ^ error[low[near & 0xFFFF] ^ high[near >> 16]]) >> 11
    index.sort(-1)
    fresh = np.ones(index.shape, bool)
    fresh[..., 1:] = index[..., 1:] != index[..., :-1]
    return index, fresh


def postings(sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of the sketches (n, TABLES), keys, 128 check bits): about six of each table.

    A key has the table's number, its plain bits and a nearby codeword; its check is the next two tables' hashes.
    """
    own = sketches.view(np.int64)
    index, fresh = codes(own & 0x7FFFFF)
    plain = (own >> 23) & ((1 << PLAIN) - 1)
    key = ((np.arange(TABLES) << (PLAIN + 12)) | plain << 12)[..., None] | index
    row, t, _ = np.nonzero(fresh)
    return row, key[fresh], np.stack([sketches[row, (t + 1) % TABLES], sketches[row, (t + 2) % TABLES]], 1)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def pairs_of(key: np.ndarray, ids: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): of rows in order of (key, check), each with the middle of its key's rows that are near it.

    The middle is the row nearest to the majority of the check bits: where copies differ from one original
    in different places, the original. Rows that differ from it in over APART bits have a middle of their own,
    and so on; once one has no row near it, those left are compared with the BESIDE before them in order.
    So a row is in one pair for each of its keys, however many rows a key has. Near rows that this leaves unconnected
    are compared afterwards, each with each: unmet(), alike_in().
    """
    a, b = [np.zeros(0, ids.dtype)], [np.zeros(0, ids.dtype)]
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    size = np.diff(cut)
    two = cut[:-1][size == 2]
    two = two[_apart(check[two], check[two + 1]) <= APART]
    a.append(ids[two])
    b.append(ids[two + 1])
    for s, e in zip(cut[:-1][size > 2].tolist(), cut[1:][size > 2].tolist()):
        left = np.arange(s, e)
        while len(left) > 1:
            c = check[left]
            most = np.packbits(np.unpackbits(c.view(np.uint8).reshape(len(c), -1), axis=1).sum(0, dtype=np.int64) * 2 > len(c))
            m = int(_apart(c, most.view(np.uint64)).argmin())
            near = _apart(c, c[m]) <= APART
            if near.sum() < 2:
                break
            a.append(ids[left[near]])
            b.append(np.full(near.sum(), ids[left[m]]))
            left = left[~near]
        best, at = np.full(len(left), APART + 1), np.zeros(len(left), np.int64)
        for lag in range(1, min(BESIDE, len(left) - 1) + 1):
            apart = _apart(check[left[lag:]], check[left[:-lag]])
            less = np.flatnonzero(apart < best[lag:]) + lag
            best[less], at[less] = apart[less - lag], less - lag
        hit = np.flatnonzero(best <= APART)
        a.append(ids[left[hit]])
        b.append(ids[left[at[hit]]])
    a, b = np.concatenate(a), np.concatenate(b)
    return np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]


def apart_of(key: np.ndarray, ids: np.ndarray, check: np.ndarray, root: np.ndarray):
    """(a, b) in parts: all pairs of rows with the same key, of rows in order of it, that are near and have different roots."""

    def take(i, j):
        hit = (root[i] != root[j]) & (ids[i] != ids[j])
        i, j = i[hit], j[hit]
        hit = _apart(check[i], check[j]) <= APART
        one, two = ids[i[hit]], ids[j[hit]]
        return np.minimum(one, two), np.maximum(one, two)

    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    size = np.diff(cut)
    end = np.repeat(cut[1:], size)
    few = np.flatnonzero(np.repeat(size <= FEW, size))
    for lag in range(1, FEW):
        few = few[few + lag < end[few]]
        if not len(few):
            break
        yield take(few, few + lag)
    for s, e in zip(cut[:-1][size > FEW].tolist(), cut[1:][size > FEW].tolist()):
        if (root[s:e] == root[s]).all():
            continue
        step = max(1, STEP // (e - s))
        for i in range(s, e, step):
            x, y = np.meshgrid(np.arange(i, min(i + step, e)), np.arange(i, e), indexing="ij")
            later = y > x
            yield take(x[later], y[later])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, least id) that connect what the edges (a, b) connect, one for each id but the least."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    up = np.arange(len(ids))
    while True:
        low = up.copy()
        least = np.minimum(up[a], up[b])
        for x in (a, b, up[a], up[b]):
            np.minimum.at(low, x, least)
        low = low[low]
        if (low == up).all():
            own = up != np.arange(len(ids))
            return ids[own], ids[up[own]]
        up = low


def unmet(keyed: DataFrame) -> DataFrame:
    """Edges (a, b) of ids that connect, key by key, the pairs that apart_of() finds in keyed(k, id, c, d, root): what met() left out of keys whose rows it did not connect.

    A key gives one edge at most for each of its rows, however many pairs they make.
    """
    open_ = keyed.groupBy("k").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("k")

    def run(batches):
        held = []
        for b in _and_last(batches):
            if b is not None and b.num_rows:
                held.append([np.asarray(b.column(i).to_numpy(zero_copy_only=False)) for i in range(5)])
            if not held or (b is not None and (not b.num_rows or held[0][0][0] == held[-1][0][-1])):
                continue  # one key so far
            rows = [np.concatenate(x) for x in zip(*held)]
            end = len(rows[0]) if b is None else int(np.searchsorted(rows[0], rows[0][-1]))
            held = [[x[end:] for x in rows]] if b is not None else []
            found = [(rows[1][:0], rows[1][:0])]
            for part in apart_of(rows[0][:end], rows[1][:end], np.stack(rows[2:4], 1)[:end].view(np.uint64), rows[4][:end]):
                found.append(part)
                if sum(len(a) for a, _ in found[1:]) > PAIRS:
                    found = [forest(*map(np.concatenate, zip(*found)))]
            a, z = forest(*map(np.concatenate, zip(*found)))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(z)], ["a", "b"])

    ordered = keyed.join(open_, "k", "left_semi").select("k", "id", "c", "d", "root").repartition("k").sortWithinPartitions("k")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def met(keyed: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of ids that pairs_of() finds in keyed(k, id, c, d); a key over BLOCK rows is looked at by blocks."""

    def run(batches):
        held = None
        for b in _and_last(batches):
            rows = None if b is None else [np.asarray(b.column(i).to_numpy(zero_copy_only=False)) for i in range(4)]
            if held is not None and rows is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            elif rows is None:
                rows = held
            if rows is None or not len(rows[0]):
                continue
            # The last key may go on in the next batch.
            end = len(rows[0]) if b is None else int(np.searchsorted(rows[0], rows[0][-1]))
            if b is not None and len(rows[0]) - end > BLOCK:
                end = len(rows[0])
            held = [x[end:] for x in rows]
            if end:
                a, z = pairs_of(rows[0][:end], rows[1][:end], np.stack(rows[2:], 1)[:end].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(z)], ["a", "b"])

    ordered = keyed.repartition("k").sortWithinPartitions("k", "c", "d", "id")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def _and_last(batches):
    yield from batches
    yield None


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of the text's runs of WIDTH words (of fewer words, all of them), in order."""
    words = words_of(text)
    n = max(1, len(words) - WIDTH + 1) if words else 0
    h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + WIDTH]), SEED) for i in range(n)), np.uint64, n)
    return np.unique(h)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is SIMILAR or more; two empty ones are alike."""
    if min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILAR * (len(a) + len(b) - both)


def dealt(ends: DataFrame, texts: DataFrame) -> DataFrame:
    """ends(id, a, b) with the text of each id. No task gets all ends of an id that many have.

    Ids with a share of 1 / HOT of the ends or more, HOT at most, are dealt over as many slots as they have such
    shares; their texts are copied to each slot, 2 * HOT copies at most in all.
    """
    least = ends.count() // HOT + 1
    sizes = ends.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    hot = F.broadcast(sizes.select("id", F.ceil(F.col("n") / least).cast("int").alias("slots")))
    slots = F.coalesce("slots", F.lit(1))
    asked = ends.join(hot, "id", "left").select("id", "a", "b", F.pmod(F.xxhash64("a", "b"), slots).cast("int").alias("slot"))
    copies = texts.join(hot, "id", "left").select("id", "text", F.explode(F.sequence(F.lit(0), slots - 1)).alias("slot"))
    return copies.join(asked.hint("merge"), ["id", "slot"]).select("id", "a", "b", "text")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts(id, text) are similar by their shingles; pairs is read several times."""
    ends = pairs.select(F.col("a").alias("id"), "a", "b").union(pairs.select(F.col("b").alias("id"), "a", "b"))
    sides = dealt(ends, texts).groupBy("a", "b")
    both = sides.agg(F.max(F.when(F.col("id") == F.col("a"), F.col("text"))).alias("ta"), F.max(F.when(F.col("id") == F.col("b"), F.col("text"))).alias("tb"))

    def run(batches):
        for x in batches:
            a, b = x.column("a").to_numpy(), x.column("b").to_numpy()
            held, keep = {}, []
            for i, j, s, t in zip(a.tolist(), b.tolist(), x.column("ta"), x.column("tb")):
                for k, one in ((i, s), (j, t)):
                    if k not in held:
                        held[k] = shingles(one.as_py())
                keep.append(similar(held[i], held[j]))
            keep = np.array(keep, bool)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def alike(ids: np.ndarray, root: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Edges of ids that connect all pairs of similar() sets with different roots, each compared with each.

    A set of which under SIMILAR occurs in others has no partner, so it goes first, and so on. The common elements of the
    rest are counted by a product of 0-1 matrices; elements of few sets, pair by pair. Rows of the most frequent
    root are not compared with each other.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    void = np.flatnonzero(size == 0)
    row = np.repeat(np.arange(len(sets)), size)
    item = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)[1]
    live = size > 0
    while True:
        here = live[row]
        row, item = row[here], item[here]
        here = np.bincount(item, minlength=1)[item] > 1
        now = live & (np.bincount(row[here], minlength=len(sets)) >= SIMILAR * size)
        if (now == live).all():
            break
        live = now
    row, item = row[here], item[here]
    rows = np.flatnonzero(live)
    kinds, kind, times = np.unique(root[rows], return_inverse=True, return_counts=True)
    left = np.flatnonzero(kind != times.argmax()) if len(rows) else rows
    a, b = [ids[void[1:]]], [ids[void[:-1]]]
    if len(left):
        place, mine = np.full(len(sets), -1), np.full(len(rows), -1)
        place[rows], mine[left] = np.arange(len(rows)), np.arange(len(left))
        df = np.bincount(item)
        order = np.lexsort((item, df[item] > FEW))
        row, item = place[row[order]], item[order]
        few = int(np.count_nonzero(df[item] <= FEW))
        both = np.zeros((len(left), len(rows)), np.float32)
        at = np.arange(few)
        for lag in range(1, FEW):
            at = at[at + lag < few]
            at = at[item[at] == item[at + lag]]
            if not len(at):
                break
            for i, j in ((row[at], row[at + lag]), (row[at + lag], row[at])):
                own = mine[i] >= 0
                np.add.at(both, (mine[i[own]], j[own]), np.float32(1))
        row, item = row[few:], np.cumsum(np.r_[0, item[few + 1 :] != item[few:-1]])[: len(item) - few]
        for at in range(0, int(item[-1]) + 1 if len(item) else 0, COLUMNS):
            s, e = np.searchsorted(item, [at, at + COLUMNS])
            x = np.zeros((len(rows), COLUMNS), np.float32)
            x[row[s:e], item[s:e] - at] = 1
            both += x[left] @ x.T
        n, m = size[rows[left]][:, None], size[rows][None]
        hit = (np.minimum(n, m) >= SIMILAR * np.maximum(n, m)) & (both >= SIMILAR * (n + m - both.astype(np.float64))) & (kind[left][:, None] != kind[None])
        i, j = np.nonzero(hit)
        a.append(ids[rows[left[i]]])
        b.append(ids[rows[j]])
    return forest(np.concatenate(a), np.concatenate(b))


def alike_in(groups: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all similar texts with different roots within each part of groups(part, id, root, text).

    A part with over TILE rows or TILE_BYTES of text is cut into slots, of which each two are compared in one task.
    """
    sizes = groups.groupBy("part").agg(F.greatest(F.count("*") / TILE, F.sum(F.octet_length("text")) / TILE_BYTES).alias("tiles"))
    sizes = sizes.where("tiles > 1").select("part", F.ceil(2 * F.col("tiles")).cast("int").alias("slots"))
    slot = F.pmod(F.xxhash64("id"), F.coalesce("slots", F.lit(1))).cast("int")
    cut = groups.join(F.broadcast(sizes), "part", "left").withColumn("slot", slot)
    others = F.when(F.col("slots").isNull(), F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("slots") - 1), lambda x: x != F.col("slot")))
    tiles = cut.select("part", "id", "root", "text", "slot", F.explode(others).alias("other"))
    tiles = tiles.select("part", F.least("slot", "other").alias("x"), F.greatest("slot", "other").alias("y"), "id", "root", "text")

    def run(t: pa.Table) -> pa.Table:
        sets = [shingles(x.as_py()) for x in t.column("text")]
        a, b = alike(t.column("id").to_numpy(), t.column("root").to_numpy(), sets)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return tiles.groupBy("part", "x", "y").applyInArrow(run, "a long, b long")


def near_classes(docs: DataFrame) -> DataFrame:
    """(id, doc_id, first) for each distinct (text, doc_id) of docs: id the text's hash, first the class's least doc_id.

    As text_classes() has it; rows without a doc_id are left out.
    """
    own = _with_id(docs).where("doc_id is not null").select("id", "doc_id").distinct()
    return by_key(own, written(text_classes(docs).select("id", "first", "n")), "id", "n").select("id", "doc_id", "first")


def text_classes(docs: DataFrame) -> DataFrame:
    """(id, least, first, n) for each text of docs: id its hash, least its least doc_id, first that of its class, n its rows.

    A class: texts connected by links of five-word similarity 0.8 or more, as the keys find and the shingles
    verify them. Texts are taken as equal by their 64-bit hash. Null texts count as empty; texts
    without a word are alike. Rows without a doc_id are left out.
    """
    base = _with_id(docs).where("doc_id is not null")

    def run(batches):
        for b in batches:
            # Of copies in a batch one is enough, as of all copies.
            _, first, back = np.unique(b.column("id").to_numpy(), return_index=True, return_inverse=True)
            made = [sketch(t.as_py()).tobytes() for t in b.column("text").take(pa.array(first))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("id"), pa.array([made[i] for i in back], pa.binary())], ["doc_id", "id", "s"])

    own = written(base.mapInArrow(run, "doc_id long, id long, s binary"))
    nodes = own.dropDuplicates(["id"]).select("id", "s")

    def post(batches):
        for b in batches:
            if b.num_rows:
                s = np.frombuffer(b"".join(b.column("s").to_pylist()), np.uint64).reshape(-1, TABLES)
                row, k, check = postings(s)
                cols = [pa.array(k), b.column("id").take(pa.array(row)), *map(pa.array, check.view(np.int64).T)]
                if "root" in b.schema.names:
                    cols.append(b.column("root").take(pa.array(row)))
                yield pa.RecordBatch.from_arrays(cols, ["k", "id", "c", "d", "root"][: len(cols)])

    pairs = written(met(nodes.mapInArrow(post, "k long, id long, c long, d long")))
    ends = pairs.union(pairs.select("b", "a")).toDF("id", "other")
    active = written(ends.groupBy("id").agg(F.count("*").alias("n")))
    texts = base.groupBy("id").agg(F.first("text").alias("text"))  # copies go before the shuffle
    texts = written(texts.join(active.select("id").hint("merge"), "id"))
    # First everyone with the partner that most others have too, then only what that left apart.
    most = by_key(ends, active.toDF("other", "n"), "other", "n").groupBy("id").agg(F.max(F.struct("n", "other"))["other"].alias("other"))
    most = written(most.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct())
    first = written(verified(most, texts))
    top = written(active.join(components(first).toDF("id", "root"), "id", "left").select("id", F.coalesce("root", "id").alias("root"), "n"))
    rest = by_key(pairs, top.toDF("a", "ra", "n"), "a", "n").drop("n")
    rest = written(by_key(rest, top.toDF("b", "rb", "n"), "b", "n").where("ra != rb").select("a", "b"))
    every = written(first.union(verified(rest, texts)))
    # What is still apart: texts that near pairs of a key connect, whatever its middle is, each with each.
    sides = nodes.join(components(every).toDF("id", "root"), "id", "left").select("id", "s", F.coalesce("root", "id").alias("root"))
    last = written(unmet(sides.mapInArrow(post, "k long, id long, c long, d long, root long")))
    parts = written(components(last).toDF("id", "part").join(sides.select("id", "root").hint("merge"), "id"))
    others = written(base.groupBy("id").agg(F.first("text").alias("text")).join(parts.hint("merge"), "id"))
    whole = written(every.union(alike_in(others)))
    roots = components(whole)
    for done in (pairs, active, texts, most, first, top, rest, every, last, parts, others, whole):
        remove(done)
    least = own.groupBy("id").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    linked = least.join(roots.withColumnRenamed("node", "id"), "id")
    firsts = linked.groupBy("root").agg(F.min("least").alias("first"))
    named = linked.join(firsts, "root").select("id", "first")
    return least.join(named, "id", "left").select("id", "least", F.coalesce("first", "least").alias("first"), "n")


def _with_id(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("id"), text.alias("text"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """Of each class of text_classes() the row with the least doc_id; of repeated rows of that text and doc_id one.

    Rows without a doc_id can't be told apart: they all stay. Columns stay as they are. The texts move once for
    the comparison and once for the choice, however many there are.
    """
    i, d = unused(docs, "id", "doc")
    kept = written(text_classes(docs).where("least = first").select(F.col("id").alias(i), F.col("first").alias(d)))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.where("doc_id is not null").withColumns({i: F.xxhash64(text), d: F.col("doc_id").cast("long")})
    out = named.dropDuplicates([i, d]).join(kept.hint("merge"), [i, d], "left_semi")
    return out.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def op3_golay_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's row for each document, by classes() over the whole table."""
    return classes(table(spark, sf_dir, "documents")).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
