"""Repeated strings held against brute force, through the steps alone and through Spark."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from skein.llm import suffix_dedup as S


def brute(texts):
    """(bytes, bytes removed, runs of them, digest of the rest) of each text."""
    seen = {}
    for t in texts:
        for i in range(len(t) - S.LENGTH + 1):
            seen[t[i : i + S.LENGTH]] = seen.get(t[i : i + S.LENGTH], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - S.LENGTH + 1):
            if seen[t[i : i + S.LENGTH]] > 1:
                gone[i : i + S.LENGTH] = True
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), int((gone[:-1] & ~gone[1:]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def by_steps(texts, chunks, hot=S.HOT, batch=S.BATCH, seed=0):
    """The four steps without Spark, the texts dealt to `chunks` chunks."""
    r, own, bits = random.Random(seed), {}, 5
    for d, t in enumerate(texts):
        own.setdefault(r.randrange(chunks), []).append((d, t))
    tables = {c: pa.table({"doc_id": [x[0] for x in v], "text": pa.array([x[1] for x in v], pa.binary()), "chunk": [c] * len(v)}) for c, v in own.items()}
    at = lambda t, k, v: t.filter(pc.equal(t[k], v))
    sent = pa.concat_tables(S.hashes_of(t, bits) for t in tables.values())
    marks = pa.concat_tables(S.repeated(at(sent, "p", p), hot) for p in set(sent["p"].to_pylist()))
    runs = pa.concat_tables(S.sorted_runs(t, at(marks, "chunk", c), bits, bits) for c, t in tables.items())
    places = [S.places_of(at(runs, "q", q), batch) for q in set(runs["q"].to_pylist())]
    places = pa.concat_tables([S._empty("chunk long", "hot long", "data binary"), *places])
    got = {}
    for c, t in tables.items():
        for row in S.removed(t, at(places, "chunk", c)).to_pylist():
            got[row["doc_id"]] = tuple(row[k] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256"))
    return [got[d] for d in range(len(texts))]


def texts_of(seed):
    r = random.Random(seed)
    alphabet = r.choice([b"ab", b"abcdefghij klmnop", b"a"])
    word = lambda n: bytes(r.choices(alphabet, k=n))
    pool = [word(r.randint(50, 700)) for _ in range(6)]
    texts = []
    for _ in range(r.randint(2, 20)):
        t = b""
        for _ in range(r.randint(1, 6)):
            p = r.choice(pool)
            i = r.randrange(len(p))
            t += p[i : r.randint(i, len(p))] if r.random() < 0.5 else word(r.randint(0, 300))
        texts.append(t)
    return [t for t in texts + texts[:2] if len(t) >= S.LENGTH]


@pytest.mark.parametrize("seed", range(8))
def test_steps_give_what_brute_force_gives(seed):
    texts = texts_of(seed)
    want = brute(texts)
    for how in ({"chunks": 4}, {"chunks": 1}, {"chunks": 5, "hot": 1, "batch": 3}, {"chunks": 5, "hot": 3}, {"chunks": 40, "batch": 4}):
        assert by_steps(texts, **how) == want


def test_steps_within_long_texts(monkeypatch):
    monkeypatch.setattr(S, "STEP", 512)  # texts of many steps
    S._powers.cache_clear()
    texts = [t + u for t, u in zip(texts_of(1), texts_of(4))] * 2
    assert by_steps(texts, 3) == by_steps(texts, 3, hot=1) == brute(texts)


def test_one_string_in_many_contexts():
    r = random.Random(9)
    word = lambda n: bytes(r.choices(b"abcdefgh ", k=n))
    common, edge = word(230), word(150)
    texts = [word(60) + common + word(60) for _ in range(1500)] + [word(60) + edge + word(60) for _ in range(300)]
    got = by_steps(texts, 12)
    assert got == by_steps(texts, 12, hot=100) == brute(texts)


def test_dedup_in_spark(spark):
    r = random.Random(3)
    prose = lambda n: " ".join("".join(r.choices("abcdefghij", k=5)) for _ in range(n))
    common = prose(60)
    texts = [prose(80) + common + prose(20), common, "é" + common[3:] + common, None, "", prose(10), common, common, prose(3000)]
    rows = [(None if i == 1 else 7 if i > 5 else i, t, f"t{i}", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, chunk string, size int")
    got = sorted(tuple(x[k] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for x in S.dedup(df).collect())
    assert got == sorted(brute([(t or "").encode() for t in texts]))
    assert S.dedup(df.limit(0)).count() == 0
    kept = {bytes(x.kept) for x in S.dedup(df, keep_text=True).collect()}
    assert b"" in kept and texts[5].encode() in kept
