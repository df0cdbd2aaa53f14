"""The attention model: long texts, held-out labels, and gradients against differences."""

import random
import zlib

import numpy as np

from skein.llm import quality as Q


def prose(r, n):
    return " ".join("".join(r.choices("abcdefghijklmnoprstu", k=r.randint(2, 9))) for _ in range(n)) + "."


def junk(r, n):
    return " ".join(r.choice(["$$$", "BUY", "now!!!", "1234", "click|here", "<<"]) for _ in range(n))


def test_long_texts_score_as_in_one_piece():
    r = random.Random(1)
    model = Q.Attention.new(Q.FEATURES)
    text = (prose(r, 900) + junk(r, 500)).encode()
    text = text[: len(text) // (4 * Q.PASSAGE) * 4 * Q.PASSAGE]
    parts = [Q.passages([text[i : i + 4 * Q.PASSAGE]])[0] for i in range(0, len(text), 4 * Q.PASSAGE)]
    x = np.concatenate(parts)
    want = model.forward(x, np.array([len(x)]))[0][0]
    assert abs(model.long(text, step=4) - want) < 1e-5
    got = model.score([None, text.decode(), "", "ab"], step=4)
    assert abs(got[1] - want) < 1e-5 and got[0] == got[2] and ((got > 0) & (got < 1)).all()


def test_gradients():
    r = np.random.default_rng(2)
    model = Q.Attention.new(5, hidden=4, gate=3)
    for n in model.NAMES:
        setattr(model, n, getattr(model, n).astype(float))
    x, count = r.standard_normal((9, 5)), np.array([2, 3, 4])
    y, weight = np.array([0.0, 1.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        p = model.forward(x, count)[0]
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum()

    g = model.gradients(x, count, y, weight)
    for n in model.NAMES:
        v = getattr(model, n)
        for at in list(np.ndindex(v.shape))[:6]:
            old = v[at]
            v[at] = old + 1e-6
            up = loss()
            v[at] = old - 1e-6
            down = loss()
            v[at] = old
            assert abs((up - down) / 2e-6 - g[n][at]) < 1e-4


def test_held_out_labels(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(500):
        good = r.random() < 0.5
        text = prose(r, r.randint(20, 300)) if good else prose(r, r.randint(0, 100)) + junk(r, r.randint(100, 300))
        rows.append((i, text, "x", 0.5))
        labels.append((i, int(good), 0))
    rows += [(7, rows[7][1], "x", 0.5), (None, "x", "x", 0.5), (501, None, "x", 0.5), (502, prose(r, 300_000), "x", 0.5)]
    labels += [(502, 1, 0), (None, 1, 0), (3, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y string, score double")
    model = Q.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = Q.classify(docs, model).collect()
    assert len(got) == len(rows)
    truth = {i: q for i, q, _ in labels if q is not None}
    held = [x for x in got if x.held_out and x.doc_id in truth]
    assert all((zlib.crc32(str(x.doc_id).encode()) % 5 == 0) == x.held_out for x in got if x.doc_id is not None)
    assert len(held) > 60 and np.mean([x.predicted == truth[x.doc_id] for x in held]) > 0.95
    kept = {x.doc_id for x in Q.accepted(docs, model).collect()}
    assert kept == {x.doc_id for x in got if x.predicted == 1}
    assert Q.classify(docs.limit(0), model).count() == 0
