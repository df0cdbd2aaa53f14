"""Languages of invented texts, held out, and the edges."""

import random
import zlib

import numpy as np

from skein.llm import langid as L

LETTERS = {"aa": "abcdefg", "bb": "hijklmnaeiou", "cc": "opqrstu", "dd": "vwxyzaei"}


def prose(r, lang, n):
    return " ".join("".join(r.choices(LETTERS[lang], k=r.randint(2, 9))) for _ in range(n))


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out_accuracy_and_edges(spark):
    r = random.Random(1)
    rows = [(i, prose(r, lang, r.randint(5, 80)), lang, "s") for i in range(400) for lang in [r.choice(list(LETTERS))]]
    mixed = prose(r, "aa", 60) + " " + prose(r, "cc", 40)
    more = [(1000, mixed, None, "s"), (1001, None, "aa", "s"), (1002, " 12 -- ", "aa", "s"), (1003, "", None, "s"), (None, mixed, None, "s")]
    df = spark.createDataFrame(rows + more, "doc_id long, text string, lang string, langs string")
    got = {x.doc_id: x for x in L.identify(df, L.learn(df)).collect()}
    assert len(got) == len(rows) + len(more)
    right = [got[i].lang_pred == lang for i, _, lang, _ in rows if held(i)]
    assert np.mean(right) > 0.97
    assert all(got[i].held_out == held(i) for i, *_ in rows)
    assert got[1000].lang_pred == "aa" and got[1000].langs == ["aa", "cc"]
    assert abs(got[1000].shares[0] - 0.6) < 0.1 and 0 < got[1000].score < 0.9
    assert all((got[i].lang_pred, got[i].score, got[i].langs) == ("und", 0.0, []) for i in (1001, 1002, 1003))
    assert got[None].held_out is None and got[None].lang_pred == "aa"
    assert L.identify(df.limit(0), L.learn(df.limit(0))).count() == 0
    assert {x.lang_pred for x in L.identify(df, L.learn(df.limit(0))).collect()} == {"und"}


def test_long_texts_are_cut_between_words(monkeypatch):
    r = random.Random(2)
    text = prose(r, "aa", 300) + "x" * 700 + " " + prose(r, "bb", 50)
    whole = L.counts(text).sum(1)
    model = L.Languages.learn({k: L.counts(prose(r, k, 200)) for k in LETTERS})
    words = model.words(text)
    for step in (1, 7, 64, 500):
        monkeypatch.setattr(L, "STEP", step)
        assert "".join(L.pieces(text)) == text
        assert all(not (a[-1:].isalpha() and b[:1].isalpha()) for a, b in zip(list(L.pieces(text)), list(L.pieces(text))[1:]))
        assert L.counts(text)[0].sum() >= whole[0] and len(model.words(text)) == len(words)


def test_mixture_weights_by_plain_expectation_maximisation():
    r = random.Random(4)
    model = L.Languages.learn({k: L.counts(prose(r, k, 400)) for k in LETTERS})
    text = prose(r, "bb", 30) + " " + prose(r, "dd", 70)
    share, chosen, likely = model.mixture(text, rounds=50)
    ll = model.words(text).astype(float)[:, chosen]
    w = np.full(len(chosen), 1 / len(chosen))
    for _ in range(300):
        p = np.exp(ll - ll.max(1, keepdims=True)) * w
        w = (p / p.sum(1, keepdims=True)).mean(0)
    assert {model.names[k] for k in chosen} == {"bb", "dd"}
    assert np.abs(share[chosen] - w).max() < 0.01 and 0 <= likely.max() <= 1
