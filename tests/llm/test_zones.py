"""Ruling passages out by zones loses no item that an exact scoring of every passage retrieves."""

import random

import numpy as np
import pytest

from skein.llm import decontaminate as D


def _exact(ix, text):
    """{item: best score} over passages, every item scored in every passage."""
    words, best = D.tokens(text), {}
    if not words:
        return best
    weight = [{} for _ in ix.items]
    for t, k in ix.ids.items():
        for i, v in zip(ix.posts[k].tolist(), ix.shares[k].tolist()):
            weight[i][t] = v
    for s in range(0, max(1, len(words) - ix.span), ix.span):
        part = set(words[s : s + 2 * ix.span])
        for i, w in enumerate(weight):
            score = sum(v for t, v in w.items() if t in part)
            if score >= D.RETRIEVE:
                best[i] = max(best.get(i, 0.0), score)
    return best


@pytest.mark.parametrize("table", [0, 1 << 22])
def test_zones_keep_every_item(monkeypatch, table):
    monkeypatch.setattr(D, "TABLE", table)
    r = random.Random(3)
    words = [f"w{i}" for i in range(120)] + [f"rare{i}" for i in range(400)]
    draw = lambda n: [words[min(int(r.expovariate(1 / 60)), len(words) - 1)] for _ in range(n)]
    items = [(i, draw(r.randint(6, 40)), draw(r.randint(0, 8))) for i in range(90)]
    ix, found = D.Index.build(items), 0
    for _ in range(60):
        _, q, a = r.choice(items)
        keep = [w for w in q + a if r.random() < 0.75]
        text = " ".join(draw(r.randint(0, 300)) + keep + draw(r.randint(0, 300)))
        got, want = ix.search(text), _exact(ix, text)
        assert set(got) == set(want)
        found += len(want)
    assert found > 20


def test_nothing_to_search():
    assert D.Index.build([]).search("any words") == {}
    assert D.Index.build([(1, [], [])]).search("any words") == {}
    assert D.Index.build([(1, ["a", "b"], [])]).search(None) == {}
    assert D.Index.build([(1, ["a", "b"], [])]).search("none of these") == {}
    assert np.isclose(D.Index.build([(1, ["a", "b"], [])]).search("a b")[0][2], 1.0)
