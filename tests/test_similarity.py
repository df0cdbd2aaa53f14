"""The kernels on batches against the plain functions, pair by pair."""

import random
import time

import numpy as np
import pandas as pd

from skein.functions import similarity as S


def _made(r, n, low, high, letters):
    one = lambda: "".join(r.choices(letters, k=r.randint(low, high)))
    rows = [(one(), one()) for _ in range(n)]
    for _ in range(n):  # near ones, of equal lengths often
        a = list(one())
        b = list(a)
        for _ in range(r.randint(0, 3)):
            if b:
                b[r.randrange(len(b))] = r.choice(letters)
        rows.append(("".join(a), "".join(b[r.randint(0, 1) :])))
    return rows


def test_batches_give_what_the_plain_functions_give():
    r = random.Random(3)
    rows = [(None, "a"), ("", ""), ("a", ""), ("a", "a"), ("a", "b"), ("ab", "ba"), ("martha", "marhta"), ("a\0", "a"), ("😀é", "é😀x"), ("abc", "xxabcxx")]
    rows += _made(r, 150, 0, 12, "ab ") + _made(r, 150, 1, 45, "abcdefgh ") + _made(r, 12, 60, 140, "abcd ") + _made(r, 3, 250, 300, "abc")
    rows += _made(r, 40, 5, 30, [chr(0x4E00 + k) for k in range(400)])
    r.shuffle(rows)
    a, b = (pd.Series(x, dtype=object) for x in zip(*rows))
    p = S._Pairs(a, b)
    whole, part = S._by_length(p, True)
    for got, f in ((whole, S.ratio), (part, S.partial_ratio), (S._winklers(p), S.jaro_winkler)):
        assert got[p.back].tolist() == [f(x or "", y or "") for x, y in rows]


def test_no_rows():
    p = S._Pairs(pd.Series([], dtype=object), pd.Series([], dtype=object))
    assert [len(x) for x in (*S._by_length(p, True), S._winklers(p))] == [0, 0, 0]


def test_a_batch_of_names_is_fast():
    """10,000 pairs of six words; pair by pair the windows alone took several seconds."""
    r = random.Random(4)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 10))) for _ in range(500)]
    a, b = (pd.Series([" ".join(r.choices(words, k=6)) for _ in range(10_000)]) for _ in range(2))
    t = time.process_time()
    p = S._Pairs(a, b)
    part = S._by_length(p, True)[1][p.back]
    S._winklers(p)
    assert time.process_time() - t < 1.5 and np.all(part > 0)
