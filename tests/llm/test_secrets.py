"""Base spans and guess costs held against plainer versions."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from skein.llm import secrets as S


def base_by_hand(text):
    out = []
    for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for kind, (pattern, least) in enumerate(((r"AKIA[A-Z0-9]+", 20), (r"[0-9a-f]+", 24)), 1):
        for m in re.finditer(pattern, text):
            if len(m[0]) >= least:
                out.append((m.start(), kind, f"{S.KINDS[kind]}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_base_digest_against_plain_scan(spark):
    r = random.Random(1)
    pieces = ["password", "Passwd", "api_key", "APIKEY", "token", "=", ":", '"', " ", "AKIA", "ABCDEFGH1234567890", "hunter22", "deadbeef" * 3, "0123", "é", "\n", "ſecret", "a1"]
    texts = ["".join(r.choices(pieces, k=r.randint(0, 30))) for _ in range(300)] + ["", "password=" + "x" * 5000]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, None, "x", 1), (3, texts[3], "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_hex int")
    got = S.scan(df).collect()
    assert len(got) == len(rows)
    for x in got:
        want = base_by_hand(texts[x.doc_id]) if x.doc_id is not None else ""
        assert x.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(x.spans.split(","))
        assert x.n_assign + x.n_access + x.n_hex == len([y for y in want.split(",") if y])
    assert S.scan(df.limit(0)).count() == 0


def every_cut(value, ranks):
    """The cheapest segmentation, over all spans of each kind."""
    low, each = value.lower(), math.log2(S.alphabet(value))
    beside, plain = S._beside(), low.translate(S._LEET)
    best = [0.0] + [math.inf] * len(value)
    for e in range(1, len(value) + 1):
        for s in range(e):
            part = value[s:e]
            costs = [each] if e - s == 1 else []
            if e - s >= 3 and len(set(part)) == 1:
                costs.append(1 + each + math.log2(e - s))
            steps = [low[i : i + 2] in beside or (value[i].isalnum() and value[i + 1].isalnum() and abs(ord(value[i]) - ord(value[i + 1])) == 1) for i in range(s, e - 1)]
            if e - s >= 3 and all(steps):
                costs.append(7 + math.log2(e - s))
            m = S._DATE.match(value, s)
            if value[s].isdigit() and m and m.end() == e:
                costs.append(16)
            rank = ranks.get(low[s:e], ranks.get(plain[s:e], math.inf) + 2)
            if e - s >= 3 and rank < math.inf:
                costs.append(1 + rank + (0 if part == low[s:e] else 1 if part in (low[s:e].upper(), low[s:e].capitalize()) else 4))
            best[e] = min([best[e], *(best[s] + c for c in costs)])
    return best[-1]


@pytest.mark.parametrize("seed", range(6))
def test_guess_cost_against_all_segmentations(seed):
    r = random.Random(seed)
    ranks = S.ranks_of()
    pieces = ["password", "P4ssw0rd", "Dragon", "2019-04-05", "1234", "aaaa", "s" * 40, "qwerty", "x9$K", "Zq", "0000000", "abcdefgh", "765"]
    for _ in range(12):
        value = "".join(r.choices(pieces, k=r.randint(1, 6)))
        got, spans = S.guess_bits(value)
        assert got == pytest.approx(every_cut(value, ranks))
        assert [s for s, _, _ in spans] == [0, *[e for _, e, _ in spans][:-1]] and spans[-1][1] == len(value)


def test_values_of_any_length_and_case():
    for n in (80, 85, 86, 90, 500):
        assert S.guess_spans(f"password is {'x9Q' * n} here")
    assert S.guess_spans("password is QwXzPlKmVbNtRrTyHjUi now") and not S.guess_spans("password is incorrect now")
    assert not S.guess_spans("the password is Unbelievable, " + "x" * 300)
    r = random.Random(3)
    digits = "".join(r.choices("0123456789", k=3000))
    assert S.guess_bits(digits[:256])[0] < S.guess_bits(digits[:257])[0] < S.guess_bits(digits)[0]
    assert S.guess_bits("z" * 20_000)[0] < 30


def test_words_of_the_corpus_lower_the_cost(spark):
    df = spark.createDataFrame([("Zorblax quimby zorblax",), ("quimby zorblax",), (None,), ("once",)], "text string")
    ranks = S.corpus_ranks(df)
    assert "zorblax" in ranks and "once" not in ranks and ranks["password"] == 1
    assert ranks["zorblax"] < ranks["quimby"]
    assert S.guess_bits("zorblaxquimby7", ranks)[0] < S.guess_bits("zorblaxquimby7")[0]
    texts = spark.createDataFrame([(1, "password: hunter22 x", None, 0), (2, None, "a", 0)], "doc_id long, text string, lang string, n_chars long")
    got = {x.doc_id: x for x in S.redact(texts).collect()}
    assert got[1].text == "password: [secret] x" and got[1].n_chars == len(got[1].text) and got[2].text is None


@pytest.mark.parametrize("most", [0, 1, 7, 40, 65, 10_000])
def test_most_frequent_words_at_any_cut(spark, most):
    """Ties at the cut, within and across the classes of counts, go by the word; nulls and empty texts count nothing."""
    r = random.Random(5)
    words = [a + b + "zz" for a in "abcdefgh" for b in "ijklmnop"]
    texts = [" ".join(r.choices(words, weights=[1 + i * i % 60 for i in range(64)], k=r.randint(1, 60))) for _ in range(80)]
    df = spark.createDataFrame([(t,) for t in [*texts, "once Onlyhere", None, ""]], "text string").repartition(5)
    n = Counter(w for t in texts for w in t.split())
    assert len(set(n.values())) < len(n)  # ties there are
    expected = sorted((w for w in n if n[w] > 1), key=lambda w: (-n[w], w))[:most]
    assert S.corpus_ranks(df, most) == S.ranks_of([*S.WORDS, *expected])


def test_no_words_to_rank(spark):
    assert S.corpus_ranks(spark.createDataFrame([], "text string")) == S.ranks_of()
