"""The two native operators held against plain versions: fingerprints, and URL rules and trees."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from skein.llm import fingerprints as P
from skein.llm import url_filter as U


def test_edited_texts_and_likeness_against_plain_version(spark):
    r = random.Random(1)
    words = ["".join(r.choices("abcdefé😀 \n\t", k=r.randint(1, 9))) for _ in range(300)]
    texts = [" ".join(r.choices(words, k=r.randint(0, 120))) for _ in range(700)] + [None, "", "a", "\n"]
    ids = r.sample(range(10**6), len(texts))
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in zip(ids, texts)], "doc_id long, text string, fp int, bucket string")
    got = {x.doc_id: x for x in P.edited_fingerprints(df).collect()}
    order = sorted(range(len(texts)), key=lambda k: -ids[k])
    prints = {}
    for k, after in zip(order, [*order[1:], order[0]]):
        text, other, x = texts[k] or "", texts[after] or "", got[ids[k]]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        assert (x.n_chars, x.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(text, x.fingerprint) == x.fingerprint
        assert prints.setdefault(edited, x.edited_fingerprint) == x.edited_fingerprint
        like = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 64
        assert x.near_edited == like(x.fingerprint, x.edited_fingerprint)
        assert x.near_next == like(x.fingerprint, got[ids[after]].fingerprint)
        near = sum((int(x.fingerprint, 16) ^ int(y.fingerprint, 16)).bit_count() <= 3 for y in got.values()) - 1
        assert x.n_near == near
    assert P.edited_fingerprints(df.limit(0)).count() == 0


def test_vote_against_plain_version(spark):
    r = random.Random(2)
    docs = [[("".join(r.choices("abc", k=r.randint(0, 20)))) for _ in range(r.randint(1, 30))] for _ in range(40)]
    rows = spark.createDataFrame([(i, w) for i, d in enumerate(docs) for w in d], "k long, term string").withColumn("h", F.xxhash64("term"))
    hashes = {x.term: x.h & (1 << 64) - 1 for x in rows.collect()}
    got = {x.k: x.fp & (1 << 64) - 1 for x in P.vote(rows.select("k", "term"), ["k"], "term").collect()}
    for i, d in enumerate(docs):
        weight = [0 if not w else 1 if len(w) <= 3 else min(len(w), 16) - 2 for w in d]
        want = sum(1 << b for b in range(64) if 2 * sum(n for w, n in zip(d, weight) if hashes[w] >> b & 1) > sum(weight))
        assert got[i] == want


def test_tables_find_all_pairs(spark):
    r = random.Random(3)
    own = set()
    for _ in range(60):
        a = r.getrandbits(64)
        for _ in range(4):
            b = a
            for bit in r.sample(range(64), r.randint(0, 5)):
                b ^= 1 << bit
            own.add(b - (1 << 64) if b >> 63 else b)
    own = sorted(own)
    got = {(x.a, x.b) for x in P.near(spark.createDataFrame([(x,) for x in own], "fp long")).collect()}
    assert got == {(a, b) for a in own for b in own if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "c d"), (1, "a b"), (None, "e"), (None, "f")], "doc_id long, text string")
    got = P.edited_fingerprints(df).collect()
    assert sorted(x.doc_id or 0 for x in got) == [0, 0, 1, 1, 1] and len({x.fingerprint for x in got}) == 4


def judged(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fits = [(len(h) + len(p), f"{h}/{p}", v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_rules_against_plain_version(spark):
    r = random.Random(5)
    hosts = ["example.com", "www.example.com", "notexample.com", "com", "a.net", "EXAMPLE.net", "b.example.net", "x.org", "É.com", ""]
    paths = ["", "/", "/en/", "/en/7", "/en/71/x", "/de/8?q=/es/", "/de/", "/es/a#b", "/EN/", "/en", "?a=b", "#/en/"]
    urls = [r.choice(["http://", "https://", "x://", "://", "", "a/b"]) + r.choice(hosts) + r.choice(paths) + r.choice(["", "://com/en/", "\n"]) for _ in range(600)]
    rows = [(i, u, "x") for i, u in enumerate([*urls, None, "", urls[0]])]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string")
    got = {x.page_id: x for x in U.judge(df).collect()}
    assert len(got) == len(rows)
    for i, u, _ in rows:
        host, path, rule, verdict = judged(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert U.judge(df.limit(0)).count() == 0
    assert {x.verdict for x in U.judge(spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")).collect()} == {"allow"}


def test_trees_on_held_out_urls(spark):
    r = random.Random(6)

    def url(bad):
        name = "".join(r.choices("abcdefghij" if not bad else "abc0123456789-", k=r.randint(6, 14)))
        tail = "/".join("".join(r.choices("abcdef", k=5)) for _ in range(r.randint(1, 3) + 2 * bad))
        return f"http://{name}.{'info' if bad and r.random() < 0.5 else 'edu'}/{tail}" + ("?" + "&".join(f"k{i}={r.random()}" for i in range(4)) if bad else "")

    rows = [(i, url(i % 2), i % 2) for i in range(1600)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad int").withColumns({"host": U.host_of(F.col("url")), "path": U.path_of(F.col("url"))})
    seen = U.lexical(df)
    model = U.train(seen.where("page_id < 1200"), "bad")
    got = model.block(seen.where("page_id >= 1200")).select((F.col("p_block") > 0.5).cast("int").alias("p"), "bad").collect()
    assert sum(x.p == x.bad for x in got) >= 0.95 * len(got)
