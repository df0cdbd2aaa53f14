"""Fingerprint components and the near-duplicate stage held against brute force."""

import random

import xxhash

from skein.llm import golay_dedup as G

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n):
    return ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(n)]


def edited(r, words, n):
    words = list(words)
    for i in r.sample(range(len(words)), n):
        words[i] = "".join(r.choices("qrstuvwxyz", k=6))
    return words


def by_hand(text):
    """The contract's fingerprint, word by word."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, linked):
    up = {x: x for x in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        up[max(top(a), top(b))] = min(top(a), top(b))
    return {x: top(x) for x in nodes}


def test_fingerprint_components_against_brute_force(spark):
    r = random.Random(5)
    rows = []
    for _ in range(25):
        words = prose(r, r.choice([1, 2, 5, 60, 400]))
        for _ in range(r.randint(1, 4)):
            rows.append(edited(r, words, min(r.randint(0, 2), len(words))))
    texts = [" ".join(x) for x in rows] + [None, "", " \t\n", "A B c\vd", "a B c d", "É É"]
    ids = [r.randrange(100, 10**6) for _ in texts]
    ids[3] = None
    ids[7] = ids[30]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in zip(ids, texts)], "doc_id long, text string, fp long, component_id long")
    fps = [by_hand(t) for t in texts]
    nodes = sorted(set(fps))
    top = roots(nodes, [(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 3])
    least = {}
    for i, f in zip(ids, fps):
        if i is not None:
            least[top[f]] = min(i, least.get(top[f], i))
    want = sorted(((i or -1, f, least.get(top[f]) or -1) for i, f in zip(ids, fps)))
    got = sorted((x.doc_id or -1, x.fp & (1 << 64) - 1, x.component_id or -1) for x in G.classes(df).collect())
    assert got == want


def test_rows_without_id_link_and_ids_with_two_texts_do_not(spark, monkeypatch):
    five, other, beside = 0b1111 << 40, 0b11111 << 20, 0b11110 << 20
    own = spark.createDataFrame([(1, 0), (None, 0b111), (3, 0b111111), (5, five), (5, other), (2, beside)], "doc_id long, fp long")
    monkeypatch.setattr(G, "fingerprints", lambda docs: docs)
    got = {(x.doc_id, x.fp): x.component_id for x in G.classes(own).collect()}
    assert [got[k] for k in ((1, 0), (None, 0b111), (3, 0b111111))] == [1, 1, 1]
    assert got[5, other] == got[2, beside] == 2
    assert got[5, five] == 5


def test_golay_words_within_two_bits_share_a_codeword():
    import numpy as np

    r = np.random.default_rng(3)
    a = r.integers(0, 1 << 23, 500)
    one, two = r.integers(0, 23, 500), r.integers(0, 23, 500)
    b = a ^ (1 << one) ^ (1 << two)
    for x, y in zip(G.codes(a)[0].tolist(), G.codes(b)[0].tolist()):
        assert set(x) & set(y)
        assert len(set(x)) <= 6


def test_stage_against_brute_force(spark):
    r = random.Random(11)
    rows, n = [], 0
    for _ in range(60):
        words = prose(r, r.choice([3, 4, 5, 9, 150, 300]))
        for _ in range(r.randint(1, 6)):
            rows.append(" ".join(edited(r, words, r.randint(0, max(1, len(words) // 60)))))
    rows += [None, "", "  ", rows[0], rows[0].upper()]
    ids = r.sample(range(1000, 10**6), len(rows))
    docs = [(i, t, "en", "s", 1) for i, t in zip(ids, rows)]
    sets = [set(G.shingles(t).tolist()) for t in rows]
    near = []
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if (not sets[a] and not sets[b]) or (both and both >= 0.8 * len(sets[a] | sets[b])):
                near.append((a, b))
    order = sorted(range(len(rows)), key=ids.__getitem__)
    place = {x: k for k, x in enumerate(order)}
    top = roots(range(len(rows)), [(place[a], place[b]) for a, b in near])
    want = {ids[x] for x in order if top[place[x]] == place[x]}
    df = spark.createDataFrame([*docs, docs[4], docs[4], (None, rows[0], "en", "s", 1)], DOCS)
    got = [x.doc_id for x in G.first_of_each(df).collect()]
    assert got.count(None) == 1 and len(got) == len(set(got))
    got = {x for x in got if x is not None}
    assert want <= got  # nothing goes but by a verified link
    assert len(rows) - len(got) >= 0.95 * (len(rows) - len(want))
    assert G.first_of_each(df.limit(0)).count() == 0


def test_stage_on_one_large_group(spark):
    r = random.Random(2)
    words = prose(r, 200)
    rows = [(k, " ".join(edited(r, words, 3 if k != 77 else 0)), "en", "s", 1) for k in range(400)]
    got = G.first_of_each(spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "id")).collect()
    assert len(got) <= 8 and 0 in {x.doc_id for x in got}


def test_copies_of_one_text_are_one_class(spark):
    r = random.Random(4)
    words, alone = prose(r, 80), " ".join(prose(r, 80))
    rows = [(9, alone)] + [(k, " ".join(words)) for k in range(100, 400)] + [(50, " ".join(edited(r, words, 1))), (100, " ".join(words)), (9, alone), (None, alone)]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], DOCS)
    got = {(x.doc_id, x.first) for x in G.near_classes(docs).collect()}
    assert got == {(9, 9), (50, 50)} | {(k, 50) for k in range(100, 400)}
    assert sorted(x.doc_id or 0 for x in G.first_of_each(docs).collect()) == [0, 9, 50]


def test_partners_of_one_text_are_dealt_over_slots(spark, monkeypatch):
    monkeypatch.setattr(G, "HOT", 4)
    ends = spark.createDataFrame([(1, 1, b) for b in range(2, 202)] + [(7, 7, 8), (8, 7, 8), (5, 5, 9), (5, 5, 9)], "id long, a long, b long")
    texts = spark.createDataFrame([(1, "hub"), (7, "x"), (8, None), (5, ""), (6, "alone")], "id long, text string")
    got = sorted((x.id, x.a, x.b, x.text or "") for x in G.dealt(ends, texts).collect())
    text = {1: "hub", 7: "x", 8: "", 5: ""}
    assert got == sorted((x.id, x.a, x.b, text[x.id]) for x in ends.collect())
    assert G.dealt(ends.limit(0), texts).count() == 0


def test_rows_of_a_key_that_the_middle_left_apart_are_all_compared(monkeypatch):
    import numpy as np

    r = np.random.default_rng(8)
    for few in (32, 3):
        monkeypatch.setattr(G, "FEW", few)
        n = 90
        check = r.integers(0, 1 << 63, (n, 2), dtype=np.uint64)
        for i in range(0, n - 30, 2):  # a partner 30 places on, too far for those beside
            check[i + 30] = check[i] ^ np.array([0b1011, 1 << 40], np.uint64)
        key = np.sort(r.choice([5, 7, 7, 7, 9], n))
        ids, root = np.arange(100, 100 + n), np.arange(n) // 2
        near = lambda i, j: sum(int(x ^ y).bit_count() for x, y in zip(check[i].tolist(), check[j].tolist())) <= G.APART
        want = {(100 + i, 100 + j) for j in range(n) for i in range(j) if key[i] == key[j] and root[i] != root[j] and near(i, j)}
        assert {p for a, b in G.apart_of(key, ids, check, root) for p in zip(a.tolist(), b.tolist())} == want and len(want) > 5
        assert not want <= set(zip(*(x.tolist() for x in G.pairs_of(key, ids, check))))
    assert not list(G.apart_of(key[:0], ids[:0], check[:0], root[:0]))


def test_near_rows_of_a_large_key_make_an_edge_for_each_row(spark):
    """All of 300 rows of a key are near each other and apart by root: an edge for each, not one for each pair."""
    keyed = spark.createDataFrame([(k, 1000 * k + i, i % 16, 0, i) for k in (1, 2) for i in range(300)], "k long, id long, c long, d long, root long")
    got = [(x.a, x.b) for x in G.unmet(keyed).collect()]
    assert len(got) == 598
    assert set(roots([1000 * k + i for k in (1, 2) for i in range(300)], got).values()) == {1000, 2000}


def test_parts_are_compared_in_full_in_tiles(spark, monkeypatch):
    r = random.Random(9)
    words = [prose(r, 120), prose(r, 120)]
    texts = [" ".join(edited(r, words[i % 2], i % 7)) for i in range(90)] + ["", " "]
    rows = [(i % 2, 50 + 3 * i, i // 2 % 5, t) for i, t in enumerate(texts)]
    near = [(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and a[0] == b[0] and a[2] != b[2] and G.similar(G.shingles(a[3]), G.shingles(b[3]))]
    want = roots([x[1] for x in rows], near)
    assert 10 < len(set(want.values())) < 80
    groups = spark.createDataFrame(rows, "part long, id long, root long, text string")
    for tile in (1 << 11, 20, 9):
        monkeypatch.setattr(G, "TILE", tile)
        found = [(x.a, x.b) for x in G.alike_in(groups).collect()]
        assert roots([x[1] for x in rows], found) == want
    assert G.alike_in(groups.limit(0)).count() == 0


def test_sets_that_are_alike_against_brute_force(monkeypatch):
    import numpy as np

    r = np.random.default_rng(6)
    for few, columns in ((32, 2048), (2, 3), (1, 7)):
        monkeypatch.setattr(G, "FEW", few)
        monkeypatch.setattr(G, "COLUMNS", columns)
        for _ in range(10):
            base, sets = r.integers(0, 1 << 40, (3, 20), dtype=np.uint64), []
            for _ in range(25):
                x, n = base[r.integers(3)].copy(), r.integers(0, 4)
                x[r.integers(0, 20, n)] = r.integers(0, 1 << 40, n, dtype=np.uint64)
                sets.append(np.unique(x[: r.integers(16, 21)]))
            ids, root = r.permutation(100)[:25], r.integers(0, 4, 25)
            want = [(ids[i], ids[j]) for i in range(25) for j in range(i) if root[i] != root[j] and G.similar(sets[i], sets[j])]
            got = list(zip(*G.alike(ids, root, sets)))
            assert len(got) < 25 and roots(ids, got) == roots(ids, want) and want
