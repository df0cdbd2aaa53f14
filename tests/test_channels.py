"""All channels of the third and fourth versions, against brute force on names that meet by sound or spelling alone."""

import math
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from skein.functions import text
from skein.operators import blocking
from skein.plans import catalog

ROWS = [
    ("S1-1", 1, "Smith Trading", "1 a st 10001"), ("S2-1", 2, "Smyth Bakery", "2 b st 10002"),
    ("S1-2", 1, "quarterhorse veterinary clinikal supplyhouse", "3 c st 10003"), ("S2-2", 2, "quartermaster clinic", "4 d st 10004"),
    ("S1-3", 1, "xylophonemakerandrepairworkshop", "5 e st 10005"), ("S3-3", 3, "wylophonemakerandrepairworkshop", "6 f st 10006"), ("S3-4", 3, "wylophonemakerandrepairworkshop", "7 g st 10007"),
    ("S1-5", 1, "Blue River Foods", "8 h st 10008"), ("S2-5", 2, "River Blue Foods", "8 h st 10008"), ("S2-6", 2, "99 bottles", "9 i st 10009"), ("S1-7", 1, "", ""),
]


def _soundex(name):
    first = (name.split() or [""])[0]
    if not (first.isascii() and first.isalpha()):
        return ""
    code = {c: d for d, cs in zip("123456", ("bfpv", "cgjkqsxz", "dt", "l", "mn", "r")) for c in cs}
    out, last = first[0].upper(), code.get(first[0], "")
    for c in first[1:]:
        d = code.get(c, "")
        if d and d != last:
            out += d
        if c not in "hw":
            last = d
    return (out + "000")[:4]


def _grams(name):
    p = f" {name} "
    return [p[i : i + 3] for i in range(len(p) - 2)] if name else []


def _word_grams(name):
    return [g for w in name.split() for g in _grams(w)]


def _brute(recs, version):
    """{(source 1, other): channels}, each pair of records compared by each rule; the caps bind nothing here."""
    words = lambda r: {w for w in r.name_tokens if len(w) > 1}
    two = lambda r: set(combinations(sorted(words(r)), 2))
    same = lambda k: lambda a, b: a[k] != "" and a[k] == b[k]
    rules = {"exact_addr": same("address_norm"), "token": lambda a, b: words(a) & words(b), "bigram": lambda a, b: two(a) & two(b),
             "phonetic": lambda a, b: _soundex(a.name_legal) != "" and _soundex(a.name_legal) == _soundex(b.name_legal)}
    if version == "v3":
        rules |= {"exact_name": same("name_legal"), "exact_punct": same("name_punct"), "sorted_name": same("name_sorted")}
        rules |= {n: lambda a, b, k=k: words(a) & words(b) and same(k)(a, b) for n, k in (("tok_addrnum", "address_numbers"), ("tok_postal", "postal_code"))}
    else:
        others = [set(_word_grams(r.name_punct)) for r in recs if r.src != 1]
        df = Counter(g for s in others for g in s)
        idf = {g: math.log((1 + len(others)) / (1 + n)) + 1 for g, n in df.items() if n >= 2}

        def unit(r):
            w = {g: (1 + math.log(k)) * idf[g] for g, k in Counter(_word_grams(r.name_punct)).items() if g in idf}
            size = math.sqrt(sum(x * x for x in w.values()))
            return {g: x / size for g, x in w.items()}

        def jaccard(a, b):
            x, y = set(_grams(a.name_punct)), set(_grams(b.name_punct))
            j = len(x & y) / max(1, len(x | y))
            assert j < 0.5 or j > 0.75  # far from the threshold, so that MinHash finds it surely
            return j

        rules |= {"exact_name": same("name_view"), "addr_struct": same("addr_struct_key"), "postal": same("postal_code"),
                  "ngram_tfidf": lambda a, b: sum(x * unit(b).get(g, 0) for g, x in unit(a).items()) >= 0.25, "minhash_lsh": lambda a, b: jaccard(a, b) >= 0.5}
    found = {(a.entity_id, b.entity_id): sorted(n for n, rule in rules.items() if rule(a, b)) for a in recs if a.src == 1 for b in recs if b.src != 1}
    return {k: v for k, v in found.items() if v}


@pytest.mark.parametrize("version", ["v3", "v4"])
def test_whole_retrieval_against_brute_force(spark, monkeypatch, version):
    raw = spark.createDataFrame(ROWS, "entity_id string, src int, business_name string, business_address string").withColumn("country", F.lit("US"))
    n = text.normalised(raw)
    want = _brute(n.collect(), version)
    monkeypatch.setattr(catalog, "normal", lambda s, d: n)
    query, sql = catalog.REGISTRY[f"retrieve_{version}"]
    got = {(r[0], r[1]): r.channels.split("|") for r in query(spark, "").collect()}
    assert got == want and (sql is None) == (version == "v4")
    assert want["S1-1", "S2-1"] == ["phonetic"]
    if version == "v4":
        assert {"ngram_tfidf", "minhash_lsh"} == set(want["S1-3", "S3-3"]) and {c.name for c in blocking.V4} - {"exact_name"} < {c for v in want.values() for c in v}


def test_whole_link_has_every_channel(spark, monkeypatch):
    raw = spark.createDataFrame(ROWS, "entity_id string, src int, business_name string, business_address string").withColumn("country", F.lit("US"))
    n = text.normalised(raw)
    monkeypatch.setattr(catalog, "normal", lambda s, d: n)
    monkeypatch.setattr(catalog, "records", lambda s, d: raw)
    seen = {}
    monkeypatch.setattr(catalog.decision, "accepted", lambda x, at: seen.setdefault("pairs", x).where("score >= 0"))
    catalog.link_end_to_end(spark, "")
    assert {(r[0], r[1]): r.channels for r in seen["pairs"].select(catalog.S1, catalog.C, "channels").collect()} == _brute(n.collect(), "v4")


def _linked(spark, monkeypatch, rows):
    raw = spark.createDataFrame(rows, "entity_id string, src int, business_name string, business_address string, country string")
    n = text.normalised(raw)
    monkeypatch.setattr(catalog, "normal", lambda s, d: n)
    monkeypatch.setattr(catalog, "records", lambda s, d: raw)
    return n


def test_link_of_classes_is_that_of_records(spark, monkeypatch):
    """Copies, some above a cap, empty names and addresses, ids that two rows share."""
    words = "blue river foods trading bakery smith smyth optics north old mill a".split()
    rows, k = [], 0
    for i in range(60):
        name = " ".join(words[(i * j + j) % len(words)] for j in range(1, 1 + i % 5))
        for j in range(1 + i % 4):
            k += 1
            rows.append((f"S{k % 3 + 1}-{k}", k % 3 + 1, name.upper() if j % 2 else name, f"{i % 7} a st {10000 + i % 5}" if i % 9 else None, "US" if i % 11 else "fr"))
    rows += [("S2-900", 2, "blue river foods", "1 a st 10001", "US"), ("S2-900", 2, "old mill optics", "1 a st 10001", "US"), ("S1-901", 1, "", "", ""), ("S3-902", 3, None, None, None)]
    n = _linked(spark, monkeypatch, rows)
    few = [blocking.Channel(c.name, c.keys, 4, c.explode, c.scope, c.rarest) for c in blocking.V4]
    monkeypatch.setattr(catalog, "LINK", few)
    for channels, retrieve in ((None, blocking.retrieve_v4), (few, catalog._reduced)):
        scored = catalog.scored(spark, "", retrieve)
        want = catalog.decision.listed(catalog._ids(spark, ""), catalog.decision.best_owner(catalog.decision.accepted(scored)), "matched_entity_ids")
        got = catalog.link_end_to_end(spark, "", channels)
        assert sorted(got.collect()) == sorted(want.collect())
        assert got.where("matched_entity_ids <> ''").count() > 5


def test_pairs_are_left_out_where_they_meet(spark, monkeypatch):
    """The bound is never below the score, and Spark takes it to the joins of the keys."""
    n = _linked(spark, monkeypatch, [(*r, "US") for r in ROWS])
    own = blocking.classes(n)
    views = lambda p, k, i, of: own.select(F.col("cls").alias(k), F.col(of).alias(i), *[F.col(v).alias(p + v) for v in catalog.features.VIEWS])
    pairs = blocking.class_pairs(n, own).join(views("l_", "a", "x", "one"), "a").join(views("r_", "b", "y", "other"), "b")
    scored = catalog.features.cheap(pairs).withColumn("score", catalog.features.rule_score())
    assert scored.where("ceiling < score").count() == 0 and scored.count() > 5
    plan = catalog.decision.accepted(scored)._jdf.queryExecution().optimizedPlan().toString()
    assert any("Join Inner" in x and "bit_count" in x and "ch#" in x for x in plan.splitlines())


def test_bits_leave_out_no_near_sets(spark):
    words = [f"{a}{b} {c}" for a in ("river", "rover", "lake") for b in ("side", "bank", "s") for c in ("foods", "food co", "bakery limited", "x")]
    rows = [(f"S{i % 3 + 1}-{i}", i % 3 + 1, w, "US") for i, w in enumerate(words)]
    got = catalog.scoring.minhash_pairs(spark.createDataFrame(rows, "entity_id string, src int, name_punct string, country_norm string"), perms=192, rows=1)
    j = lambda x, y: len(set(_grams(x)) & set(_grams(y))) / len(set(_grams(x)) | set(_grams(y)))
    want = {(a[0], b[0]): round(j(a[2], b[2]), 6) for a in rows for b in rows if a[1] == 1 and b[1] != 1 and j(a[2], b[2]) >= 0.5}
    assert {(r[0], r[1]): r.jaccard for r in got.collect()} == want and len(want) > 20


def test_output_is_checked_without_linking_again(spark, monkeypatch):
    _linked(spark, monkeypatch, [(*r, "US") for r in ROWS])
    got = catalog._output_faults(spark, "")
    assert "bit_count" not in got._jdf.queryExecution().optimizedPlan().toString()  # the lists are read, not made anew by each count
    row = got.first()
    assert (row.headers, row.missing_rows, row.extra_rows, row.unknown_ids, row.self_matches) == (1, 0, 0, 0, 0)


def _expanded(pairs, members):
    of = {}
    for r in members.collect():
        of.setdefault(r.class_id, set()).add(r.entity_id)
    return {(a, b, *r[2:]) for r in pairs.collect() for a in of[r[0]] for b in of[r[1]]}


def test_pairs_of_classes_with_their_members_are_all_pairs(spark, monkeypatch):
    copies = [(f"{i[:3]}{i[3:]}{k}", src, name, addr) for k in range(4) for i, src, name, addr in ROWS]
    n = _linked(spark, monkeypatch, [(*r, "US") for r in copies])
    query = lambda name: catalog.REGISTRY[name][0](spark, "")
    want = {tuple(r) for r in blocking.retrieve_v4(n).withColumn("channels", F.array_join("channels", "|")).collect()}
    got = query("retrieve_v4")
    assert _expanded(got, query("retrieve_v4_members")) == want and got.count() < len(want) / 10
    got, want = query("minhash_pairs"), {tuple(r) for r in catalog.scoring.minhash_pairs(n).collect()}
    assert _expanded(got, query("minhash_members")) == want and got.count() < len(want) / 10


def test_links_of_many_addresses_and_of_own_classes(spark, monkeypatch):
    """Names with many addresses, classes with records on both sides beside others that tie with them, as all pairs of records give."""
    rows, k = [], 0
    for i, name in enumerate(["blue river foods", "river blue foods", "blue river foods ltd", "old mill optics", "mill old optics", "smith", "smyth", ""]):
        for j in range(1 + 5 * (i % 3)):
            for src in (1, 2, 3)[: 1 + (i + j) % 3] if j % 2 else (3, 1):
                k += 1
                rows.append((f"S{src}-{k}", src, name, f"{j % 4} a st {10000 + i % 2}" if j % 5 else f"{10000 + i % 2} a {j % 4} st", "US"))
    _linked(spark, monkeypatch, rows)
    scored = catalog.scored(spark, "", blocking.retrieve_v4)
    want = catalog.decision.listed(catalog._ids(spark, ""), catalog.decision.best_owner(catalog.decision.accepted(scored)), "matched_entity_ids")
    assert sorted(catalog.link_end_to_end(spark, "").collect()) == sorted(want.collect())


def test_own_classes_are_compared_with_no_others(spark, monkeypatch):
    """A class with records on both sides isn't compared with those that score less."""
    rows = [(f"S{s}-{s * 100 + i}", s, "blue river foods", f"{i} a st {10000 + i}", "US") for s in (1, 2) for i in range(20)]
    _linked(spark, monkeypatch, rows)
    seen = {}
    monkeypatch.setattr(catalog.decision, "accepted", lambda x, at: seen.setdefault("pairs", x.where("score >= 0.5")))
    catalog.link_end_to_end(spark, "")
    assert seen["pairs"].count() == 20
