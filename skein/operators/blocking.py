"""Blocking channels as data, candidate pairs with provenance, retrieval measures."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions.text import trigrams
from skein.operators import scoring
from skein.sources.tables import scratch


@dataclass(frozen=True)
class Channel:
    """Records meet that share `keys`, if the key occurs `cap` times at most (None: always).

    explode: None, 'token' (words over one character, repeats included) or 'bigram' (sorted pairs of
    distinct words, of the `rarest` ones if given). scope: the cap counts sources 2 and 3 together
    ('others') or each table by itself ('own').
    """

    name: str
    keys: tuple[str, ...]
    cap: int | None = None
    explode: str | None = None
    scope: str = "others"
    rarest: int | None = None


V1 = [Channel("exact_name_rare", ("country", "name_norm"), 15, scope="own"), Channel("address_rare", ("country", "address_numbers"), 15, scope="own"),
      Channel("name_and_addr", ("country", "name_norm", "address_numbers"))]
V2 = [Channel("exact_name", ("country_norm", "name_legal"), 1000), Channel("exact_addr", ("country_norm", "address_norm"), 1000),
      Channel("token", ("country_norm", "token"), 1000, "token"), Channel("tok_addrnum", ("country_norm", "token", "address_numbers"), None, "token"),
      Channel("tok_postal", ("country_norm", "token", "postal_code"), None, "token")]
V3 = [Channel("exact_name", ("country_norm", "name_legal"), 400), Channel("exact_punct", ("country_norm", "name_punct"), 400),
      Channel("exact_addr", ("country_norm", "address_norm"), 400), Channel("sorted_name", ("country_norm", "name_sorted"), 400),
      Channel("token", ("country_norm", "token"), 400, "token"), Channel("tok_addrnum", ("country_norm", "token", "address_numbers"), 1000, "token"),
      Channel("tok_postal", ("country_norm", "token", "postal_code"), 1000, "token"), Channel("bigram", ("country_norm", "token"), 400, "bigram"),
      Channel("phonetic", ("country_norm", "phonetic"), 400)]
V4 = [Channel("exact_name", ("country_norm", "name_view"), 500), Channel("exact_addr", ("country_norm", "address_norm"), 500),
      Channel("addr_struct", ("country_norm", "addr_struct_key"), 1000), Channel("postal", ("country_norm", "postal_code"), 2000),
      Channel("token", ("country_norm", "token"), 500, "token"), Channel("phonetic", ("country_norm", "phonetic"), 400),
      Channel("bigram", ("country_norm", "token"), 400, "bigram", rarest=15)]


#: Between the parts of a key.
GAP = "\x1f"


def keys_of(ch: Channel) -> Column:
    """A record's keys in a channel, an array: none if a part (but the country) is empty or null; repeats stay."""
    rest = [k for k in ch.keys if k != "token"]
    whole = F.lit(True)
    for k in rest:
        whole = whole & (F.col(k).isNotNull() if k in ("country", "country_norm") else F.coalesce(F.col(k) != "", F.lit(False)))
    one = lambda t: F.concat_ws(GAP, *[t if k == "token" else F.col(k) for k in ch.keys])
    if ch.explode is None:
        own = F.array(one(None))
    elif ch.explode == "token":
        own = F.transform(F.filter("name_tokens", lambda x: F.length(x) > 1), one)
    else:
        tok = F.coalesce("_rare", F.array()) if ch.rarest else F.array_sort(F.array_distinct(F.filter("name_tokens", lambda x: F.length(x) > 1)))
        later = lambda i: F.slice(tok, i + 2, F.size(tok))
        own = F.flatten(F.transform(tok, lambda x, i: F.transform(later(i), lambda y: one(F.concat_ws("|", x, y)))))
    return F.when(whole, own).otherwise(F.array().cast("array<string>"))


def _rarest(records: DataFrame, n: int, key: str = "entity_id", others: str = "int(src <> 1)") -> DataFrame:
    """records with `_rare`: the n words of each that the fewest records of sources 2 and 3 have, sorted. others: how many of these a row stands for."""
    tok = records.select(key, F.expr(others).alias("others"), "country_norm", F.explode(F.array_distinct(F.filter("name_tokens", lambda x: F.length(x) > 1))).alias("token"))
    df = tok.where("others > 0").groupBy("country_norm", "token").agg(F.sum("others").alias("df"))
    one = tok.join(df, ["country_norm", "token"], "left").withColumn("df", F.coalesce("df", F.lit(1)))
    place = F.row_number().over(W.partitionBy(key).orderBy("df", "token"))
    kept = one.withColumn("at", place).where(F.col("at") <= n).groupBy(key).agg(F.array_sort(F.collect_list("token")).alias("_rare"))
    return records.join(kept, key, "left")


def _emitted(channels: list[Channel]) -> Column:
    """A record's keys in all channels, an array of (ch, key)."""
    tagged = lambda i: lambda k: F.struct(F.lit(i).alias("ch"), k.alias("key"))
    return F.concat(*[F.transform(keys_of(c), tagged(i)) for i, c in enumerate(channels)])


def _bit(channels: list[Channel]) -> Column:
    out = F.lit(0).cast("long")
    for i in range(len(channels)):
        out = F.when(F.col("ch") == i, F.lit(1 << i).cast("long")).otherwise(out)
    return out


def matched(records: DataFrame, channels: list[Channel]) -> DataFrame:
    """(source1_entity_id, candidate_entity_id, m): the channels by which two records meet, as bits of m; a row for each meeting.

    All channels' keys are emitted in one pass as rows (channel, key) and dealt by these: the counts for the
    caps, and both sides of the join, need no other exchange. Empty and null keys meet nothing. A cap
    is part of a channel's answer: keys above it are no evidence, which also bounds what a key can pair.
    """
    for n in {c.rarest for c in channels if c.rarest}:
        records = _rarest(records, n)
    rows = records.select("entity_id", F.col("src").cast("int").alias("src"), F.explode(_emitted(channels)).alias("k")).select("entity_id", "src", "k.ch", "k.key")
    n = {i: F.count_if(F.col("src") == i) for i in (1, 2, 3)}
    counts = rows.groupBy("ch", "key").agg(*[c.alias(f"n{i}") for i, c in n.items()]).where("n1 > 0 and n2 + n3 > 0")
    keep, own = F.lit(False), F.lit(True)
    for i, c in enumerate(channels):
        here = F.col("ch") == i
        if c.scope == "own" and c.cap is not None:
            keep = F.when(here, F.col("n1") <= c.cap).otherwise(keep)
            own = F.when(here, F.when(F.col("src") == 2, F.col("n2")).otherwise(F.col("n3")) <= c.cap).otherwise(own)
        else:
            keep = F.when(here, F.lit(True) if c.cap is None else F.col("n2") + F.col("n3") <= c.cap).otherwise(keep)
    right = rows.where("src <> 1").join(counts.where(keep), ["ch", "key"]).where(own).select("ch", "key", F.col("entity_id").alias("candidate_entity_id"))
    left = rows.where("src = 1").select("ch", "key", F.col("entity_id").alias("source1_entity_id"))
    return left.join(right, ["ch", "key"]).select("source1_entity_id", "candidate_entity_id", _bit(channels).alias("m"))


def united(found: DataFrame, names: list[str]) -> DataFrame:
    """The pairs of matched() once each, with `channels` (sorted names) and `num_channels`."""
    got = found.groupBy("source1_entity_id", "candidate_entity_id").agg(F.bit_or("m").alias("m"))
    return got.select("source1_entity_id", "candidate_entity_id", *_told(names))


def _told(names: list[str]) -> tuple[Column, Column]:
    order = sorted(range(len(names)), key=names.__getitem__)
    held = F.array(*[F.when(F.col("m").bitwiseAND(F.lit(1 << i).cast("long")) != 0, names[i]) for i in order])
    return F.array_compact(held).alias("channels"), F.bit_count("m").alias("num_channels")


def pairs(records: DataFrame, ch: Channel) -> DataFrame:
    """(source1_entity_id, candidate_entity_id, channel), distinct, of one channel."""
    return matched(records, [ch]).drop("m").distinct().withColumn("channel", F.lit(ch.name))


def retrieve(records: DataFrame, channels: list[Channel]) -> DataFrame:
    """Candidates of all channels once each, with `channels` (sorted) and `num_channels`."""
    return united(matched(records, channels), [c.name for c in channels])


def retrieve_v4(records: DataFrame) -> DataFrame:
    """Candidates of all nine channels of the fourth version: V4's keys, trigrams weighted by TF-IDF, and MinHash."""
    found, names = matched(records, V4), [c.name for c in V4]
    for name, near in (("ngram_tfidf", scoring.tfidf_pairs(records)), ("minhash_lsh", scoring.minhash_pairs(records))):
        found = found.union(near.select("source1_entity_id", "candidate_entity_id", F.lit(1 << len(names)).cast("long")))
        names.append(name)
    return united(found, names)


#: The views from which all others that candidates and features need follow.
CLASS_OF = ("country_norm", "name_punct", "address_norm")


def class_id() -> Column:
    """Records with the same id have the same name, address and country, so the same keys, features and scores."""
    return F.xxhash64(*[F.coalesce(F.concat(F.lit("="), c), F.lit("")) for c in CLASS_OF])


def classes(records: DataFrame) -> DataFrame:
    """A row for each class: `cls`, its views, `one` and `other` (least entity_id in source 1, in the others), n1 and n2 (rows in these), and what ceiling() needs.

    s and t: a bit for each word of the name, of the address; ns and nt: how many different words they have. own: whether
    it has a name and records on both sides, so that it is surely a candidate of itself in class_pairs() by all channels.
    """
    views = ["country_norm", "name_punct", "name_legal", "name_sorted", "name_tokens", "name_view", "phonetic", "address_norm", "address_numbers", "postal_code", "addr_struct_key"]
    one = F.col("src") == 1
    got = records.groupBy(class_id().alias("cls")).agg(
        *[F.first(v).alias(v) for v in views], F.min(F.when(one, F.col("entity_id"))).alias("one"), F.min(F.when(~one, F.col("entity_id"))).alias("other"),
        F.count_if(one).alias("n1"), F.count_if(~one).alias("n2"),
    )
    words = {"s": F.when(F.size("name_tokens") == 0, F.array(F.lit(""))).otherwise(F.array_distinct("name_tokens")), "t": F.array_distinct(F.split("address_norm", " "))}
    bit = lambda acc, w: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(w), F.lit(64)).cast("int")))
    for k, w in words.items():
        got = got.withColumns({k: F.aggregate(w, F.lit(0).cast("long"), bit), f"n{k}": F.size(w)})
    return got.withColumns({"legal": F.xxhash64("name_legal"), "own": (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("name_punct") != "")})


#: What reach() and ceiling() need.
_NAME = ("s", "ns", "legal")
_BOUND = (*_NAME, "t", "nt")


def _side(c: DataFrame, side: str, *more: Column | str) -> DataFrame:
    """The classes with records of source 1 (side a) or of the others (b): cls as that letter, and what the bounds need."""
    return c.where("n1 > 0" if side == "a" else "n2 > 0").select(*more, F.col("cls").alias(side), *[F.col(x).alias(f"{side}_{x}") for x in (*_BOUND, "own")])


def _most_alike(x: str) -> Column:
    """No less than the Jaccard of two sets of words, from their bits.

    Words that two names share have bits that they share, so there are no more of them than such bits, and than the
    words of one name that share a bit with another of its own.
    """
    a, b, n = F.col(f"a_{x}"), F.col(f"b_{x}"), F.col(f"a_n{x}")
    both = F.least(F.bit_count(a.bitwiseAND(b)) + n - F.bit_count(a), n, F.col(f"b_n{x}"))
    return both / F.greatest(n + F.col(f"b_n{x}") - both, F.lit(1))


def _legal() -> Column:
    return F.when(F.col("a_legal") == F.col("b_legal"), 0.2).otherwise(0.0)


def ceiling() -> Column:
    """No less than features.rule_score() of a pair of classes, from their words' bits alone."""
    return 0.5 * _most_alike("s") + 0.3 * _most_alike("t") + _legal() + 1e-5


def reach() -> Column:
    """As ceiling(), whatever the addresses: the same for all classes with the two names."""
    return 0.5 * _most_alike("s") + 0.3 + _legal() + 1e-5


_BOUNDS = ("ceiling", "reach", "b_own")


def _bounds() -> list[Column | str]:
    return [ceiling().alias("ceiling"), reach().alias("reach"), "b_own"]


#: Columns that follow from country and name_punct.
_OF_NAME = ("country_norm", "name_view", "name_legal", "name_punct", "name_sorted", "token", "phonetic")


def _names(own: DataFrame) -> DataFrame:
    """A row for each country and name of classes() with `h`, whatever their addresses: its views, n1 and n2 (records), and what reach() needs."""
    views = ["country_norm", "name_punct", "name_legal", "name_sorted", "name_tokens", "name_view", "phonetic", *_NAME]
    return own.groupBy("h").agg(*[F.first(v).alias(v) for v in views], F.sum("n1").alias("n1"), F.sum("n2").alias("n2"))


def _name_side(names: DataFrame, side: str, *more: Column | str) -> DataFrame:
    return names.where("n1 > 0" if side == "a" else "n2 > 0").select(*more, F.col("h").alias(f"h{side}"), *[F.col(x).alias(f"{side}_{x}") for x in _NAME])


def _met(units: DataFrame, key: str, channels: list[Channel], at: list[int], side, told: list) -> DataFrame:
    """Pairs of units that share a key within its cap, as `told`, and m, the bit of the channel; a row for each meeting. at: the channels' bits.

    side: of the rows and a letter, what a side brings to the join. The keys are written, for the counts and both sides.
    """
    rows = units
    for n in {c.rarest for c in channels if c.rarest}:
        rows = _rarest(rows, n, key, "n2")
    kept = [c for c in units.columns if c in (key, "n1", "n2", "own", *_BOUND)]
    rows = scratch(rows.select(*kept, F.explode(_emitted(channels)).alias("k")).select(*kept, "k.ch", "k.key"))
    counts = rows.groupBy("ch", "key").agg(F.sum("n1").alias("m1"), F.sum("n2").alias("m2")).where("m1 > 0 and m2 > 0")
    keep, bit = F.lit(False), F.lit(0).cast("long")
    for i, c in enumerate(channels):
        keep = F.when(F.col("ch") == i, F.lit(True) if c.cap is None else F.col("m2") <= c.cap).otherwise(keep)
        bit = F.when(F.col("ch") == i, F.lit(1 << at[i]).cast("long")).otherwise(bit)
    right = side(rows, "b", "ch", "key").join(counts.where(keep).select("ch", "key"), ["ch", "key"])
    return side(rows, "a", "ch", "key").join(right, ["ch", "key"]).select(*told, bit.alias("m"))


def _tfidf_names(names: DataFrame, cap: int = 100, least: float = 0.25) -> DataFrame:
    """scoring.tfidf_pairs() of the names: (ha, hb) and reach. Rows that share an id are told by their own names.

    The bound is told where trigrams meet: pairs that a filter on it leaves out need no cosine.
    """
    grams = trigrams(F.col("name_punct"))
    rare = names.where("n2 > 0").select("country_norm", "n2", F.explode(grams).alias("gram")).groupBy("country_norm", "gram").agg(F.sum("n2").alias("n")).where(F.col("n") <= cap).drop("n")
    rows = names.withColumn("gram", F.explode(F.array_distinct(grams)))
    right = _name_side(rows, "b", "country_norm", "gram").join(rare, ["country_norm", "gram"])
    pool = _name_side(rows, "a", "country_norm", "gram").join(right, ["country_norm", "gram"]).select("ha", "hb", reach().alias("reach")).distinct()
    w = scratch(scoring.tfidf(names, key="h", others="n2"))
    wa, wb = (w.select(F.col("h").alias(f"h{k}"), "gram", F.col("w").alias(f"w{k}")) for k in "ab")
    cosine = F.round(F.sum(F.col("wa") * F.col("wb")), 6)
    return pool.join(wa, "ha").join(wb, ["hb", "gram"]).groupBy("ha", "hb", "reach").agg(cosine.alias("cosine")).where(F.col("cosine") >= least).drop("cosine")


def class_pairs(records: DataFrame, own: DataFrame, channels: list[Channel] | None = None) -> DataFrame:
    """Pairs (a, b) of classes(records) with records that are candidates of each other, `channels`, `num_channels`, `ceiling`, `reach` and `b_own`.

    As retrieve_v4(), or retrieve() with `channels` (none with a cap by table). The caps count records. A filter on the last three is
    one on the groups, so Spark takes it to the joins, and pairs that it leaves out go where they meet. What follows from names alone
    is told of names, once for all their addresses, and each pair of names found is then one of their classes.
    """
    keys, names = channels or V4, [c.name for c in channels or V4]
    assert all(c.scope == "others" for c in keys)
    by_name = [i for i, c in enumerate(keys) if set(c.keys) <= set(_OF_NAME)]
    by_class = [i for i in range(len(keys)) if i not in by_name]
    own = own.withColumn("h", F.xxhash64("country_norm", "name_punct"))
    named = scratch(_names(own))
    met = _met(named, "h", [keys[i] for i in by_name], by_name, _name_side, ["ha", "hb", reach().alias("reach")]) if by_name else None
    if channels is None:
        sets = scoring.gram_sets(named.withColumn("of", F.col("h"))).withColumns({"one": F.col("n1") > 0, "other": F.col("n2") > 0, "h": F.col("of")}).drop("of")
        near = scoring.near_sets(sets, of=_NAME, bounds={"reach": reach()})
        for name, pairs in (("ngram_tfidf", _tfidf_names(named)), ("minhash_lsh", near)):
            met = met.union(pairs.select("ha", "hb", "reach", F.lit(1 << len(names)).cast("long")))
            names.append(name)
    found = []
    if met is not None:
        met = met.groupBy("ha", "hb", "reach").agg(F.bit_or("m").alias("m"))
        both = met.join(_side(own, "a", F.col("h").alias("ha")), "ha").join(_side(own, "b", F.col("h").alias("hb")), "hb")
        found.append(both.select("a", "b", ceiling().alias("ceiling"), "reach", "b_own", "m"))
    if by_class:
        found.append(_met(own, "cls", [keys[i] for i in by_class], by_class, _side, ["a", "b", *_bounds()]))
    found = reduce(DataFrame.union, found)
    return found.groupBy("a", "b", *_BOUNDS).agg(F.bit_or("m").alias("m")).select("a", "b", *_BOUNDS, *_told(names))


def per_record_stats(cands: DataFrame) -> DataFrame:
    n = cands.groupBy("source1_entity_id").agg(F.count("*").alias("n"))
    p = lambda q: F.percentile("n", F.lit(q))
    return n.agg(F.count("*").alias("records"), F.avg("n").alias("mean"), p(0.5).alias("median"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.max("n").alias("most"))


def recall(cands: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs found of truth(source1_entity_id, candidate_entity_id), and records with any found."""
    found = cands.select(*truth.columns).distinct().withColumn("hit", F.lit(1))
    n = truth.join(found, truth.columns, "left").agg(
        F.count("*").alias("true_pairs"), F.countDistinct("source1_entity_id").alias("true_records"), F.count("hit").alias("found_pairs"),
        F.countDistinct(F.when(F.col("hit") == 1, F.col("source1_entity_id"))).alias("found_records"),
    )
    return n.withColumns({"pair_recall": F.try_divide("found_pairs", "true_pairs"), "any_recall": F.try_divide("found_records", "true_records")})


def missing_pairs(cands: DataFrame, truth: DataFrame) -> DataFrame:
    return truth.join(cands, truth.columns, "left_anti")


def sorted_neighbourhood(records: DataFrame, window: int = 5) -> DataFrame:
    """Pairs within `window` places of each other by sorted name, within country and first two letters."""
    block = F.substring("name_sorted", 1, 2)
    own = records.where("name_sorted <> ''").withColumn("block", block)
    near = W.partitionBy("country_norm", "block").orderBy("name_sorted", "entity_id").rowsBetween(1, window)
    own = own.withColumn("next", F.collect_list(F.struct("src", "entity_id")).over(near)).withColumn("next", F.explode("next"))
    one = own.where("(src = 1) <> (next.src = 1)")
    s1 = F.when(F.col("src") == 1, F.col("entity_id")).otherwise(F.col("next.entity_id"))
    other = F.when(F.col("src") == 1, F.col("next.entity_id")).otherwise(F.col("entity_id"))
    return one.select(s1.alias("source1_entity_id"), other.alias("candidate_entity_id")).distinct()
