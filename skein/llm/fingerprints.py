"""Document fingerprints: weighted SimHash votes and permuted block tables. Native: no Python on executors."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import by_key, first_mask, hex16, signed, table, written

#: Two counters of 32 bits in a long: the bits g and g + 32 of a hash, moved to 0 and 32.
PAIR = (1 << 32) | 1
LOW = (1 << 32) - 1
#: Six blocks of the 64 bits; three wrong bits leave three of the six whole, 31 bits or more.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))


def terms(text: Column) -> Column:
    """Lower-cased words by white space; empty ones may occur and weigh nothing."""
    low = F.lower(text)
    for c in "\n\r\t":
        low = F.replace(low, F.lit(c), F.lit(" "))
    return F.split(low, " ")


def weight(term: Column) -> Column:
    """A term's vote: by its bytes, so that short function words count little; 0 if empty."""
    n = F.octet_length(term)
    return F.when(n == 0, 0).when(n <= 3, 1).otherwise(F.least(n, F.lit(16)) - 2)


def vote(rows: DataFrame, keys: list[str], term: str) -> DataFrame:
    """keys and the SimHash `fp` (long) of each key's terms: a bit is set if over half the weight has it.

    A row in `rows` is one term. The 64 sums are kept in 32 longs, so that the aggregate stays in
    generated code; a key without weight has fingerprint 0.
    """
    h, w = F.xxhash64(term), weight(F.col(term)).cast("long")
    voted = rows.select(*keys, h.alias("h"), w.alias("w"))
    sums = [
        F.sum(F.shiftrightunsigned("h", g).bitwiseAND(F.lit(PAIR)) * F.col("w")).alias(f"s{g}") for g in range(32)
    ]
    got = voted.groupBy(*keys).agg(*sums, F.sum("w").alias("all"))
    fp = F.lit(0).cast("long")
    for g in range(32):
        low, high = F.col(f"s{g}").bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(f"s{g}", 32)
        for bit, n in ((g, low), (g + 32, high)):
            fp = fp.bitwiseOR(F.when(2 * n > F.col("all"), F.lit(signed(1 << bit))).otherwise(F.lit(0).cast("long")))
    return got.select(*keys, fp.alias("fp"))


def buckets(df: DataFrame, key: str, rows_each: int = 256, most: int = 4096) -> Column:
    """The bucket (int, rising with `key`) of a row by quantiles of `key`; nulls are in the lowest.

    There are count/rows_each buckets, or more rows in each (up to 50,000) once that exceeds `most`.
    Two levels of bounds, so that a row is compared with the square root of their number.
    """
    n = df.count()
    k = math.ceil(n / rows_each)
    if k > most:
        k = max(most, math.ceil(n / 50_000))
    if k < 2:
        return F.lit(0)
    acc = max(10_000, 4 * k)
    cuts = df.agg(F.percentile_approx(key, [i / k for i in range(1, k)], acc)).first()[0] or []
    cuts = sorted(set(cuts))
    step = max(1, math.isqrt(len(cuts)))
    parts = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    c = F.coalesce(F.col(key), F.lit(-(1 << 63)))
    heads = F.array(*[F.lit(p[0]) for p in parts]).cast("array<bigint>")
    tails = F.array(*[F.array(*map(F.lit, p)).cast("array<bigint>") for p in parts])
    at = F.size(F.filter(heads, lambda x: x <= c))
    return F.when(at == 0, 0).otherwise((at - 1) * step + F.size(F.filter(F.get(tails, at - 1), lambda x: x <= c))).cast("int")


def with_next(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as (bucket, at, ghost, doc_id, text, next_text), next by descending doc_id, cyclic.

    The texts are shuffled once, by ranges of doc_id. The first row of each range is also sent to the
    range before it, as a ghost (at the end), so no range needs another and none holds all rows.
    Equal doc_ids follow each other by text.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("bucket", buckets(docs.select("doc_id"), "doc_id"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text")]
    heads = base.groupBy("bucket").agg(F.max("doc_id").alias("head")).orderBy("bucket").collect()  # a row for each bucket
    if not heads:
        return base.selectExpr("bucket", "0 as at", "false as ghost", "doc_id", "text", "text as next_text")
    up = [*(r["bucket"] for r in heads[1:]), heads[0]["bucket"]]
    small = docs.sparkSession.createDataFrame([(r["bucket"], u, r["head"]) for r, u in zip(heads, up)], "bucket int, up int, head bigint")
    joined = base.join(F.broadcast(small), "bucket")
    is_head = F.col("doc_id").eqNullSafe(F.col("head"))
    sent = F.when(is_head, F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("g")), F.struct(F.col("up").alias("b"), F.lit(True).alias("g"))))
    sent = sent.otherwise(F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("g"))))
    rows = joined.select("doc_id", "text", F.explode(sent).alias("s")).select(
        F.col("s.b").alias("bucket"), F.col("s.g").alias("ghost"), "doc_id", "text"
    )
    w = W.partitionBy("bucket").orderBy("ghost", *order)
    return rows.select("bucket", F.row_number().over(w).alias("at"), "ghost", "doc_id", "text", F.lead("text").over(w).alias("next_text"))


def near(fps: DataFrame, radius: int = 3) -> DataFrame:
    """All pairs (a, b), a < b, of distinct fingerprints in fps(fp) that differ in `radius` (<= 3) bits at most.

    Twenty tables, one for each three of six blocks: pairs within three bits agree on three whole blocks,
    so equal keys of some table find them; a pair is kept only in the first such table.
    """
    if radius > 3:
        raise ValueError("the tables are made for three bits at most")
    mask = [signed(((1 << n) - 1) << s) for s, n in BLOCKS]
    pairs = [signed((a | b | c) & ((1 << 64) - 1)) for a, b, c in combinations(mask, 3)]
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in pairs])).alias("t", "k"))
    left, right = keyed.withColumnRenamed("fp", "a"), keyed.withColumnRenamed("fp", "b")
    x = F.col("a").bitwiseXOR(F.col("b"))
    hit = (F.col("a") < F.col("b")) & (F.bit_count(x) <= radius) & (first_mask(x, pairs) == F.col("t"))
    return left.join(right, ["t", "k"]).where(hit).select("a", "b")


def neighbours(rows: DataFrame, radius: int = 3) -> DataFrame:
    """rows(fp, ...) with n_near: how many other rows have a fingerprint within `radius` bits (0 included).

    Rows of one fingerprint are counted, never paired; only fingerprints that differ are.
    """
    counted = written(rows.groupBy("fp").agg(F.count("*").alias("n")))
    pairs = near(counted.select("fp"), radius)
    both = pairs.union(pairs.select("b", "a")).toDF("fp", "other")
    more = both.join(counted.withColumnRenamed("fp", "other"), "other").groupBy("fp").agg(F.sum("n").alias("more"))
    n = counted.join(more, "fp", "left").select("fp", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_near"), "n")
    return by_key(rows, written(n), "fp", "n").drop("n")


def edited_fingerprints(docs: DataFrame, radius: int = 3) -> DataFrame:
    """The contract's row for each document: its fingerprint, its edited text's, their likeness, n_near.

    Likeness is 1 - differing bits / 64. Null texts count as empty (fingerprint 0); repeated rows and
    ids stay as rows of their own, those without a doc_id come last; other columns are ignored.
    """
    seq = with_next(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    digest = F.sha2("edited", 256)
    part = lambda i: F.conv(F.substr(digest, F.lit(16 * i + 1), F.lit(16)), 16, -10).cast("long")
    ids = ["bucket", "at", "ghost", "doc_id", "n_chars", "d0", "d1", "d2", "d3"]
    rows = seq.select("*", n.cast("long").alias("n_chars"), edited.alias("edited")).withColumns({f"d{i}": part(i) for i in range(4)})
    both = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))
    split = rows.select(*ids, F.explode(both).alias("b")).select(*ids, "b.kind", F.explode(terms(F.col("b.t"))).alias("term"))
    fps = vote(split, [*ids, "kind"], "term").groupBy(*ids).agg(
        F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("efp")
    )
    fps = fps.withColumn("nfp", F.lead("fp").over(W.partitionBy("bucket").orderBy("at"))).where("not ghost")
    like = lambda c: 1 - F.bit_count(F.col("fp").bitwiseXOR(F.col(c))) / 64.0
    out = written(fps.select(
        "doc_id", "n_chars", F.concat(*[hex16(F.col(f"d{i}")) for i in range(4)]).alias("edited_sha256"), "fp", "efp",
        like("efp").alias("near_edited"), like("nfp").alias("near_next"),
    ))
    return neighbours(out, radius).select(
        "doc_id", "n_chars", "edited_sha256", hex16(F.col("fp")).alias("fingerprint"),
        hex16(F.col("efp")).alias("edited_fingerprint"), "near_edited", "near_next", "n_near",
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's row for each document, by edited_fingerprints() over the whole table."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))
