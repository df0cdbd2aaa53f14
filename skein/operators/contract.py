"""Checks of the input tables and of the output lists; each gives one row of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.sources.tables import RECORD, TRUTH, id_list


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "") | F.lower(c).isin("nan", "none")


def source(df: DataFrame, prefix: str) -> DataFrame:
    """Missing values by column, duplicate rows and ids, ids without the prefix; failed: whether an id fault occurs.

    Raises ValueError for missing columns. Null and blank ids count as missing, not as duplicates.
    """
    if lost := [c for c in RECORD if c not in df.columns]:
        raise ValueError(f"Missing required columns: {lost}")
    ok = ~blank(F.col("entity_id"))
    n = df.agg(
        F.count("*").alias("rows"), *[F.count_if(blank(F.col(c))).alias(f"missing_{c}") for c in RECORD],
        (F.count("*") - F.countDistinct(F.struct(*[F.coalesce(c, F.lit("")) for c in RECORD]))).alias("duplicate_rows"),
        (F.count_if(ok) - F.countDistinct(F.when(ok, F.col("entity_id")))).alias("duplicate_ids"),
        F.count_if(ok & ~F.col("entity_id").startswith(prefix)).alias("wrong_prefix"),
    )
    return n.withColumn("failed", (F.col("missing_entity_id") + F.col("duplicate_ids") + F.col("wrong_prefix")) > 0)


def countries(df: DataFrame) -> DataFrame:
    return df.where(~blank(F.col("country"))).groupBy("country").agg(F.count("*").alias("rows"))


def truth(gt: DataFrame, s1: DataFrame, others: DataFrame) -> DataFrame:
    """Faults of the truth table: ids missing, repeated, unknown; references unknown or repeated in a row."""
    if lost := [c for c in TRUTH if c not in gt.columns]:
        raise ValueError(f"Missing required columns: {lost}")
    ids = gt.withColumns({"ids": id_list(F.col("matched_entity_ids")), "ok": ~blank(F.col("source1_entity_id"))})
    known1 = s1.select(F.col("entity_id").alias("source1_entity_id")).distinct().withColumn("known", F.lit(1))
    n = ids.join(known1, "source1_entity_id", "left").agg(
        F.count_if(~F.col("ok")).alias("missing_ids"), (F.count_if("ok") - F.countDistinct(F.when(F.col("ok"), F.col("source1_entity_id")))).alias("duplicate_ids"),
        F.count_if(F.col("ok") & F.col("known").isNull()).alias("unknown_ids"), F.count_if(F.size("ids") == 0).alias("empty_rows"), F.count_if(F.size("ids") > 0).alias("filled_rows"),
        F.count_if(F.size("ids") != F.size(F.array_distinct("ids"))).alias("duplicate_references_in_row"),
    )
    known = others.select(F.col("entity_id").alias("id")).distinct().withColumn("known", F.lit(1))
    refs = ids.select(F.explode("ids").alias("id")).join(known, "id", "left")
    valid = F.col("known").isNotNull() & F.col("id").rlike("^S[23]-")
    m = refs.agg(F.count_if(F.col("id").startswith("S2-")).alias("s2_references"), F.count_if(F.col("id").startswith("S3-")).alias("s3_references"), F.count_if(~valid).alias("invalid_references"))
    both = n.withColumn("one", F.lit(1)).join(m.withColumn("one", F.lit(1)), "one").drop("one")
    bad = sum((F.col(c) for c in ("duplicate_ids", "unknown_ids", "duplicate_references_in_row", "invalid_references")), F.col("missing_ids"))
    return both.withColumn("failed", bad > 0)


def separation(s1: DataFrame, s2: DataFrame, s3: DataFrame) -> DataFrame:
    """Ids that occur in two sources."""
    own = [s.select("entity_id").distinct().withColumn("s", F.lit(i)) for i, s in enumerate((s1, s2, s3), 1)]
    held = own[0].union(own[1]).union(own[2]).groupBy("entity_id").agg(F.collect_set("s").alias("s"))
    has = lambda a, b: F.count_if(F.array_contains("s", a) & F.array_contains("s", b))
    return held.agg(has(1, 2).alias("s1_s2_overlap"), has(1, 3).alias("s1_s3_overlap"), has(2, 3).alias("s2_s3_overlap"))


def owners(gt_links: DataFrame) -> DataFrame:
    """Candidates that more than one record claims."""
    return gt_links.groupBy("candidate_entity_id").agg(F.countDistinct("source1_entity_id").alias("owners")).where("owners > 1")


def output(lines: DataFrame, header: str, s1: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """Faults of an output file's lines(value): header, tabs, repeated rows and ids, own-source or wrong prefixes, unknown, missing and extra ids."""
    rows = lines.where(F.col("value") != header)
    cut = F.split("value", "\t")
    good = rows.where(F.col("value").contains("\t")).select(cut[0].alias("source1_entity_id"), id_list(cut[1]).alias("ids"))
    n = lines.agg(F.count_if(F.col("value") == header).alias("headers"), F.count_if((F.col("value") != header) & ~F.col("value").contains("\t")).alias("malformed_rows"))
    want = s1.select(F.col("entity_id").alias("source1_entity_id")).distinct().withColumn("wanted", F.lit(1))
    per = good.groupBy("source1_entity_id").agg(F.count("*").alias("k"), F.sum((F.size("ids") - F.size(F.array_distinct("ids")))).alias("twice"))
    m = per.join(want, "source1_entity_id", "full").agg(
        F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("duplicate_rows"), F.coalesce(F.sum("twice"), F.lit(0)).alias("duplicate_ids"),
        F.count_if(F.col("k").isNull()).alias("missing_rows"), F.count_if(F.col("wanted").isNull()).alias("extra_rows"),
    )
    refs = good.select(F.explode("ids").alias("entity_id"))
    known = (valid if valid is not None else refs).select("entity_id").distinct().withColumn("known", F.lit(1))
    r = refs.join(known, "entity_id", "left").agg(
        F.count_if(F.col("entity_id").startswith("S1-")).alias("self_matches"), F.count_if(~F.col("entity_id").rlike("^S[123]-")).alias("wrong_prefix"), F.count_if(F.col("known").isNull()).alias("unknown_ids")
    )
    one = lambda d: d.withColumn("one", F.lit(1))
    return one(n).join(one(m), "one").join(one(r), "one").drop("one")


def matches_outside(matches: DataFrame, cands: DataFrame) -> DataFrame:
    """Matches that are no candidates."""
    return matches.join(cands, ["source1_entity_id", "candidate_entity_id"], "left_anti")
