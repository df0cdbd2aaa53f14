"""Profiles of record tables, all one aggregate each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import LEGAL

#: Patterns whose share in names or addresses is reported.
NAME_PATTERNS = {
    "non_ascii": r"[^\x00-\x7F]", "devanagari": r"[ऀ-ॿ]", "accented": r"[àâäéèêëïîôùûüÿçœæÀÂÄÉÈÊËÏÎÔÙÛÜŸÇŒÆ]", "odd_marks": r"[<>{}|\\~`]",
    "ampersand": "&", "word_and": r"(?i)\band\b", "domain": r"(?i)\.(com|net|org|io|co|in)\b", "dba": r"(?i)\bdba\b|d/b/a|doing business as", "leading_mark": r"^[^a-zA-Z0-9ऀ-ॿ]",
    "legal": rf"(?i)\b({LEGAL})\b", "period": r"\.", "comma": ",", "hyphen": "-", "slash": "/",
}
ADDRESS_PATTERNS = {"number": r"\d", "five_digits": r"\b\d{5}\b", "six_digits": r"\b\d{6}\b", "po_box": r"(?i)\bp\.?\s*o\.?\s*box\b", "unit": r"(?i)\b(apt|apartment|suite|ste|unit|flat)\b", "landmark": r"(?i)\b(near|opp|opposite|behind|beside)\b"}


def overview(df: DataFrame) -> DataFrame:
    every = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    return df.agg(F.count("*").alias("rows"), F.countDistinct("entity_id").alias("ids"), (F.count("entity_id") - F.countDistinct("entity_id")).alias("duplicate_ids"), (F.count("*") - F.countDistinct(every)).alias("duplicate_rows"))


def missing(df: DataFrame, *cols: str) -> DataFrame:
    out = []
    for c in cols:
        x = F.col(c)
        out += [F.count_if(x.isNull()).alias(f"{c}_null"), F.count_if(x == "").alias(f"{c}_empty"), F.count_if((x != "") & (F.trim(x) == "")).alias(f"{c}_blank")]
    return df.agg(*out)


def lengths(df: DataFrame, c: str, *by: str) -> DataFrame:
    n = F.length(F.coalesce(c, F.lit("")))
    return df.groupBy(*by).agg(
        F.count("*").alias("rows"), F.round(F.avg(n), 6).alias("mean"), F.percentile(n, F.lit(0.5)).alias("median"), F.min(n).alias("least"), F.max(n).alias("most"),
        F.count_if(n <= 3).alias("short"), F.count_if(n > 100).alias("over_100"), F.count_if(n > 200).alias("over_200"),
    )


def patterns(df: DataFrame, c: str, which: dict[str, str]) -> DataFrame:
    return df.agg(*[F.count_if(F.coalesce(F.col(c), F.lit("")).rlike(p)).alias(k) for k, p in which.items()])


def capitals(df: DataFrame, c: str = "business_name") -> DataFrame:
    x = F.coalesce(F.col(c), F.lit(""))
    kind = F.when(x.rlike("[A-Z]") & ~x.rlike("[a-z]"), "upper").when(x.rlike("[a-z]") & ~x.rlike("[A-Z]"), "lower").otherwise("mixed")
    return df.groupBy(kind.alias("capitals")).agg(F.count("*").alias("rows"))


def repeated(df: DataFrame, c: str, least: int = 2) -> DataFrame:
    return df.where(F.col(c) != "").groupBy(c).agg(F.count("*").alias("rows")).where(F.col("rows") >= least)


def new_values(test: DataFrame, train: DataFrame, c: str = "country") -> DataFrame:
    return test.select(c).distinct().join(train.select(c).distinct(), c, "left_anti")


def simple(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))


def overlap(a: Column, b: Column, cut: str = " ") -> Column:
    """Jaccard of the words ('' as cut: of the characters); 0 if either is empty."""
    x, y = (F.filter(F.split(v, cut), lambda t: t != "") for v in (a, b))
    both = F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))
    return F.when((a == "") | (b == ""), 0.0).otherwise(both)


def difficulty(pairs: DataFrame) -> DataFrame:
    """True pairs by the words their names share: easy over 0.8, medium from 0.3, hard below."""
    o = overlap(simple(F.col("l_business_name")), simple(F.col("r_business_name")))
    return pairs.withColumn("o", o).groupBy(F.when(F.col("o") > 0.8, "easy").when(F.col("o") >= 0.3, "medium").otherwise("hard").alias("difficulty")).agg(F.count("*").alias("pairs"), F.round(F.avg("o"), 6).alias("mean_overlap"))
