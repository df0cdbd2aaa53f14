"""What went wrong and where: retrieval over all records, link counts, missing pairs, distributions, partitions of the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import decision
from skein.operators.profile import simple

S1, C = "source1_entity_id", "candidate_entity_id"


def recall_over_all(ids: DataFrame, truth: DataFrame, cands: DataFrame) -> DataFrame:
    """Pair recall, and shares of all records with every true match among the candidates, and with any; none true counts as found."""
    n = decision.outcome(ids, truth, cands)
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    none = F.col("n_true") == 0
    return n.agg(
        F.count("*").alias("records"), F.round(F.coalesce(F.try_divide(F.sum("n_both"), F.sum("n_true")), F.lit(1.0)), 6).alias("pair_recall"),
        share(F.col("n_both") == F.col("n_true")).alias("entity_recall"), share(none | (F.col("n_both") > 0)).alias("any_recall"),
    )


def links_by_source(truth: DataFrame, found: DataFrame) -> DataFrame:
    """True links to each other source, and how many of them were found."""
    f = found.select(S1, C).distinct().withColumn("hit", F.lit(1))
    own = truth.select(S1, C).distinct().join(f, [S1, C], "left")
    return own.groupBy(F.substring_index(C, "-", 1).alias("source")).agg(F.count("*").alias("links"), F.count("hit").alias("found"))


def bottleneck(causes: DataFrame) -> DataFrame:
    """One row from decision.decomposed(): the stage with more faulty records; on a tie the model."""
    n = lambda k: F.coalesce(F.sum(F.when(F.col("cause") == k, F.col("records"))), F.lit(0))
    return causes.agg(n("retrieval").alias("retrieval"), n("model").alias("model")).withColumn("bottleneck", F.when(F.col("retrieval") > F.col("model"), "RETRIEVAL").otherwise("MODELING"))


def size_shares(cands: DataFrame, ids: DataFrame) -> DataFrame:
    """Records, and their share of all, by class of number of candidates."""
    n = ids.select(S1).distinct().join(cands.groupBy(S1).agg(F.count("*").alias("n")), S1, "left").na.fill(0)
    by = n.groupBy(decision.size_class(F.col("n")).alias("candidates")).agg(F.count("*").alias("records"))
    every = by.agg(F.sum("records").alias("every"))
    return by.join(F.broadcast(every)).select("candidates", "records", F.round(F.col("records") / F.col("every"), 6).alias("share"))  # one row


def missing_enriched(missing: DataFrame, records: DataFrame) -> DataFrame:
    """Missing pairs with both records' names, addresses and countries, the other's with the suffix _r."""
    cols = ("business_name", "business_address", "country")
    left = records.select(F.col("entity_id").alias(S1), *cols)
    right = records.select(F.col("entity_id").alias(C), *[F.col(c).alias(f"{c}_r") for c in cols])
    return missing.join(left, S1, "left").join(right, C, "left").select(S1, C, *cols, *[f"{c}_r" for c in cols])


def missing_by_country(enriched: DataFrame, examples: int = 3) -> DataFrame:
    """Missing pairs by the record's country, with the first few of them."""
    own = enriched.withColumns({"p": F.concat_ws(">", S1, C), "country": F.coalesce("country", F.lit(""))})
    place = F.expr("row_number() over (partition by country order by p)")
    few = own.withColumn("at", place).where(F.col("at") <= examples)
    some = few.groupBy("country").agg(F.array_join(F.array_sort(F.collect_list("p")), ",").alias("examples"))
    return own.groupBy("country").agg(F.count("*").alias("pairs")).join(some, "country", "left")


def match_distribution(ids: DataFrame, truth: DataFrame) -> DataFrame:
    """Records by kind: no match, one, several, and whether these are in source 2, 3 or both."""
    n = truth.select(S1, C).distinct().groupBy(S1).agg(F.count_if(F.col(C).startswith("S2-")).alias("s2"), F.count_if(F.col(C).startswith("S3-")).alias("s3"))
    own = ids.select(S1).distinct().join(n, S1, "left").na.fill(0)
    total = F.col("s2") + F.col("s3")
    kind = F.when(total == 0, "zero").when(total == 1, "single").otherwise("multiple")
    where = F.when((F.col("s2") > 0) & (F.col("s3") > 0), "both").when(F.col("s2") > 0, "S2").when(F.col("s3") > 0, "S3").otherwise("none")
    return own.groupBy(kind.alias("matches"), where.alias("sources")).agg(F.count("*").alias("records"))


def rate_by_country(s1: DataFrame, truth: DataFrame) -> DataFrame:
    """Of each country's records of source 1, the share with a match."""
    hit = truth.select(F.col(S1).alias("entity_id")).distinct().withColumn("hit", F.lit(1))
    own = s1.select("entity_id", "country").join(hit, "entity_id", "left")
    return own.groupBy("country").agg(F.count("*").alias("records"), F.count("hit").alias("matched"), F.round(F.count("hit") / F.count("*"), 6).alias("rate"))


def shared_names(records: DataFrame, least: int = 10) -> DataFrame:
    """Names that occur over `least` times in all sources together, with the sources that have them."""
    own = records.select(simple(F.col("business_name")).alias("name"), "src").where("name <> ''")
    return own.groupBy("name").agg(F.count("*").alias("rows"), F.countDistinct("src").alias("sources")).where(F.col("rows") > least)


def country_pivot(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of each country in each named table, side by side; 0 where it has none."""
    out = None
    for name, df in parts.items():
        one = df.select("country", F.lit(name).alias("part"))
        out = one if out is None else out.union(one)
    return out.groupBy("country").pivot("part", list(parts)).count().na.fill(0)


def partition(truth: DataFrame, assigned: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(training pairs, validation pairs, manifest) of truth by assigned(entity_id, validation).

    The manifest counts records and pairs of both parts; a record is in one part alone, as its id is.
    """
    own = truth.join(assigned.withColumnRenamed("entity_id", S1), S1)
    ids = assigned.groupBy("validation").agg(F.countDistinct("entity_id").alias("records"))
    pairs = own.groupBy("validation").agg(F.count("*").alias("pairs"))
    manifest = ids.join(pairs, "validation", "left").na.fill(0, ["pairs"])
    return own.where("not validation").select(S1, C), own.where("validation").select(S1, C), manifest


def only(rows: DataFrame, ids: DataFrame, key: str = "entity_id") -> DataFrame:
    """The rows whose key is among ids(key)."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")
