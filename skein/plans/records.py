"""Three sources of records from the table of documents, and the true links between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import normalised
from skein.sources.tables import scratch


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each document with an id: its first six words are the name, its size makes the address."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null")
    size = F.expr("concat(n_chars div 25, ' ', lang, ' st ', 10000 + n_chars div 100)")
    src = (F.pmod("doc_id", F.lit(3)) + 1).cast("int")
    return d.select(
        F.concat(F.lit("S"), src, F.lit("-"), F.col("doc_id")).alias("entity_id"), "doc_id", src.alias("src"),
        F.coalesce(F.regexp_extract("text", r"^[ \t\n\r]*([^ \t\n\r]+(?:[ \t\n\r]+[^ \t\n\r]+){0,5})", 1), F.lit("")).alias("business_name"),
        F.coalesce(size, F.lit("")).alias("business_address"), F.coalesce("lang", F.lit("")).alias("country"), F.md5("text").alias("digest"),
    )


def normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records with all views, written once: what follows reads them as often as it likes."""
    return scratch(normalised(records(spark, sf_dir).drop("digest")))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source1_entity_id, candidate_entity_id): records of equal whole texts; of several owners the least id."""
    r = records(spark, sf_dir).where("digest is not null").select("entity_id", "doc_id", "src", "digest")
    own = r.where("src = 1").groupBy("digest").agg(F.min("doc_id").alias("owner"))
    return r.where("src <> 1").join(own, "digest").select(F.concat(F.lit("S1-"), F.col("owner")).alias("source1_entity_id"), F.col("entity_id").alias("candidate_entity_id"))


#: Parts of the made-up firms: names with legal forms, marks and web endings; addresses with ordinals, boxes and units.
FRONT = ("Acme", "Blue River", "Café", "Smith & Sons", "--Nord", "Zürich", "Data.com", "O'Neil", "R+D", "SMYTHE", "naïve")
STEM = ("Foods", "Trading", "Tools and Parts", "Bakery", "Optics", "Freight-Line", "Solutions", "Åkerlund", "99 Bottles")
FORM = ("Inc.", "Corp.", "Ltd", "L.L.C", "LLC", "GmbH", "Company", "Holdings Group", "Pvt. Limited", "", "dba Acme", "Co, International", "")
ORDINAL = ("st", "nd", "rd", "th", "")
STREET = ("Main", "King's", "Río Grande", "Oak", "", "Old Mill")
KIND = ("St.", "Ave", "Blvd.", "Rd", "P.O. Box 55", "Ln Apt 3", "Dr., Ste 9", "near the park", "ct")
COUNTRY = ("US", " DE ", "fr", "", "us", "nan", "in")


def firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each customer, with a made-up name and address, and planted faults: blank, repeated and foreign ids.

    `digest` is the same for records of one firm, whatever its legal form.
    """
    d = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"))
    part = lambda words, by=1: F.element_at(F.array(*map(F.lit, words)), (F.floor(F.col("k") / by) % len(words) + 1).cast("int"))
    src = (F.col("k") % 3 + 1).cast("int")
    ident = F.when(F.col("k") % 97 == 0, "").when(F.col("k") % 101 == 0, F.concat(F.lit("X-"), "k")).when(F.col("k") % 89 == 0, F.concat(F.lit("S"), src, F.lit("-"), F.col("k") - 3))
    ident = ident.when(F.col("k") % 103 == 0, F.concat(F.lit("S1-"), F.col("k") - F.col("k") % 3)).otherwise(F.concat(F.lit("S"), src, F.lit("-"), F.col("k")))
    firm = F.floor(F.col("k") / 4)
    name = lambda words, by: F.element_at(F.array(*map(F.lit, words)), (F.floor(firm / by) % len(words) + 1).cast("int"))
    return d.select(
        ident.alias("entity_id"), F.col("k").alias("doc_id"), src.alias("src"),
        F.concat_ws(" ", name(FRONT, 1), name(STEM, 11), part(FORM)).alias("business_name"),
        F.concat(F.concat(firm % 997 + 1, name(ORDINAL, 1)), F.lit(" "), name(STREET, 2), F.lit(" "), part(KIND, 2), F.lit(", "), 10000 + firm % 90000).alias("business_address"),
        name(COUNTRY, 3).alias("country"), F.md5(F.concat_ws("|", name(FRONT, 1), name(STEM, 11), firm)).alias("digest"),
    )


def firms_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scratch(normalised(firms(spark, sf_dir).drop("digest")))


def links(rows: DataFrame) -> DataFrame:
    """(source1_entity_id, candidate_entity_id): rows of equal digest; of several owners the least doc_id."""
    own = rows.where("src = 1 and digest is not null").groupBy("digest").agg(F.min_by("entity_id", "doc_id").alias("source1_entity_id"))
    return rows.where("src <> 1").join(own, "digest").select("source1_entity_id", F.col("entity_id").alias("candidate_entity_id"))
