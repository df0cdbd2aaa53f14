"""Features of candidate pairs: equality, length, provenance, token sets, string similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.similarity import fuzz_ratio, names_alike

VIEWS = ("name_punct", "name_legal", "name_sorted", "name_tokens", "address_norm", "address_numbers", "country_norm")
#: Feature name to the channels that set it.
PROVENANCE = {"name": ("exact_name", "exact_name_rare"), "addr": ("exact_addr", "address_rare"), "punct": ("exact_punct",), "token": ("token",),
              "bigram": ("bigram",), "phonetic": ("phonetic",), "sorted": ("sorted_name",), "postal": ("postal", "tok_postal")}
CHEAP = ["exact_name_match", "exact_legal_match", "sorted_name_match", "exact_address_match", "country_match", "addr_nums_match", "name_len_diff", "name_len_ratio",
         "addr_len_diff", *[f"retrieved_by_{k}" for k in PROVENANCE], "num_channels", "name_jaccard", "name_containment", "name_shared_tokens", "addr_jaccard",
         "addr_containment", "addr_shared_tokens"]
COSTLY = ["name_fuzz_ratio", "name_partial_ratio", "name_jaro_winkler", "addr_fuzz_ratio"]


def with_records(cands: DataFrame, records: DataFrame) -> DataFrame:
    """Candidates with both records' views, as l_ and r_ columns; ids without a record have nulls."""
    side = lambda p, key: records.select(F.col("entity_id").alias(key), *[F.col(v).alias(p + v) for v in VIEWS])
    return cands.join(side("l_", "source1_entity_id"), "source1_entity_id", "left").join(side("r_", "candidate_entity_id"), "candidate_entity_id", "left")


def _sets(a: Column, b: Column) -> tuple[Column, Column, Column]:
    both = F.size(F.array_intersect(a, b)).cast("double")
    return both / F.greatest(F.size(F.array_union(a, b)), F.lit(1)), both / F.greatest(F.size(a), F.lit(1)), both


def cheap(pairs: DataFrame) -> DataFrame:
    """JVM-side features of pairs from with_records(). Two empty names are equal and have Jaccard 1."""
    same = lambda v: (F.col(f"l_{v}") == F.col(f"r_{v}")).cast("int")
    size = lambda c: F.length(c).cast("double")
    filled = lambda c: F.when(F.size(c) == 0, F.array(F.lit(""))).otherwise(F.col(c))
    cut = lambda c: F.split(c, " ")
    name, addr = _sets(filled("l_name_tokens"), filled("r_name_tokens")), _sets(cut("l_address_norm"), cut("r_address_norm"))
    cols = {
        "exact_name_match": same("name_punct"), "exact_legal_match": same("name_legal"), "sorted_name_match": same("name_sorted"), "exact_address_match": same("address_norm"),
        "country_match": same("country_norm"), "addr_nums_match": same("address_numbers"), "name_len_diff": F.abs(size("l_name_punct") - size("r_name_punct")),
        "name_len_ratio": F.coalesce(F.try_divide(size("l_name_punct"), size("r_name_punct")), F.lit(0.0)), "addr_len_diff": F.abs(size("l_address_norm") - size("r_address_norm")),
    }
    cols |= {f"retrieved_by_{k}": F.arrays_overlap("channels", F.array(*map(F.lit, v))).cast("int") for k, v in PROVENANCE.items()}
    for k, (jaccard, held, both) in (("name", name), ("addr", addr)):
        cols |= {f"{k}_jaccard": jaccard, f"{k}_containment": held, f"{k}_shared_tokens": both}
    return pairs.withColumns(cols)


def costly(pairs: DataFrame) -> DataFrame:
    """The kernels in Python, in one Arrow stage behind the cheap features."""
    n = names_alike("l_name_punct", "r_name_punct")
    return pairs.withColumns(
        {"name_fuzz_ratio": n["ratio"], "name_partial_ratio": n["partial"], "name_jaro_winkler": n["winkler"], "addr_fuzz_ratio": fuzz_ratio("l_address_norm", "r_address_norm")}
    )


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    known = truth.select("source1_entity_id", "candidate_entity_id").distinct().withColumn("label", F.lit(1))
    return pairs.join(known, ["source1_entity_id", "candidate_entity_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def rule_score() -> Column:
    """A score without a model, from token sets and the name."""
    return F.round(0.5 * F.col("name_jaccard") + 0.3 * F.col("addr_jaccard") + 0.2 * F.col("exact_legal_match"), 6)
