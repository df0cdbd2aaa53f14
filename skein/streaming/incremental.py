"""Linkage of arriving records against a static index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import normalised


def linked(arriving: DataFrame, index: DataFrame, keys: tuple[str, ...] = ("country_norm", "name_legal")) -> DataFrame:
    """A stream of source-1 records joined to the static normalised records of sources 2 and 3; stateless."""
    known = index.where("src <> 1").select(*keys, F.col("entity_id").alias("candidate_entity_id"))
    left = normalised(arriving).where(F.col(keys[-1]) != "").select(*keys, F.col("entity_id").alias("source1_entity_id"))
    return left.join(known, list(keys)).select("source1_entity_id", "candidate_entity_id")
