"""A linker that learns: split the records, balance the pairs, fit, choose the threshold, decide; saved and loaded."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import decision, scoring
from skein.sources.tables import scratch

S1 = "source1_entity_id"


@dataclass
class Linker:
    """A fitted model, the features it reads, and the score from which a pair is a match."""

    model: PipelineModel
    features: list[str]
    threshold: float = 0.5

    def scored(self, pairs: DataFrame) -> DataFrame:
        return scoring.scored(self.model, pairs)

    def decided(self, ids: DataFrame, pairs: DataFrame) -> DataFrame:
        """Each id of ids(source1_entity_id) with its matches; a candidate goes to the record that scores it best."""
        found = decision.best_owner(decision.accepted(self.scored(pairs), self.threshold))
        return decision.listed(ids, found, "matched_entity_ids")

    def save(self, path: str) -> None:
        """The model and what belongs to it as two folders below path; older ones are replaced."""
        self.model.write().overwrite().save(f"{path}/model")
        own = SparkSession.active().createDataFrame([(self.features, self.threshold)], "features array<string>, threshold double")
        own.coalesce(1).write.mode("overwrite").json(f"{path}/linker")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Linker:
        own = spark.read.schema("features array<string>, threshold double").json(f"{path}/linker").first()
        return Linker(PipelineModel.load(f"{path}/model"), list(own.features), own.threshold)


def held_out(ids: DataFrame, share: float = 0.2) -> DataFrame:
    """(source1_entity_id, validation): a fixed share of the records, by draw()."""
    return scratch(scoring.split(ids.select(F.col(S1).alias("entity_id")), share).withColumnRenamed("entity_id", S1))


def learned(pairs: DataFrame, parts: DataFrame, names: list[str], kind: str = "gbt") -> Linker:
    """A linker without a chosen threshold, from labelled pairs with all features `names`.

    Trees grow from the balanced pairs of the records in training; all pairs of the others end the rounds. Other
    models have no use for these.
    """
    rows = pairs.join(parts, S1)
    chosen = scoring.training_set(rows.where("not validation"))
    if kind == "gbt":
        chosen = chosen.unionByName(rows.where("validation"))
    return Linker(scoring.fit(scratch(chosen), names, kind, held="validation"), names)


def tuned(linker: Linker, pairs: DataFrame, parts: DataFrame, truth: DataFrame) -> Linker:
    """The linker with the threshold of best macro F0.5 on the records held out; without such records as it was."""
    ids = parts.where("validation").select(S1)
    if ids.isEmpty():
        return linker
    own = scratch(linker.scored(pairs.join(ids, S1, "left_semi")).select(S1, decision.C, "score"))
    known = scratch(truth.join(ids, S1, "left_semi"))
    return Linker(linker.model, linker.features, decision.best_threshold(ids, known, own))


def measured(linker: Linker, pairs: DataFrame, parts: DataFrame, truth: DataFrame) -> DataFrame:
    """The threshold and the macro measures on the records held out. The threshold was chosen on the same records, so F0.5 is its best there."""
    ids = parts.where("validation").select(S1)
    found = decision.accepted(linker.scored(pairs.join(ids, S1, "left_semi")), linker.threshold)
    return decision.macro(decision.outcome(ids, truth.join(ids, S1, "left_semi"), found)).withColumn("threshold", F.lit(linker.threshold))
