"""Models see string similarity, and names near in spelling alone are hard negatives."""

import random

import pytest

from skein.operators import decision, features, scoring
from skein.plans import catalog, training

PAIRS = "source1_entity_id string, candidate_entity_id string, l_name_punct string, r_name_punct string, l_address_norm string, r_address_norm string, name_jaccard double, exact_address_match int, addr_jaccard double, num_channels int, label int"


def _pairs(spark):
    rows = [("S1-1", "S2-1", "jonathan", "jonathon", "1 a", "2 b", 0.0, 0, 0.0, 1, 0), ("S1-2", "S2-2", "acme", "zulu", "1 a", "2 b", 0.0, 0, 0.0, 1, 0), ("S1-3", "S2-3", "acme", "acme", "1 a", "1 a", 1.0, 1, 1.0, 3, 1)]
    return spark.createDataFrame(rows, PAIRS)


def test_names_near_in_spelling_are_mined(spark):
    got = scoring.hard_negatives(features.costly(_pairs(spark))).collect()
    assert [r.candidate_entity_id for r in got] == ["S2-1"]
    with pytest.raises(Exception, match="name_fuzz_ratio"):
        scoring.hard_negatives(_pairs(spark)).collect()


def test_training_pairs_are_chosen_in_one_pass(spark):
    own = _pairs(spark).unionByName(spark.createDataFrame([("S1-4", "S2-4", "x", "y", "1 a", "2 b", None, 0, 0.0, 1, 0), ("S1-5", "S2-5", "x", "y", "1 a", "2 b", None, 1, 0.0, 1, 0)], PAIRS))
    got = scoring.training_set(features.costly(own), per_positive=0)
    assert sorted(r.candidate_entity_id for r in got.collect()) == ["S2-1", "S2-3", "S2-5"]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert scoring.training_set(features.costly(own), per_positive=9).count() == 5


def test_labelled_pairs_are_told_by_classes(spark, monkeypatch):
    d, told = "/root/testdata/sf0.001", []
    costly = features.costly
    monkeypatch.setattr(features, "costly", lambda pairs: told.append(pairs.count()) or costly(pairs))
    got = catalog._labelled(spark, d)
    rows = got.count()
    assert told[0] < rows
    plain = features.labelled(costly(catalog._pairs(spark, d)), catalog.truth(spark, d)).select(got.columns)
    assert rows == plain.count() and got.exceptAll(plain).count() == 0


def test_models_without_rounds_learn_from_no_held_out_pair(spark, made, monkeypatch):
    pairs, parts, _ = made
    seen = {}
    monkeypatch.setattr(scoring, "fit", lambda train, names, kind, held: seen.update({kind: train.where(held).count()}))
    for kind in ("lr", "gbt"):
        training.learned(pairs, parts, ["x", "noise"], kind)
    assert seen == {"lr": 0, "gbt": 240}


def test_models_train_on_every_feature(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(catalog, "_pairs", lambda s, d, retrieve: _pairs(s).drop("label"))
    monkeypatch.setattr(catalog, "_ids", lambda s, d: spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "source1_entity_id string"))
    monkeypatch.setattr(catalog, "truth", lambda s, d: spark.createDataFrame([("S1-3", "S2-3")], "source1_entity_id string, candidate_entity_id string"))
    monkeypatch.setattr(scoring, "fit", lambda train, names, kind, held: seen.update(names=names, train={r.candidate_entity_id for r in train.collect()}))
    monkeypatch.setattr(scoring, "scored", lambda model, rows: rows.withColumn("score", rows.name_jaccard))
    catalog._trained(spark, "", "gbt")
    assert set(features.COSTLY) <= set(seen["names"]) and "S2-1" in seen["train"]


@pytest.fixture(scope="module")
def made(spark):
    """600 records with a true and a false candidate each; `x` tells them apart from 0.6 on, but for every twentieth."""
    r, rows = random.Random(1), []
    for k in range(600):
        for j, label in ((0, 1), (1, 0)):
            x = r.uniform(0.6, 1) if (label == 1) != (k % 20 == 0) else r.uniform(0, 0.55)
            rows.append((f"S1-{k}", f"S2-{2 * k + j}", x, r.random(), x, 0, 0.0, 1, x, label))
    pairs = spark.createDataFrame(rows, "source1_entity_id string, candidate_entity_id string, x double, noise double, name_jaccard double, exact_address_match int, addr_jaccard double, num_channels int, name_fuzz_ratio double, label int")
    ids = pairs.select("source1_entity_id").distinct()
    return pairs, training.held_out(ids), pairs.where("label = 1").select("source1_entity_id", "candidate_entity_id")


def test_held_out_rows_end_the_rounds(spark, made):
    pairs, parts, truth = made
    rows = scoring.training_set(pairs.where("label >= 0")).join(parts, "source1_entity_id")
    how = dict(depth=2, least=5, rate=0.5)
    model = scoring.fit(rows, ["x", "noise"], held="validation", rounds=40, **how)
    assert 1 <= len(model.stages[-1].trees) < 40
    assert len(scoring.fit(rows.drop("validation"), ["x", "noise"], rounds=4, **how).stages[-1].trees) == 4
    none = rows.withColumn("validation", rows.label < 0)
    assert len(scoring.fit(none, ["x", "noise"], held="validation", rounds=4, **how).stages[-1].trees) == 4
    assert scoring.importance(model, ["x", "noise"])[0][0] == "x"


def test_linker_learns_tunes_decides_and_is_saved(spark, made, tmp_path):
    pairs, parts, truth = made
    assert parts.where("validation").count() == 120
    linker = training.tuned(training.learned(pairs, parts, ["x", "noise"], "lr"), pairs, parts, truth)
    got = training.measured(linker, pairs, parts, truth).first()
    assert got.records == 120 and got.macro_f05 > 0.9 and got.threshold == linker.threshold
    best = decision.sweep(parts.where("validation"), truth.join(parts.where("validation"), "source1_entity_id", "left_semi"), linker.scored(pairs.join(parts.where("validation"), "source1_entity_id", "left_semi")))
    assert got.macro_f05 >= max(r.macro_f05 for r in best.collect())
    linker.save(f"file://{tmp_path}/a")
    linker.save(f"file://{tmp_path}/a")
    again = training.Linker.load(spark, f"file://{tmp_path}/a")
    assert (again.features, again.threshold) == (linker.features, linker.threshold)
    assert sorted(again.decided(parts, pairs).collect()) == sorted(linker.decided(parts, pairs).collect())


def test_without_held_out_records_the_threshold_stays(spark, made):
    pairs, parts, truth = made
    linker = training.Linker(None, [], 0.37)
    assert training.tuned(linker, pairs, parts.withColumn("validation", parts.source1_entity_id == ""), truth).threshold == 0.37
