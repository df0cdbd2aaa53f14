import pytest
from pyspark.sql import functions as F

from skein.functions import similarity, text
from skein.operators import blocking, contract, decision

NAMES = [("Acme Corp.", "acme"), ("Acme Corporation", "acme"), ("Smith & Wesson", "smith and wesson"), (" Café Mõcha ", "cafe mocha"), ("Google.com", "google com"), ("--Invalid Name", "invalid name"), (None, "")]
ADDRESSES = [("123 Main St.", "123 main street"), ("456 1st Ave", "456 1 avenue"), ("P.O. BOX 123", "pobox 123"), ("Apartment 4B, Building C", "apartment 4b building c"), (None, "")]


@pytest.mark.parametrize("cases,view", [(NAMES, text.name_v1), (ADDRESSES, text.address)])
def test_views(spark, cases, view):
    df = spark.createDataFrame(cases, "x string, want string")
    assert df.where(view(F.col("x")) != F.col("want")).count() == 0


def test_numbers(spark):
    df = spark.createDataFrame([("123 main street apt 4", "123 4"), ("no numbers here", ""), ("456 1 avenue", "456 1")], "x string, want string")
    assert df.where(text.numbers(F.col("x")) != F.col("want")).count() == 0


def test_kernels():
    assert similarity.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert similarity.ratio("", "a") == 0 and similarity.ratio("abcd", "abed") == 0.75
    assert similarity.partial_ratio("abc", "xxabcxx") == 1
    assert text.ascii_of("Straße é") == "Strasse e"


def test_channels_find_both_pairs(spark):
    rows = [("S1-1", 1, "acme", "123"), ("S1-2", 1, "globex", "456"), ("S2-1", 2, "acme", "123"), ("S2-2", 2, "other", "999"), ("S3-1", 3, "unknown", "000"), ("S3-2", 3, "globex", "456")]
    df = spark.createDataFrame(rows, "entity_id string, src int, name_norm string, address_numbers string").withColumn("country", F.lit("US"))
    got = {(r[0], r[1], r.num_channels) for r in blocking.retrieve(df, blocking.V1).collect()}
    assert got == {("S1-1", "S2-1", 3), ("S1-2", "S3-2", 3)}


@pytest.mark.parametrize("cap,want", [(2, 2), (1, 0)])
def test_cap_counts_the_other_sources(spark, cap, want):
    df = spark.createDataFrame([("S1-1", 1, "x", "a"), ("S2-1", 2, "x", "a"), ("S3-1", 3, "x", "a")], "entity_id string, src int, country_norm string, name_legal string")
    assert blocking.pairs(df, blocking.Channel("n", ("country_norm", "name_legal"), cap)).count() == want


def test_macro_measure(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "source1_entity_id string, candidate_entity_id string")
    ids = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "source1_entity_id string")
    truth, found = pairs([("S1-1", "S2-1"), ("S1-1", "S3-1"), ("S1-3", "S2-3")]), pairs([("S1-1", "S2-1"), ("S1-3", "S2-3"), ("S1-3", "S3-4")])
    assert decision.macro(decision.outcome(ids, truth, found)).first().macro_f05 == pytest.approx(0.796296)


def test_contract(spark):
    schema = "entity_id string, business_name string, business_address string, country string"
    got = contract.source(spark.createDataFrame([("S1-1", "a", "b", "US"), ("", "", None, "US"), ("  ", "a", "b", "US"), (None, "a", "b", "US"), ("S1-1", "c", "d", "US"), ("S2-9", "c", "d", "US")], schema), "S1-").first()
    assert (got.missing_entity_id, got.duplicate_ids, got.wrong_prefix, got.failed) == (3, 1, 1, True)
    with pytest.raises(ValueError):
        contract.source(spark.createDataFrame([("a",)], "entity_id string"), "S1-")


def test_truth_contract(spark):
    one = spark.createDataFrame([("S1-1",)], "entity_id string")
    others = spark.createDataFrame([("S2-1",)], "entity_id string")
    gt = spark.createDataFrame([("S1-1", "S2-2, S4-1"), ("S1-9", "S2-1, S2-1")], "source1_entity_id string, matched_entity_ids string")
    got = contract.truth(gt, one, others).first()
    assert (got.unknown_ids, got.invalid_references, got.duplicate_references_in_row) == (1, 2, 1)
