"""Test items of fewer words than a shingle are found inside long documents."""

import random

import pytest

from skein.llm import decontaminate as D


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(n))


@pytest.mark.parametrize("item", ["Paris", "Capital? Paris", "Capital of France? Paris", "one Two three"])
@pytest.mark.parametrize("at", [0, 3, 30, 62, 63, 200, 400])
def test_short_item_in_a_long_text(item, at):
    others = [(i, prose(i, 30).split(), []) for i in range(20)]
    index = D.Index.build([*others, (99, *D.question_answer(item))])
    words = prose(500, 400).split()
    text = " ".join([*words[:at], item, *words[at:]])
    assert [index.items[i][0] for i, *_ in index.leaks(text)] == [99]
    apart = [x for w in D.tokens(item)[::-1] for x in (w, "between")]
    found = index.leaks(" ".join([*words[:at], *apart, *words[at:]]))
    assert len(found) == (len(D.tokens(item)) == 1)


def test_short_question_and_answer_columns(spark):
    benchmark = spark.createDataFrame([(1, "Capital of France?", "Paris"), (2, "Capital of Spain?", "Madrid")], "item_id long, question string, answer string")
    docs = spark.createDataFrame([(1, prose(1, 90) + " capital of france paris " + prose(2, 90)), (2, prose(3, 90) + " paris of france " + prose(4, 90)), (3, None)], "doc_id long, text string")
    assert [(r.doc_id, r.item_id, r.overlap, r.answer_overlap) for r in D.leaks(docs, benchmark).collect()] == [(1, 1, 1.0, 1.0)]
    assert sorted(r.doc_id for r in D.clean(docs, benchmark).collect()) == [2, 3]


def test_item_ids_of_any_type_and_edges(spark):
    items = spark.createDataFrame([("x1", "one two three four five six seven"), (None, None), ("", "???"), ("x2", "one two three four five six seven")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "so one two three four five six seven so", "z"), (None, None, "z"), (3, "", "z")], "doc_id long, text string, item_id string")
    assert {(x.doc_id, x.item_id) for x in D.leaks(docs, items).collect()} == {(1, "x1"), (1, "x2")}
    assert D.leaks(docs, items.limit(0)).count() == D.leaks(docs.limit(0), items).count() == 0
    assert {x.doc_id for x in D.clean(docs, items).collect()} == {None, 3}


def test_several_indexes_find_what_one_finds(spark, monkeypatch):
    r = random.Random(8)
    words = ["".join(r.choices("abcdefgh", k=6)) for _ in range(400)]
    items = [(i, " ".join(r.choices(words, k=30))) for i in range(60)]
    docs = [(i, " ".join(r.choices(words, k=80)) + " " + r.choice(items)[1] + " " + " ".join(r.choices(words, k=50))) for i in range(40)]
    items, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    found = lambda: {(x.doc_id, x.item_id) for x in D.leaks(docs, items).collect()}
    one, kept = found(), D.clean(docs, items).count()
    monkeypatch.setattr(D, "INDEX_CHARS", 5000)
    assert len(list(D.indexes(items))) > 2
    assert found() == one and len(one) >= 40 and D.clean(docs, items).count() == kept == 0
