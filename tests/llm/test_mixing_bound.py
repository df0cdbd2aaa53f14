"""The mixture stays within a block of its weights, over phases of many thousand slots."""

import math
from fractions import Fraction

import pytest

from skein.llm import mixing


def _off(slots, weights):
    """The greatest deviation, in blocks, of any source from its weight until the first source ends."""
    end = 1 + min(s[-1] for s in slots)
    total, worst = sum(map(Fraction, weights)), Fraction(0)
    for s, w in zip(slots, weights):
        share = Fraction(w) / total
        for k, t in enumerate(x for x in s if x < end):
            worst = max(worst, abs(k - t * share), abs(k + 1 - (t + 1) * share))
    return worst


@pytest.mark.parametrize("weights", [[1 / 3, 2 / 3], [math.sqrt(2), math.sqrt(3), math.sqrt(5)], [0.9999, 0.0001], [1.0] * 7 + [1e-4]])
def test_within_a_block_over_a_long_phase(weights):
    blocks = [30_000] * len(weights)
    slots = mixing.schedule(blocks, weights)
    assert sorted(t for s in slots for t in s) == list(range(sum(blocks)))
    assert _off(slots, weights) < 1


def test_thirds_in_a_table(spark):
    docs = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(15_000)], "doc_id long, source string")
    got = mixing.mix(docs, {"a": 2 / 3, "b": 1 / 3}, block=1).collect()
    slots = [sorted(r.slot for r in got if r.source == s) for s in ("a", "b")]
    assert len({r.position for r in got}) == 15_000
    assert _off(slots, [2 / 3, 1 / 3]) < 1
