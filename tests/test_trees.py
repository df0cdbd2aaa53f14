"""Trees grown in one barrier job are Spark's: the same splits as by brute force, whatever the tasks."""

import numpy as np
import pytest

from skein.operators import scoring, trees
from skein.plans import training


def _made(n=4000):
    r = np.random.default_rng(1)
    x = [r.random(n), r.integers(0, 2, n) * 1.0, r.integers(0, 5, n) * 1.0, np.full(n, 7.0), np.where(r.random(n) < 0.1, np.nan, r.random(n))]
    return x, ((x[0] > 0.7) & (x[2] >= 2)).astype(int)


def test_bins_lie_in_bytes_and_come_apart_again():
    x, y = _made()
    lay = trees.Layout([trees.limits(v) for v in x])
    assert lay.used == [0, 1, 2, 4] and lay.size == [32, 2, 5, 32] and max(lay.states) <= 256
    codes = lay.codes(x)
    sums = lay.parted([np.bincount(codes[b], minlength=s).astype(float) for b, s in enumerate(lay.states)], 1)[0]
    for k, f in enumerate(lay.used):
        at = np.searchsorted(lay.cuts[f], x[f])
        assert sums[k, : lay.size[k]].tolist() == np.bincount(at, minlength=lay.size[k]).tolist()
        assert (lay.right(k, 0)[codes[lay.place[k][0]]] == (at > 0)).all()
    assert (lay.right(3, 30)[codes[lay.place[3][0]]] | ~np.isnan(x[4])).all()


def test_splits_are_the_best_and_counts_are_rows(monkeypatch):
    x, y = _made()
    lay = trees.Layout([trees.limits(v) for v in x])
    how = dict(total=lambda s: s, part=0, weight=3.0, stops=False, seed=5, rounds=3, depth=3, least=20, rate=0.1, gain=0.01)
    once = np.ones(len(y), np.int64)
    got = trees.grown(lay, lay.codes(x), y, np.zeros(len(y), bool), once, **how)
    assert [w for _, w in got] == [1.0, 0.1, 0.1]
    for nodes, _ in got:
        for i, (_, weight, gain, f, _, a, b) in enumerate(nodes):
            assert f < 0 or (gain > 0 and min(a, b) > i and abs(nodes[a][1] + nodes[b][1] - weight) < 1e-6 * weight)
    monkeypatch.setattr(np.random, "default_rng", lambda seed: _All())  # every row and feature
    (nodes, _), *_ = trees.grown(lay, lay.codes(x), y, np.zeros(len(y), bool), once, **how)
    w, r, best = np.where(y == 1, 3.0, 1.0), np.where(y == 1, 1.0, -1.0), (0, None)
    for f in lay.used:
        for c in lay.cuts[f]:
            left = x[f] <= c
            gain = sum((w * r)[s].sum() ** 2 / w[s].sum() for s in (left, ~left) if s.sum() >= 20) - (w * r).sum() ** 2 / w.sum()
            best = max(best, (gain, (f, c)))
    assert nodes[0][3:5] == best[1] and nodes[0][2] == pytest.approx(best[0] / w.sum())


class _All:
    def random(self, n):
        return np.zeros(n)

    def binomial(self, n, p):
        return n


def test_many_rounds_and_tasks_are_one_job_over_rows_told_once(spark, monkeypatch, tmp_path):
    x, y = _made()
    rows = spark.createDataFrame([(*map(float, v), int(t), i % 5 == 0) for i, (*v, t) in enumerate(zip(*x, y))], "a double, b double, c double, d double, e double, label int, held boolean")
    names, seen = list("abcde"), []
    lay = trees.Layout([trees.limits(v) for v in x])
    twice = trees.compacted(rows.union(rows), names, "held", lay)
    assert twice.agg({"n": "sum"}).first()[0] == 8000 and twice.count() == trees.compacted(rows, names, "held", lay).count() <= 4000
    monkeypatch.setattr(trees, "LEAST", 1000)
    monkeypatch.setattr(trees, "_task", lambda lay, how, token, f=trees._task: seen.append(how["rounds"]) or f(lay, how, token))
    jobs = lambda group: len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    for rounds in (2, 20):
        spark.sparkContext.setJobGroup(f"rounds {rounds}", "")
        model = scoring.fit(rows, names, held="held", rounds=rounds, depth=3, least=20, rate=0.3)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert seen == [2, 20] and jobs("rounds 2") == jobs("rounds 20") < 20
    assert {n for n, _ in scoring.importance(model, names)[:2]} == {"a", "c"}
    right = scoring.scored(model, rows).where("(score > 0.5) = (label = 1)").count()
    assert right >= 3900
    training.Linker(model, names, 0.4).save(f"file://{tmp_path}/m")
    again = training.Linker.load(spark, f"file://{tmp_path}/m")
    assert again.scored(rows).exceptAll(scoring.scored(model, rows)).count() == 0
