"""Boosted trees as Spark's GBTClassifier grows them, in one barrier job: tasks keep their rows and exchange sums.

Spark's own runs ten jobs for each tree, over rows that mostly repeat once features are cut into bins. Here rows of
equal bins and label are one row with a count, and the model that comes out is Spark's GBTClassificationModel.
"""

from __future__ import annotations

import hmac
import os
import pickle
import socket
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.sources.tables import scratch

#: Rows from which the bins' limits are told (Spark's trees: 10,000), bins of a feature, states of a byte, most tasks, rows a task has at least.
SAMPLE, BINS, STATES, TASKS, LEAST = 50_000, 32, 256, 32, 50_000
CHUNK = 1 << 16


def limits(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Where values of a feature are told apart: between all that are different, or `bins` parts of about as many rows."""
    v = np.sort(values[~np.isnan(values)])
    own = np.unique(v)
    if len(own) < 2:
        return np.empty(0)
    at = np.unique(np.searchsorted(own, v[np.arange(1, bins) * len(v) // bins])) if len(own) > bins else np.arange(1, len(own))
    at = at[at > 0]
    return (own[at - 1] + own[at]) / 2


class Layout:
    """How the bins of the features lie in bytes: several features share one, as digits of a number below STATES."""

    def __init__(self, cuts: list[np.ndarray]):
        self.cuts = cuts
        self.used = [f for f, c in enumerate(cuts) if len(c)]
        self.size = [len(cuts[f]) + 1 for f in self.used]
        self.shapes: list[list[int]] = []
        self.place: list[tuple[int, int]] = [(0, 0)] * len(self.used)
        for k in sorted(range(len(self.used)), key=lambda k: -self.size[k]):
            b = next((i for i, s in enumerate(self.shapes) if np.prod(s) * self.size[k] <= STATES), len(self.shapes))
            if b == len(self.shapes):
                self.shapes.append([])
            self.place[k] = (b, len(self.shapes[b]))
            self.shapes[b].append(self.size[k])
        self.states = [int(np.prod(s)) for s in self.shapes]

    def codes(self, columns: list[np.ndarray]) -> np.ndarray:
        """(bytes, rows); missing values lie in the last bin, as they go right in Spark's trees."""
        out = np.zeros((len(self.shapes), len(columns[0]) if columns else 0), np.uint8)
        for b, shape in enumerate(self.shapes):
            code = np.zeros(out.shape[1], np.int64)
            for j, size in enumerate(shape):
                k = self.place.index((b, j))
                code = code * size + np.searchsorted(self.cuts[self.used[k]], columns[self.used[k]])
            out[b] = code
        return out

    def parted(self, sums: list[np.ndarray], nodes: int) -> np.ndarray:
        """(nodes, features, BINS) of the sums of each byte's states."""
        out = np.zeros((nodes, len(self.used), max(self.size, default=1)))
        for k, (b, j) in enumerate(self.place):
            rest = tuple(i + 1 for i in range(len(self.shapes[b])) if i != j)
            out[:, k, : self.size[k]] = sums[b].reshape(nodes, *self.shapes[b]).sum(rest)
        return out

    def right(self, k: int, at: int) -> np.ndarray:
        """Of each state of feature k's byte, whether its bin is over `at`."""
        b, j = self.place[k]
        return (np.indices(self.shapes[b])[j] > at).ravel()


def _summed(rows: np.ndarray, slot: np.ndarray, nodes: int, lay: Layout, codes: np.ndarray, of: list[np.ndarray]) -> list[list[np.ndarray]]:
    """For each of `of` and each byte: sums over rows by slot and state."""
    out = [[np.zeros(nodes * s) for s in lay.states] for _ in of]
    for i in range(0, len(rows), CHUNK):
        r = rows[i : i + CHUNK]
        here, values = slot[r].astype(np.int64), [x[r] for x in of]
        for b, s in enumerate(lay.states):
            at = here * s + codes[b][r]
            for o, v in zip(out, values):
                o[b] += np.bincount(at, v, nodes * s)
    return out


def grown(lay: Layout, codes: np.ndarray, label: np.ndarray, held: np.ndarray, count: np.ndarray, total: Callable[[np.ndarray], np.ndarray], part: int, weight: float, stops: bool, seed: int, rounds: int, depth: int, least: int, rate: float, gain: float) -> list[tuple[list, float]]:
    """(nodes, weight) of each tree. A node: (prediction, weight of rows, gain, feature, limit, left, right), of a leaf feature -1.

    total: sums arrays over all tasks; each then comes to the same decisions. Pseudo-residuals, leaves by their mean, the first
    tree at weight 1, and the end of the rounds by the held-out rows are those of Spark's GradientBoostedTrees.
    """
    y, w = np.where(label == 1, 1.0, -1.0), np.where(label == 1, weight, 1.0)
    f, trees = np.zeros(len(y)), []
    grow, rest = np.flatnonzero(~held), np.flatnonzero(held)
    once, more = count == 1, np.flatnonzero((count > 1) & ~held)
    own, same = np.random.default_rng([seed, part]), np.random.default_rng(seed)
    some = max(1, int(np.ceil(0.8 * len(lay.cuts))))
    best, keep = np.inf, 0
    for m in range(rounds):
        r = y if m == 0 else 4 * y / (1 + np.exp(np.minimum(2 * y * f, 700.0)))
        drawn = np.where(once & ~held, own.random(len(y)) < 0.8, 0).astype(np.float64)
        drawn[more] = own.binomial(count[more], 0.8)
        g, true = drawn * w * r, drawn * (y > 0)
        taken = np.flatnonzero(drawn > 0)
        # node: the node of each row; those of a level are numbered in order.
        node, nodes, level, sums = np.zeros(len(y), np.int32), [None], [0], None
        first = np.array([drawn.sum(), true.sum(), g.sum()])
        for d in range(depth + 1):
            if d == depth or not lay.used:
                told = total(first)[None] if sums is None else sums[:, :, 0].sum(-1).T
                for i, (n, p, s) in zip(level, told):
                    nodes[i] = (s / max(n + (weight - 1) * p, 1e-300), n + (weight - 1) * p, 0.0, -1, 0.0, -1, -1)
                break
            if sums is None:
                slot, small = np.zeros(1, np.int32), [0]
                rows = taken
            else:
                # Of two children the one with fewer rows is summed, the other is what is left of their parent.
                slot = np.full(len(nodes), -1, np.int32)
                slot[small] = np.arange(len(small))
                rows = taken[slot[node[taken]] >= 0]
            of = slot[node]
            n, s = _summed(rows, of, len(small), lay, codes, [drawn, g])
            yes = rows[true[rows] > 0]
            (p,) = _summed(yes, of, len(small), lay, codes, [true])
            mine = total(np.stack([lay.parted(x, len(small)) for x in (n, p, s)]))
            if sums is None:
                sums = mine
            else:
                whole = np.empty((3, len(level), *mine.shape[2:]))
                for k, i in enumerate(small):
                    at = level.index(i)
                    whole[:, at], whole[:, at ^ 1] = mine[:, k], parents[:, at // 2] - mine[:, k]
                sums = whole
            left = np.cumsum(sums, -1)
            both = left[:, :, :1, -1:]
            lw, rw = left[0] + (weight - 1) * left[1], both[0] + (weight - 1) * both[1] - left[0] - (weight - 1) * left[1]
            all_w = both[0] + (weight - 1) * both[1]
            base = both[2] ** 2 / np.maximum(all_w, 1e-300)
            better = left[2] ** 2 / np.maximum(lw, 1e-300) + (both[2] - left[2]) ** 2 / np.maximum(rw, 1e-300) - base
            allowed = (left[0] >= least - 0.5) & (both[0] - left[0] >= least - 0.5) & (better > 1e-9 * base + 1e-12 * all_w)
            allowed &= np.arange(left.shape[-1]) < np.array(lay.size)[:, None] - 1
            order = np.argsort(same.random((len(level), len(lay.cuts))), 1)[:, :some]
            chosen = np.zeros((len(level), len(lay.cuts)), bool)
            np.put_along_axis(chosen, order, True, 1)
            allowed &= chosen[:, lay.used][:, :, None]
            better = np.where(allowed, better, -1.0).reshape(len(level), -1)
            best_at = better.argmax(1)
            splits, new, small, kept = {}, [], [], []
            for at, i in enumerate(level):
                value, rows_w = float(both[2, at, 0, 0] / max(all_w[at, 0, 0], 1e-300)), float(all_w[at, 0, 0])
                if better[at, best_at[at]] <= 0:
                    nodes[i] = (value, rows_w, 0.0, -1, 0.0, -1, -1)
                    continue
                k, cut = divmod(int(best_at[at]), left.shape[-1])
                a, b = len(nodes), len(nodes) + 1
                nodes += [None, None]
                nodes[i] = (value, rows_w, float(better[at, best_at[at]]) / rows_w, lay.used[k], float(lay.cuts[lay.used[k]][cut]), a, b)
                splits[i] = (k, cut, a, b)
                small.append(a if left[0, at, k, cut] * 2 <= both[0, at, 0, 0] else b)
                kept.append((at, k, cut))
                new += [a, b]
            if not new:
                break
            byte = np.full(len(nodes), -1, np.int32)
            goes, to = np.zeros((len(nodes), STATES), bool), np.zeros(len(nodes), np.int32)
            for i, (k, cut, a, _) in splits.items():
                byte[i], to[i] = lay.place[k][0], a
                right = lay.right(k, cut)
                goes[i, : len(right)] = right
            for c in range(0, len(node), CHUNK):
                here = node[c : c + CHUNK]
                b = byte[here]
                code = codes[b, np.arange(c, c + len(here))]
                node[c : c + CHUNK] = np.where(b >= 0, to[here] + goes[here, code], here)
            parents = sums[:, [at for at, _, _ in kept]]
            if d + 1 == depth:  # leaves: their sums are those of either side of the split
                ends = np.empty((3, len(new)))
                for j, (at, k, cut) in enumerate(kept):
                    ends[:, 2 * j] = left[:, at, k, cut]
                    ends[:, 2 * j + 1] = both[:, at, 0, 0] - left[:, at, k, cut]
                sums = np.repeat(ends[:, :, None, None], 1, 2)
            level = new
        step = 1.0 if m == 0 else rate
        f += step * np.array([x[0] for x in nodes])[node]
        trees.append((nodes, step))
        if stops:
            loss = np.logaddexp(0.0, -2 * y[rest] * f[rest]) * 2
            lost, of_w = total(np.array([(loss * w[rest] * count[rest]).sum(), (w[rest] * count[rest]).sum()]))
            now = lost / max(of_w, 1e-300)
            if m and best - now < gain * max(now, 0.01):
                break
            if now < best:
                best, keep = now, m + 1
    return trees[:keep] if stops else trees


class Sums:
    """Sums of arrays over the tasks of a barrier stage: the first task adds up what the others send to it.

    Over sockets of their own, as allGather() of Spark answers once a second. token: what a task has to send first.
    """

    def __init__(self, context: BarrierTaskContext, token: bytes):
        hosts = [x.address.rsplit(":", 1)[0].strip("[]") for x in context.getTaskInfos()]
        self.first, self.ends, n = context.partitionId() == 0, [], len(hosts)
        if n == 1:
            return
        if self.first:
            with socket.create_server((hosts[0], 0), backlog=n) as server:
                context.allGather(str(server.getsockname()[1]))
                server.settimeout(120)
                while len(self.ends) < n - 1:
                    end = self._ready(server.accept()[0])
                    if hmac.compare_digest(self._read(end, len(token)), token):
                        self.ends.append(end)
                    else:
                        end.close()
        else:
            port = int(context.allGather("")[0])
            self.ends.append(self._ready(socket.create_connection((hosts[0], port), 120)))
            self.ends[0].sendall(token)

    def __enter__(self) -> Sums:
        return self

    def __exit__(self, *_) -> None:
        for x in self.ends:
            x.close()

    @staticmethod
    def _ready(end: socket.socket) -> socket.socket:
        end.settimeout(600)
        end.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
        return end

    @staticmethod
    def _read(end: socket.socket, n: int) -> bytearray:
        out = bytearray(n)
        at, view = 0, memoryview(out)
        while at < n:
            got = end.recv_into(view[at:])
            if not got:
                raise ConnectionError("a task of the barrier stage has ended")
            at += got
        return out

    def total(self, x: np.ndarray) -> np.ndarray:
        x = np.array(x, np.float64, order="C")
        if self.first:
            for end in self.ends:
                x += np.frombuffer(self._read(end, x.nbytes)).reshape(x.shape)
            for end in self.ends:
                end.sendall(x.tobytes())
            return x
        self.ends[0].sendall(x.tobytes())
        return np.frombuffer(self._read(self.ends[0], x.nbytes)).reshape(x.shape)


def _packed(lay: Layout, names: list[str], held: str | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            codes = lay.codes([x.column(i).to_numpy(zero_copy_only=False) for i in range(len(names))])
            words = np.zeros((x.num_rows, max(1, -(-len(codes) // 8)) * 8), np.uint8)
            words[:, : len(codes)] = codes.T
            keys = words.view(np.int64)
            yield pa.RecordBatch.from_arrays([*[pa.array(keys[:, i].copy()) for i in range(keys.shape[1])], x.column(len(names)), x.column(len(names) + 1)], [*[f"k{i}" for i in range(keys.shape[1])], "label", "held"])

    return run


def _task(lay: Layout, how: dict, token: bytes) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        got = [x for x in batches if x.num_rows]
        column = lambda k: np.concatenate([np.asarray(x.column(k).to_numpy(zero_copy_only=False)) for x in got]) if got else np.empty(0, np.int64)
        keys = np.stack([column(f"k{i}") for i in range(max(1, -(-len(lay.shapes) // 8)))], 1)
        codes = np.ascontiguousarray(np.ascontiguousarray(keys, np.int64).view(np.uint8)[:, : len(lay.shapes)].T)
        label, held, count = column("label"), column("held").astype(bool), column("n")
        del got, keys

        with Sums(context, token) as sums:
            trees = grown(lay, codes, label, held, count, sums.total, context.partitionId(), **how)
        if context.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(trees)], pa.binary())], ["trees"])

    return run


def compacted(rows: DataFrame, names: list[str], held: str | None, lay: Layout) -> DataFrame:
    """(k0, ..., label, held, n): rows with the same bins, label and part are one, n of them."""
    own = rows.select(*[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(names)], F.col("label").cast("int").alias("label"), (F.lit(False) if held is None else F.col(held)).alias("held"))
    keys = [f"k{i}" for i in range(max(1, -(-len(lay.shapes) // 8)))]
    packed = own.mapInArrow(_packed(lay, names, held), ", ".join(f"{k} long" for k in keys) + ", label int, held boolean")
    return packed.groupBy(*keys, "label", "held").agg(F.count("*").alias("n"))


def fitted(rows: DataFrame, names: list[str], n: int, weight: float, held: str | None = None, stops: bool = False, **how) -> GBTClassificationModel:
    """Trees from n rows with the features `names` and label; true ones weigh `weight`. how: what grown() takes besides."""
    spark = rows.sparkSession
    some = rows.select(*[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(names)]).sample(min(1.0, SAMPLE / max(1, n)), how["seed"]) if n > SAMPLE else rows.select(*[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(names)])
    drawn = some.toPandas()
    lay = Layout([limits(drawn[f"f{i}"].to_numpy(np.float64)) for i in range(len(names))])
    own = scratch(compacted(rows, names, held, lay))
    jsc = spark.sparkContext._jsc.sc()
    slots = jsc.maxNumConcurrentTasks(jsc.resourceProfileManager().defaultResourceProfile())
    tasks = max(1, min(slots, TASKS, own.count() // LEAST + 1))
    told = own.repartition(tasks).mapInArrow(_task(lay, how | {"weight": weight, "stops": stops}, os.urandom(32)), "trees binary", barrier=True)
    return model(spark, pickle.loads(bytes(told.collect()[0]["trees"])), len(names))


def model(spark, trees: list[tuple[list, float]], features: int) -> GBTClassificationModel:
    """Spark's model of grown() trees."""
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    tree, impurity = jvm.org.apache.spark.ml.tree, jvm.org.apache.spark.mllib.tree.impurity
    java = jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    out, weights = new(java, len(trees)), new(jvm.double, len(trees))

    def stats(x: tuple):
        own = new(jvm.double, 3)
        own[0], own[1], own[2] = float(x[1]), float(x[0] * x[1]), float(x[0] ** 2 * x[1])
        return impurity.VarianceCalculator(own, int(x[1]))

    leaf = stats((0.0, 1.0))
    for k, (nodes, weight) in enumerate(trees):
        made = {}
        for i in range(len(nodes) - 1, -1, -1):  # children have higher numbers
            x = nodes[i]
            if x[3] < 0:
                made[i] = tree.LeafNode(float(x[0]), 0.0, leaf)
            else:
                made[i] = tree.InternalNode(float(x[0]), float(x[2]), float(x[2]), made.pop(x[5]), made.pop(x[6]), tree.ContinuousSplit(int(x[3]), float(x[4])), stats(x))
        out[k], weights[k] = java(f"dtr_{uuid.uuid4().hex[:12]}", made[0], features), float(weight)
    return GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel(f"GBTClassifier_{uuid.uuid4().hex[:12]}", out, weights, features, 2))
