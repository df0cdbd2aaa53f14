"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in hash order, are cut into blocks. With weight w of W in all, its block j is
released at floor(j W / w) and due at ceil((j + 1) W / w); each slot goes to the released block with
the earliest deadline. As the weights fill all slots, every deadline is met, so at any slot t a
source has had less than one block more or less than t w / W. The weights are taken as the exact
fractions that the floats are: nothing is rounded, and the bound holds however long a phase is. The
slots are made on the driver, a number for each block, and each document finds its own from its rank.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import table, unused

#: Documents of a block, blocks of a row of the plan, seed of the order within a source.
BLOCK, PERIOD, SEED = 32, 1000, 17
#: About so many documents are ranked together.
GROUP = 2000


def schedule(blocks: list[int], weights: list[float]) -> list[list[int]]:
    """The slots that earliest-deadline-first gives each source's blocks.

    A phase ends with the last block of some source; the others share the next by their weights.
    """
    exact = [Fraction(w) for w in weights]
    unit = math.lcm(*[x.denominator for x in exact])
    own = [int(x * unit) for x in exact]
    slots: list[list[int]] = [[] for _ in blocks]
    base = 0
    while live := [i for i, n in enumerate(blocks) if len(slots[i]) < n]:
        total = sum(own[i] for i in live)
        waits = [(0, i, 0) for i in live]  # (release, source, block of the phase)
        ready: list[tuple[int, int, int]] = []  # (deadline, source, block of the phase)
        t = 0
        while True:
            while waits and waits[0][0] <= t:
                _, i, j = heapq.heappop(waits)
                heapq.heappush(ready, (-(-(j + 1) * total // own[i]), i, j))
            _, i, j = heapq.heappop(ready)
            slots[i].append(base + t)
            t += 1
            if len(slots[i]) == blocks[i]:
                break
            heapq.heappush(waits, ((j + 1) * total // own[i], i, j + 1))
        base += t
    return slots


def spread(docs: DataFrame) -> Column:
    """The hash that orders a source's rows: of doc_id, and where there is none of the whole row."""
    rest = [c for c, t in docs.dtypes if not t.startswith("map")]
    return F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(SEED), *rest)).otherwise(F.xxhash64(F.lit(SEED), F.col("doc_id")))


def mix(docs: DataFrame, weight: Callable[[str, int], float] | dict[str, float] | None = None, source: str = "source", block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """docs with block (of its source), slot and position in the mixture; every row keeps its place once.

    weight: a source's weight by name, or from (name, rows); by default the square root of its rows.
    Sources that it doesn't name weigh 0 and come last, in proportion to their rows. Null sources count
    as ''. Within its source a row's rank is its place by a hash of doc_id, rows without one by a hash of
    the row; equal hashes by the other columns. Ranks are counted in groups by the first bits of the
    hash, about GROUP rows each, and the groups' counts are summed up: no source is sorted in one task.
    Positions rise with the slots; after a source's last, shorter block some are left out.
    Repeated rows get places of their own; an empty table stays empty. Columns of docs named block, slot
    or position are replaced, all others stay as they are. The sources with their counts, and a slot for each
    block (rows / `block` numbers), are made on the driver; they come back as a table of rows of `period`
    slots that the groups' counts are joined with, not the documents. `period` bears on no slot.
    """
    docs = docs.drop("block", "slot", "position")
    key = F.coalesce(F.col(source).cast("string"), F.lit(""))
    n = {r[0]: r[1] for r in docs.groupBy(key.alias("s")).count().collect()}
    names = sorted(n)
    if weight is None:
        weight = lambda s, k: math.sqrt(k)
    w = [float(weight(s, n[s]) if callable(weight) else weight.get(s, 0.0)) for s in names]
    blocks = [-(-n[s] // block) for s in names]
    rows, base = [], 0
    for part in ([i for i, x in enumerate(w) if x > 0], [i for i, x in enumerate(w) if x <= 0]):
        if part:
            ws = [w[i] if w[i] > 0 else float(n[names[i]]) for i in part]
            for i, slots in zip(part, schedule([blocks[i] for i in part], ws)):
                rows += [(names[i], k // period, [base + t for t in slots[k : k + period]]) for k in range(0, len(slots), period)]
            base += sum(blocks[i] for i in part)
    s, g, h, at, before, first, held = unused(docs, "s", "g", "h", "at", "before", "first", "held")
    plan = docs.sparkSession.createDataFrame(rows, f"`{s}` string, r long, part array<long>")
    bits = max(0, math.ceil(math.log2(max(1, sum(n.values())) / GROUP)))
    group = lambda x: F.shiftrightunsigned(x, 64 - bits) if bits else F.lit(0).cast("long")
    sums = F.sum("n").over(W.partitionBy(s).orderBy(g).rowsBetween(W.unboundedPreceding, -1))
    counts = docs.groupBy(key.alias(s), group(spread(docs)).alias(g)).agg(F.count("*").alias("n"))
    counts = counts.withColumn(before, F.coalesce(sums, F.lit(0).cast("long")))
    row = lambda x: F.floor(x / (block * period))
    spans = counts.withColumn("r", F.explode(F.sequence(row(F.col(before)), row(F.col(before) + F.col("n") - 1))))
    parts = F.array_sort(F.collect_list(F.struct("r", "part")))
    slots = spans.join(plan, [s, "r"]).groupBy(s, g).agg(F.first(before).alias(before), F.min("r").alias(first), parts.alias(held))
    slots = slots.withColumn(held, F.flatten(F.col(held)["part"]))
    keyed = docs.withColumns({s: key, h: spread(docs)}).withColumn(g, group(F.col(h)))
    ties = [c for c, t in docs.dtypes if not t.startswith("map") and c != "doc_id"]
    placed = keyed.withColumn(at, F.row_number().over(W.partitionBy(s, g).orderBy(h, "doc_id", *ties)))
    rank = F.col(before) + F.col(at) - 1
    placed = placed.join(slots, [s, g]).select(*[F.col(c) for c in docs.columns], rank.alias(at), F.col(first), F.col(held))
    own = F.floor(F.col(at) / block)
    slot = F.get(held, (own - F.col(first) * period).cast("int"))
    return placed.select(*docs.columns, own.alias("block"), slot.alias("slot"), (slot * block + F.pmod(F.col(at), F.lit(block))).alias("position"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's block, slot and position, by mix() with its default weights."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
