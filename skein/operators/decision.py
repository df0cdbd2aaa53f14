"""Zero, one or many matches for each record, and how good they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

S1, C = "source1_entity_id", "candidate_entity_id"
GRID = [round(0.05 * i, 2) for i in range(1, 19)]


def listed(ids: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """Every id of ids(source1_entity_id) with its candidates of pairs, sorted and comma-joined; '' if none."""
    got = pairs.groupBy(S1).agg(F.array_join(F.array_sort(F.collect_set(C)), ",").alias(name))
    return ids.select(S1).distinct().join(got, S1, "left").na.fill("", [name])


def accepted(scored: DataFrame, at: float = 0.5) -> DataFrame:
    """The pairs with a score of `at` or more. Columns `ceiling` and `reach` are taken as bounds of the score that are known earlier."""
    for bound in {"ceiling", "reach"} & set(scored.columns):
        scored = scored.where(F.col(bound) >= at)
    return scored.where(F.col("score") >= at)


def best_owner(scored: DataFrame) -> DataFrame:
    """Each candidate stays with the record that scores it best, on ties the least id; scored holds a pair once."""
    row = F.struct(*[F.col(c) for c in scored.columns])
    return scored.groupBy(F.col(C).alias("_c")).agg(F.min_by(row, F.struct(-F.col("score"), F.col(S1))).alias("r")).select("r.*")


def clear_winners(scored: DataFrame, margin: float = 0.1) -> DataFrame:
    """Each record's best candidate, if it leads the next by `margin` at least."""
    by = W.partitionBy(S1).orderBy(F.desc("score"), C)
    own = scored.withColumns({"at": F.row_number().over(by), "next": F.lead("score").over(by)})
    return own.where((F.col("at") == 1) & (F.col("score") - F.coalesce("next", F.lit(0.0)) >= margin)).drop("at", "next")


def outcome(ids: DataFrame, truth: DataFrame, found: DataFrame) -> DataFrame:
    """For each id: pairs true, found and both (n_true, n_found, n_both)."""
    t = truth.select(S1, C).distinct().withColumn("t", F.lit(1))
    f = found.select(S1, C).distinct().withColumn("f", F.lit(1))
    n = t.join(f, [S1, C], "full").groupBy(S1).agg(F.count("t").alias("n_true"), F.count("f").alias("n_found"), F.count(F.col("t") + F.col("f")).alias("n_both"))
    return ids.select(S1).distinct().join(n, S1, "left").na.fill(0)


def measures(counts: DataFrame, lone: float | None = None) -> DataFrame:
    """counts with p, r, f. Nothing true and nothing found: 1; one of them empty: 0, or `lone` for the measure that has no share."""
    t, f, b = F.col("n_true"), F.col("n_found"), F.col("n_both")
    alone = F.lit(0.0 if lone is None else lone)
    p = F.when((t == 0) & (f == 0), 1.0).when(f == 0, alone).otherwise(F.coalesce(F.try_divide(b, f), F.lit(0.0)))
    r = F.when((t == 0) & (f == 0), 1.0).when(t == 0, alone).otherwise(F.coalesce(F.try_divide(b, t), F.lit(0.0)))
    f05 = F.when((t == 0) & (f == 0), 1.0).otherwise(F.coalesce(F.try_divide(1.25 * b, 0.25 * t + f), F.lit(0.0)))
    return counts.withColumns({"p": p, "r": r, "f": f05})


def macro(counts: DataFrame, *by: str, lone: float | None = None) -> DataFrame:
    m = measures(counts, lone)
    six = lambda c: F.round(c, 6)
    return m.groupBy(*by).agg(
        F.count("*").alias("records"), six(F.avg("p")).alias("macro_p"), six(F.avg("r")).alias("macro_r"), six(F.avg("f")).alias("macro_f05"),
        F.sum("n_both").alias("tp"), F.sum(F.col("n_found") - F.col("n_both")).alias("fp"), F.sum(F.col("n_true") - F.col("n_both")).alias("fn"),
    )


def sweep(ids: DataFrame, truth: DataFrame, scored: DataFrame, grid: list[float] = GRID) -> DataFrame:
    """Macro P, R and F0.5 at each threshold. Thresholds are exploded per record from its counts, not joined to the pairs."""
    t = truth.select(S1, C).distinct().withColumn("t", F.lit(1))
    both = scored.select(S1, C, "score").join(t, [S1, C], "full").groupBy(S1)
    at = lambda x, extra: F.count(F.when((F.col("score") >= x) & extra, 1))
    one = both.agg(F.count("t").alias("n_true"), F.array(*[F.struct(F.lit(x).alias("threshold"), at(x, F.lit(True)).alias("n_found"), at(x, F.col("t") == 1).alias("n_both")) for x in grid]).alias("g"))
    empty = F.array(*[F.struct(F.lit(x).alias("threshold"), F.lit(0).cast("long").alias("n_found"), F.lit(0).cast("long").alias("n_both")) for x in grid])
    full = ids.select(S1).distinct().join(one, S1, "left").select(S1, F.coalesce("n_true", F.lit(0)).alias("n_true"), F.explode(F.coalesce("g", empty)).alias("g"))
    return macro(full.select(S1, "n_true", "g.*"), "threshold")


def best_threshold(ids: DataFrame, truth: DataFrame, scored: DataFrame) -> float:
    """The least of the best thresholds: a coarse grid first, then steps of 0.005 around its best."""
    pick = lambda grid: sweep(ids, truth, scored, grid).orderBy(F.desc("macro_f05"), "threshold").first()["threshold"]
    mid = pick(sorted({*GRID, *[round(0.01 * i, 2) for i in range(1, 15)]}))
    return pick([round(mid + 0.005 * i, 3) for i in range(-10, 11) if mid + 0.005 * i > 0])


def decomposed(ids: DataFrame, truth: DataFrame, cands: DataFrame, found: DataFrame) -> DataFrame:
    """Records by cause: correct; retrieval (some true id is no candidate); model."""
    held = outcome(ids, truth, cands).select(S1, F.col("n_both").alias("n_held"))
    n = outcome(ids, truth, found).join(held, S1)
    right = (F.col("n_true") == F.col("n_both")) & (F.col("n_found") == F.col("n_both"))
    return n.groupBy(F.when(right, "correct").when(F.col("n_held") < F.col("n_true"), "retrieval").otherwise("model").alias("cause")).agg(F.count("*").alias("records"))


def top_k(truth: DataFrame, scored: DataFrame, ks: tuple[int, ...] = (1, 2, 3, 5, 10, 20, 50, 100)) -> DataFrame:
    """Shares of records with a true match of which any, and all, are among the k best candidates."""
    place = F.row_number().over(W.partitionBy(S1).orderBy(F.desc("score"), C))
    placed = scored.select(S1, C, place.alias("at"))
    own = truth.select(S1, C).distinct().join(placed, [S1, C], "left").groupBy(S1).agg(F.min("at").alias("first"), F.max(F.coalesce("at", F.lit(1 << 30))).alias("last"))
    rows = own.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    share = lambda c: F.round(F.avg(F.coalesce(c <= F.col("k"), F.lit(False)).cast("double")), 6)
    return rows.groupBy("k").agg(share(F.col("first")).alias("any_recall"), share(F.col("last")).alias("all_recall"))


def size_class(n: Column) -> Column:
    out = F.lit("1000+")
    for low, high in reversed([(0, 0), (1, 1), (2, 5), (6, 10), (11, 25), (26, 50), (51, 100), (101, 500), (501, 1000)]):
        out = F.when(n.between(low, high), str(low) if low == high else f"{low}-{high}").otherwise(out)
    return out


def cardinality(counts: DataFrame) -> DataFrame:
    """Records by number of matches, true and found; 6 stands for six or more."""
    cap = lambda c: F.least(F.col(c), F.lit(6)).alias(c)
    return counts.groupBy(cap("n_true"), cap("n_found")).agg(F.count("*").alias("records"))
