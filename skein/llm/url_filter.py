"""URL filter: block and allow rules, and gradient-boosted trees on lexical features for the rest.

Native: DataFrame functions and the JVM's tree learner only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table, written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: (verdict, host, path) of the query's contract.
RULES = (
    ("block", "com", "en/"),
    ("allow", "example.com", "en/7"),
    ("allow", "net", "de/"),
    ("block", "example.net", "de/8"),
    ("block", "org", "es/"),
)
FEATURES = (
    "f_len", "f_host_len", "f_path_len", "f_depth", "f_labels", "f_params", "f_query_len", "f_digits",
    "f_host_digits", "f_hyphens", "f_escapes", "f_upper", "f_entropy", "f_host_entropy", "f_tls",
    "f_suffix1", "f_suffix2", "f_folder",
)


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lowered; empty without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """From the host's end up to ? # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as host/path) and its verdict, null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        text, verdict = F.when(fits, f"{h}/{p}").otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def _entropy(c: Column) -> Column:
    n = F.greatest(F.length(c), F.lit(1)).cast("double")
    of = F.transform(F.array_distinct(F.split(c, "")), lambda x: (F.length(c) - F.length(F.replace(c, x, F.lit("")))) / n)
    return F.aggregate(of, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def _share(c: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(c, f"[^{pattern}]", "")) / F.greatest(F.length(c), F.lit(1))


def lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """df with the lexical feature columns of `url` that don't need statistics, and its suffix keys."""
    u, h, p = F.coalesce(F.col(url), F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    return df.withColumns({
        "f_len": F.length(u).cast("double"),
        "f_host_len": F.length(h).cast("double"),
        "f_path_len": F.length(p).cast("double"),
        "f_depth": F.size(F.filter(F.split(p, "/"), lambda x: x != "")).cast("double"),
        "f_labels": F.size(F.split(h, r"\.")).cast("double"),
        "f_params": F.size(F.filter(F.split(query, "&"), lambda x: x != "")).cast("double"),
        "f_query_len": F.length(query).cast("double"),
        "f_digits": _share(u, "0-9"),
        "f_host_digits": _share(h, "0-9"),
        "f_hyphens": F.length(F.regexp_replace(u, "[^-]", "")).cast("double"),
        "f_escapes": F.length(F.regexp_replace(u, "[^%]", "")).cast("double"),
        "f_upper": _share(u, "A-Z"),
        "f_entropy": _entropy(u),
        "f_host_entropy": _entropy(h),
        "f_tls": u.startswith("https").cast("double"),
        "k1": F.substring_index(h, ".", -1),
        "k2": F.concat_ws("|", F.substring_index(h, ".", -1), F.substring_index(F.ltrim(p, F.lit("/")), "/", 1)),
        "k3": F.substring_index(F.ltrim(p, F.lit("/")), "/", 1),
    })


@dataclass
class UrlModel:
    """Trained trees and the suffix statistics: share of blocked URLs by a key's smoothed counts."""

    trees: PipelineModel | None
    stats: dict[str, DataFrame] = field(default_factory=dict)
    prior: float = 0.0
    broadcast_rows: int = 50_000

    def features(self, df: DataFrame) -> DataFrame:
        """Joins the statistics; a table of them is broadcast only if it is counted to be small."""
        for key, name in (("k1", "f_suffix1"), ("k2", "f_suffix2"), ("k3", "f_folder")):
            s = self.stats[key].withColumnRenamed("rate", name)
            small = s.limit(self.broadcast_rows + 1).count() <= self.broadcast_rows
            df = df.join(F.broadcast(s) if small else s, key, "left").fillna(self.prior, [name])
        return df

    def block(self, df: DataFrame) -> DataFrame:
        """df with the column p_block."""
        if self.trees is None:
            return df.withColumn("p_block", F.lit(self.prior))
        out = self.trees.transform(self.features(df))
        return out.withColumn("p_block", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def train(labelled: DataFrame, label: str, max_rows: int = 6000, trees: int = 12, depth: int = 4, smooth: float = 20.0) -> UrlModel:
    """Fit on rows of lexical() with a 0/1 column `label`.

    The suffix statistics count every labelled row; the trees learn from at most `max_rows` different URLs,
    those with the least hash, both labels weighing the same. Without rows of both labels the model is their constant.
    """
    n, ones = labelled.agg(F.count("*"), F.sum(label)).first()
    prior = float(ones or 0) / n if n else 0.0
    if not n or ones in (0, n):
        return UrlModel(None, prior=prior)
    model = UrlModel(None, prior=prior)
    for key in ("k1", "k2", "k3"):
        rate = (F.sum(label) + F.lit(smooth * prior)) / (F.count("*") + F.lit(smooth))
        model.stats[key] = written(labelled.groupBy(key).agg(rate.alias("rate")))  # counted, joined and joined again
    picked = written(labelled.dropDuplicates(["url"]).orderBy(F.xxhash64("url"), "url").limit(max_rows))
    sample = model.features(picked).withColumns({
        "label": F.col(label).cast("double"),
        "weight": F.when(F.col(label) == 1, 0.5 / prior).otherwise(0.5 / (1 - prior)),
    })
    gather = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    fit = GBTClassifier(labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, maxBins=32, seed=7)
    ready = gather.transform(sample).select("features", "label", "weight").coalesce(1).persist()
    model.trees = PipelineModel([gather, fit.fit(ready)])
    ready.unpersist()
    return model


def judge(pages: DataFrame, rules=RULES, at: float = 0.5, **train_args) -> DataFrame:
    """(page_id, host, path, rule, verdict, p_block) of each row of pages(page_id, url).

    The rules label the URLs that they fit; the trees learn from these and judge the others: block
    where the probability is over `at`. Null or malformed URLs have an empty host and path and are
    judged like any other; a table without labels is allowed whole. Repeated rows stay. Other columns
    of `pages` are ignored.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    base = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "said": verdict})
    seen = lexical(base).withColumn("label", (F.col("said") == "block").cast("int"))
    model = train(seen.where("said is not null"), "label", **train_args)
    out = model.block(seen)
    return out.select(
        "page_id", "host", "path", "rule",
        F.coalesce("said", F.when(F.col("p_block") > at, "block").otherwise("allow")).alias("verdict"),
        F.round("p_block", 6).alias("p_block"),
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict, by judge() with the contract's rules."""
    return judge(table(spark, sf_dir, "pages"))
