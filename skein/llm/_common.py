"""What the operators of this subpackage share: tables, written intermediates, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GREEK = "0123456789abcdef"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; a temporary one where none is set and all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: computed once, without lineage, and safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skein-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files of a table made by written(), once nothing reads it any more."""
    spark = df.sparkSession
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Each name, with underscores before it as long as df has such a column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
        taken.add(name.lower())
    return out


def hex16(c: Column) -> Column:
    """A long as 16 lower-case hexadecimal digits, its bits taken as unsigned."""
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def fold(c: Column) -> int:
    """crc32 of the number as text."""
    return F.crc32(c.cast("string"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected `edges` (a long, b long): rows (node, root), root the least node.

    Alternates large-star and small-star steps, each an aggregate and a join; a step's edges are
    written to the shared folder, so lineage stays short, and deleted once the next step's are there.
    Nodes without an edge don't appear; null ends are left out.
    Raises RuntimeError if `rounds` don't suffice (they grow with the logarithm of the longest chain).
    """

    def digest(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    now = written(pairs.distinct())
    seen = digest(now)
    for _ in range(rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a > b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        then = written(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        got = digest(then)
        for old in (now, large):
            remove(old)
        now = then
        if got == seen:
            break
        seen = got
    else:
        raise RuntimeError("components: more rounds are needed")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def by_key(rows: DataFrame, side: DataFrame, key: str, n: str, most: int = 1000) -> DataFrame:
    """rows joined with side on `key`; side's keys are unique, and its column `n` counts the rows of each.

    Keys with a share of the rows over 1 / `most` are `most` at most: they are joined by broadcast, so
    that no task gets all rows of a hot key; the rest by the usual join. Rows with a null key are left out.
    """
    least = (side.agg(F.sum(n)).first()[0] or 0) // most + 1
    hot = F.broadcast(side.where(F.col(n) >= least))
    rest = rows.join(hot.select(key), key, "left_anti").join(side.where(F.col(n) < least), key)
    return rows.join(hot, key).unionByName(rest)


def first_mask(x: Column, masks: Iterable[int]) -> Column:
    """The index of the first mask that the bits of x don't touch, else null."""
    out = F.lit(None).cast("int")
    for i, m in reversed(list(enumerate(masks))):
        out = F.when(x.bitwiseAND(F.lit(m)) == 0, F.lit(i)).otherwise(out)
    return out


def signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m
