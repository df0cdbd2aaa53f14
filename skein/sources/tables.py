"""Readers and writers: tab-separated records, Parquet, output lists, metrics."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = ("entity_id", "business_name", "business_address", "country")
TRUTH = ("source1_entity_id", "matched_entity_ids")


def read_tsv(spark: SparkSession, path: str, columns: tuple[str, ...] = RECORD) -> DataFrame:
    """All columns as strings, nothing read as missing ('NA' stays), empty fields as ''."""
    schema = ", ".join(f"{c} string" for c in columns)
    return spark.read.csv(path, sep="\t", header=True, schema=schema, quote='"', escape='"').na.fill("")


def write_tsv(df: DataFrame, path: str) -> None:
    """One header for each part, never quoted, empty fields bare, blanks at the ends of fields kept."""
    df.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_single_tsv(df: DataFrame, path: str, key: str) -> None:
    """One file with one header, by key: for lists that are handed on as a file. It is written by a single task."""
    df.repartitionByRange(1, key).sortWithinPartitions(key).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """`columns`: those that exist are taken."""
    df = spark.read.parquet(path)
    return df.select(*[c for c in columns if c in df.columns]) if columns else df


def write_once(df: DataFrame, path: str) -> DataFrame:
    """df as Parquet at path; a finished table there is read instead."""
    spark = df.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the driver and all executors see.

    Where none is set, a temporary folder serves, but only if all of Spark runs on this machine.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.conf.set("spark.checkpoint.dir", top)
    return top


def scratch(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: computed once, safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skein-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def metrics_json(row: DataFrame) -> str:
    """The single row of an aggregate, as JSON."""
    return json.dumps(row.first().asDict(recursive=True), default=str, sort_keys=True)


def report(title: str, row: DataFrame) -> str:
    """The single row of an aggregate, as a Markdown table."""
    found = row.first().asDict()
    return "\n".join([f"# {title}", "", "| measure | value |", "|---|---|", *[f"| {k} | {v} |" for k, v in found.items()]])


def head(df: DataFrame, n: int, key: str = "entity_id") -> DataFrame:
    """The first n rows by key: a sample table, where that is what is wanted."""
    return df.orderBy(key).limit(n)


def id_list(c) -> Column:
    """A comma-joined list of ids as an array, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
