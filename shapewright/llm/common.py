"""What several operators share: reading tables and cutting lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.workers import reach_workers

__all__ = ["BLANKS", "forget", "one_row_each", "reach_workers", "row_key", "settle", "settled_paths", "shared_folder", "table"]

#: White space between words, fixed by the result contracts: space and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"

_SETTLED: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus; the path may be one that only Spark can open."""
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Where that
    is unset and everything runs on this machine, as in tests, a folder of our
    own; on a cluster that is an error, as its machines share no such folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "shapewright-shared")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Lineage ends there, so a lost executor costs no earlier work, and the
    planner knows the size of what it reads. ``forget`` removes what was written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SETTLED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled_paths() -> list[str]:
    """What ``settle`` has written and ``forget`` has not removed."""
    return list(_SETTLED)


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Removes settled tables that nothing will read any more."""
    context = spark.sparkContext
    for path in paths:
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
        _SETTLED.remove(path)


def row_key(docs: DataFrame) -> Column:
    """A hash of all of a row; nulls count by their place."""
    return F.xxhash64(*[docs[c] for c in docs.columns], *[docs[c].isNull() for c in docs.columns])


def one_row_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with one row of each component of ``found`` (row_key, doc_id,
    component): that of the smallest id, null ids last, then of the smallest
    ``row_key``; of rows alike in every column one stays."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.lit(0)).alias("first_id"), F.col("row_key").alias("first_key"))).alias("first")
    firsts = found.groupBy("component").agg(first).select("first.first_key", "first.first_id")
    keyed = docs.select("*", row_key(docs).alias("first_key"), F.coalesce("doc_id", F.lit(0)).alias("first_id"))
    kept = keyed.join(firsts.hint("merge"), ["first_key", "first_id"], "left_semi")  # never a broadcast: the keys grow with the documents
    alike = Window.partitionBy("first_key", "first_id").orderBy("first_key")
    return kept.withColumn("nth_alike", F.row_number().over(alike)).filter("nth_alike = 1").select(*docs.columns)
