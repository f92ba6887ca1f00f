"""What the operators share: the shared folder, staged tables, shipped code, ranks and running totals."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..deploy import ship  # noqa: F401

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only where it is unset (tests on one machine), one of our own."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="strandlog-"))
    return _own_folder[0]


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def staged(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, so a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(name: str = "text") -> Column:
    """The text, where a missing one counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def buckets(spark: SparkSession) -> int:
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ranked(df: DataFrame, key: str, ident: list[str], out: str, n_buckets: int) -> DataFrame:
    """df with `out`: 0, 1, 2, ... within each key, without a task that holds a whole key.

    Rows of a key are split over n_buckets by the hash of ident; a bucket's rows are numbered on from those of the buckets
    before it. Ident names a row (repeated idents are numbered in any order); df must give the same rows when read twice.
    """
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*ident), F.lit(n_buckets)).cast("int"))
    counts = df.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(*ident)) - 1
    numbered = df.withColumn("_within", within)
    return numbered.join(counts, [key, "_bucket"]).withColumn(out, (F.col("_within") + F.col("_before")).cast("long")).drop("_bucket", "_within", "_before")


def running_total(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """df with `out`: the sum of value over all rows before it in the order, without a task that holds the whole table.

    df is cut into ranges of the order and staged; one row for each range carries the totals on. Equal keys of the order fall
    into one range.
    """
    cut = staged(df.repartitionByRange(buckets(df.sparkSession), *order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = cut.groupBy("_range").agg(F.sum(value).alias("_sum"))
    # a row for each range, of which there are as many as partitions
    totals = totals.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = cut.withColumn("_inside", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return inside.join(F.broadcast(totals), "_range").withColumn(out, (F.col("_base") + F.col("_inside")).cast("long")).drop("_range", "_base", "_inside")
