"""Ordering, limits, ranks and batches with total orders."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(rank) <= k)


def positions(rows: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """Numbers all rows from 1 in a total order, without one task that sees them all.

    Rows are dealt by ranges of the order; a row's number is its place in its range after the sizes of
    the ranges before, which are one row each. The ranges are written to the shared folder once, as they must not be drawn anew in between."""
    dealt = checkpointed(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    # One row for each range: as many as there are tasks.
    return dealt.join(F.broadcast(before.select("_range", "_before")), "_range").withColumn(name, (own + F.col("_before")).cast("bigint")).drop("_range", "_before")


def checkpointed(rows: DataFrame) -> DataFrame:
    """A reliable checkpoint in ``spark.checkpoint.dir``; only a local session may do without that setting."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the context's checkpoint folder, which a
    local session is given if it has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def evidence_ranking(rows: DataFrame, confidence: str, evidence: str, tie: list[Column]) -> DataFrame:
    """Score 0.6 confidence + 0.4 min(evidence / 20, 1), two decimals half to even; ranks without gaps, one row per subject."""
    score = F.bround(F.col(confidence) * 0.6 + F.least(F.col(evidence) / 20, F.lit(1.0)) * 0.4, 2)
    return positions(rows.withColumn("score", score), [F.desc("score"), F.desc(confidence), *tie], "rank").withColumn("rank", F.col("rank").cast("int"))


def filter_or_all(rows: DataFrame, wanted: Column) -> DataFrame:
    """The rows that fit, or all rows if none does."""
    any_fits = rows.agg(F.coalesce(F.bool_or(wanted), F.lit(False)).alias("_any"))  # one row
    return rows.crossJoin(F.broadcast(any_fits)).filter(wanted | ~F.col("_any")).drop("_any")


def with_remainder(rows: DataFrame, group: str, order: list[Column], k: int, label: str) -> DataFrame:
    """Per group the first k labels joined by commas, and ``+N more`` where there are others."""
    w = Window.partitionBy(group).orderBy(*order)
    n = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    top = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_r", label))).alias("_l"))
    return top.join(n, group).select(group, F.concat(F.array_join(F.transform("_l", lambda x: x[label].cast("string")), ", "), F.when(F.col("_n") > k, F.concat(F.lit(" +"), (F.col("_n") - k).cast("string"), F.lit(" more"))).otherwise("")).alias("summary"))


def batches(rows: DataFrame, group: list[str], order: list[Column], size: int) -> DataFrame:
    """Numbers consecutive batches of ``size`` rows within each group."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1) / size).cast("int"))
