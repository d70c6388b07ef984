"""Ranks over all rows of a table, without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.pages import scratch

#: Rows that one task can be numbered in, by the ids that Spark gives out.
_ROW = 1 << 33


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with a number from 1 for each row in the given order; rows that are equal by it come in any order.

    Rows are dealt to ranges of the order and sorted there. A first pass counts each range, a second one adds the
    counts of the ranges before to the place within the range; only these counts meet in one task, a row a range.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, "ranges")
    keys = {f"_key{k}": c for k, c in enumerate(order)}
    dealt = df.withColumns(keys).repartitionByRange(*map(F.col, keys)).sortWithinPartitions(*keys)
    # ids hold the range and the row's place in it; written, so that both passes see the same
    dealt.drop(*keys).withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("_range", F.floor(F.col("_id") / _ROW))
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_base"))
    return rows.join(F.broadcast(base), "_range").withColumn(name, (F.col("_base") + F.col("_id") % _ROW + 1).cast("long")).drop("_range", "_base", "_id")
