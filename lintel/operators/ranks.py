"""Dense numbers in a total order, without a window that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.sources.scratch import scratch


def dense_index(rows: DataFrame, order: list[Column], name: str = "idx") -> DataFrame:
    """rows with `name`: 0, 1, 2 and so on in the order of `order`, which must be total.

    Rows are dealt into ranges by sampled bounds, so that skewed or many values make no large range, and written once: numbers within a
    range and the counts of the ranges before it then come from the same deal. Only the counts, one row per range, meet in one task.
    """
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "ranges")
    rows.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    counts = dealt.groupBy("range_").agg(F.count("*").alias("n"))
    offsets = counts.select("range_", (F.sum("n").over(Window.orderBy("range_")) - F.col("n")).alias("before"))
    local = F.row_number().over(Window.partitionBy("range_").orderBy(*order))
    found = dealt.withColumn("local", local).join(F.broadcast(offsets), "range_")  # one row per range of rows
    return found.withColumn(name, (F.col("before") + F.col("local") - 1).cast("long")).drop("range_", "local", "before")


def index_within(rows: DataFrame, group: str, order: list[Column], name: str = "idx") -> DataFrame:
    """rows with `name`: 0, 1, 2 and so on within each value of `group`, however many rows one has."""
    numbered = dense_index(rows, [F.col(group), *order], "all_")
    path = scratch(rows.sparkSession, "numbered")
    numbered.write.parquet(path)
    numbered = rows.sparkSession.read.parquet(path)
    first = numbered.groupBy(group).agg(F.min("all_").alias("first_"))
    return numbered.join(first, group).withColumn(name, F.col("all_") - F.col("first_")).drop("all_", "first_")


def running_total(rows: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """rows with `name`: the sum of `value` over the rows before it in the order of `order`, dealt like dense_index()."""
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "ranges")
    rows.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    sums = dealt.groupBy("range_").agg(F.sum(value).alias("n"))
    offsets = sums.select("range_", (F.sum("n").over(Window.orderBy("range_")) - F.col("n")).alias("before"))
    local = F.sum(value).over(Window.partitionBy("range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    return dealt.withColumn(name, local).join(F.broadcast(offsets), "range_").withColumn(name, F.col(name) + F.col("before")).drop("range_", "before")  # one row per range of rows
