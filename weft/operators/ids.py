"""Dense ids without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense_ids(df: DataFrame, name: str, bucket: Column, *order: Column) -> DataFrame:
    """df with name = 1, 2, ... in the order of (bucket, order).

    Rows are numbered within their bucket; only one row per bucket takes part in the running sum over buckets.
    """
    kept = df.withColumn("__bucket", bucket)
    counts = kept.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order))
    return kept.withColumn("__row", within).join(offsets, "__bucket").withColumn(name, F.col("__before") + F.col("__row")).drop("__bucket", "__row", "__before")


def ranged(df: DataFrame, column: str) -> Column:
    """A bucket for dense_ids, in the order of a text column: how many of its sampled bounds lie at or below the value.

    The bounds are the least texts of ranges that Spark deals by sampled quantiles, so common beginnings such as `src/`
    don't fall into one bucket; the driver gets one text per range.
    """
    dealt = df.select(F.col(column).alias("t")).repartitionByRange("t")
    bounds = sorted(r[0] for r in dealt.groupBy(F.spark_partition_id()).agg(F.min("t").alias("t")).collect() if r[0] is not None)
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<string>"), lambda b: b <= F.col(column)))
