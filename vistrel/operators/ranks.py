"""Ranks within groups without sorting a group in one place: distinct values are counted, dealt out by range, and each part starts where the parts before it end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from vistrel.session import written


def value_ranks(counts: DataFrame, by: list[str], value: str, n: str) -> DataFrame:
    """counts with ``rank``, the mean rank from 1 of the ``n`` rows that share a value within ``by``. ``counts`` has a row for each value."""
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = written(counts.repartitionByRange(parts, *by, value).withColumn("_part", F.spark_partition_id()), "ranks")
    earlier = W.Window.partitionBy(*by).orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1)  # a row for each part
    offsets = spread.groupBy(*by, "_part").agg(F.sum(n).alias("_n")).select(*by, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    upto = F.sum(n).over(W.Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(W.Window.unboundedPreceding, 0))
    placed = spread.withColumn("_upto", upto).join(offsets, [*by, "_part"])
    return placed.withColumn("rank", F.col("_before") + F.col("_upto") - (F.col(n) - 1) / 2).drop("_part", "_upto", "_before")
