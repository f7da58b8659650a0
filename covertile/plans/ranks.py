"""Dense ranks over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace


def ranked(
    ws: Workspace, df: DataFrame, by: list[str], order: list[Column], name: str, rank: str
) -> DataFrame:
    """Add a 1-based dense position within ``by`` along ``order`` (which must be unique in ``by``).

    The rows are range partitioned and sorted, so one large group spreads over many tasks. Only
    one count per (partition, group) goes through a window, and that is bounded by the number of
    partitions. The sorted rows are written first: range bounds are sampled, and a second
    evaluation may cut elsewhere.
    """
    keys = [F.col(c) for c in by]
    laid = ws.write(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id()),
        name,
    )
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        laid.groupBy(*by, "_part")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    return laid.join(starts, [*by, "_part"]).select(
        *df.columns, (F.col("_before") + F.col("_pos") - F.col("_first") + 1).alias(rank)
    )
