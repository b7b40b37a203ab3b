"""Consecutive numbers over a global order without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwarden.session import written


def number_rows(df: DataFrame, order: list[Column], name: str, start: int = 1) -> DataFrame:
    """Adds `name` = start, start+1, ... along `order`, which must end in a unique column.

    The rows are range-partitioned once and written, so that both passes see the same ranges;
    each range numbers its own rows and adds the sizes of the ranges before it.
    """
    ranged = written(
        df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges"
    )
    # one row per range, so never more than the shuffle partitions
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select(
        "_part",
        (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_offset"),
    )
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (
        ranged.withColumn("_local", local)
        .join(F.broadcast(before), "_part")
        .withColumn(name, (F.col("_local") + F.col("_offset") + F.lit(start - 1)).cast("bigint"))
        .drop("_part", "_local", "_offset")
    )
