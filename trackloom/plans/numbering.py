"""Consecutive numbers for all rows without sorting them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.plans.stage import staged


def number_rows(df: DataFrame, order: list[str], name: str, first: int = 0) -> DataFrame:
    """Adds ``name``, first, first + 1, ... in order of ``order``, which must have no ties.

    Rows are range-partitioned, numbered within their partition and shifted by
    the sizes of those before; only one row a partition is summed in one place.
    The partitioned rows are staged, so that both steps see the same ranges.
    """
    parts = staged(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = parts.groupBy("_p").count()
    base = sizes.select("_p", (F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("_base"))
    inner = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return parts.withColumn("_k", inner).join(F.broadcast(base), "_p").withColumn(name, F.col("_base") + F.col("_k") - 1 + first).drop("_p", "_k", "_base")
