"""Consecutive ids in a total order, without pulling a table into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .materialize import written


def numbered(df: DataFrame, name: str, *order: Column, start: int = 0) -> DataFrame:
    """Adds `name` (long): the position of each row in `order` (unique), from `start`.

    Rows are range-partitioned by the order and written with the number of their part, so that it can't change if an executor
    is lost; each part numbers its own rows and adds the counts of the parts before it, of which there is one per partition.
    """
    part = "_part"
    ranged = written(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    sizes = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy(part)) - F.col("_n")).select(part, "_before")
    own = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return ranged.withColumn(name, own).join(F.broadcast(before), part).withColumn(name, F.col(name) + F.col("_before") - 1 + start).drop(part, "_before")
