"""Running sums and ranks within groups of any size: no task sorts a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.runtime import cut


def _before(ranged: DataFrame, groups: list[str], order: list[str], to: str) -> DataFrame:
    sums = ranged.groupBy(*groups, "__range").agg(F.sum("__weight").alias("__sum"))
    earlier = W.partitionBy(*groups).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*groups, "__range", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__earlier"))
    within = W.partitionBy(*groups, "__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    joined = ranged.join(sums, [*groups, "__range"])
    return joined.withColumn(to, F.col("__earlier") + F.coalesce(F.sum("__weight").over(within), F.lit(0))).drop("__range", "__weight", "__earlier")


def before_by_hash(df: DataFrame, groups: list[str], order: str, tie: str, weight: Column, to: str = "before", bits: int = 12) -> DataFrame:
    """Adds the weight of the group's rows that come earlier by (order, tie).

    `order` is a 64-bit number spread evenly, cut into 2**bits ranges. Groups have no nulls.
    """
    ranged = df.withColumn("__range", F.shiftright(F.col(order), 64 - bits)).withColumn("__weight", weight)
    return _before(ranged, groups, [order, tie], to)


def before_by_sort(df: DataFrame, groups: list[str], order: list[str], weight: Column, to: str = "before", parts: int | None = None) -> DataFrame:
    """The same for any order; ranges are those of a range partitioning. Groups have no nulls."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("__weight", weight).repartitionByRange(parts, *groups, *order)
    return _before(cut(ranged.withColumn("__range", F.spark_partition_id())), groups, order, to)
