"""Allocation and selection in closed form: water-filling, remainders, strides, greedy splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.operators.ordering import before_by_hash, before_by_sort


def even_allocation(df: DataFrame, groups: list[str], key: str, supply: str, budget: Column, to: str = "selected") -> DataFrame:
    """Spends a group's budget evenly over its suppliers; what one lacks goes to the others.

    Suppliers are taken from the smallest; with n of them, a supplier is used up if what the
    smaller ones give and n times its supply fit the budget. The rest get equal parts, the
    first by `key` one more each. `budget` must be constant in a group. One row a supplier:
    these tables are small aggregates.
    """
    w = W.partitionBy(*groups)
    asc = w.orderBy(supply, key)
    x = df.withColumn("__b", F.least(budget.cast("bigint"), F.sum(supply).over(w)))
    x = x.withColumn("__smaller", F.coalesce(F.sum(supply).over(asc.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("__from", F.count("*").over(w) - F.row_number().over(asc) + 1)
    x = x.withColumn("__used_up", F.col("__smaller") + F.col(supply) * F.col("__from") <= F.col("__b"))
    x = x.withColumn("__rest", F.col("__b") - F.coalesce(F.sum(F.when(F.col("__used_up"), F.col(supply))).over(w), F.lit(0)))
    x = x.withColumn("__open", F.count(F.when(~F.col("__used_up"), 1)).over(w))
    x = x.withColumn("__turn", F.row_number().over(w.orderBy(F.col("__used_up").cast("int"), key)))
    part = F.expr("__rest div greatest(__open, 1)") + (F.col("__turn") <= F.col("__rest") % F.greatest("__open", F.lit(1))).cast("bigint")
    return x.withColumn(to, F.when(F.col("__used_up"), F.col(supply)).otherwise(part)).drop("__b", "__smaller", "__from", "__used_up", "__rest", "__open", "__turn")


def largest_remainder(df: DataFrame, groups: list[str], key: str, share: Column, total: Column, to: str = "seats") -> DataFrame:
    """Whole parts of `total` in proportion to shares that sum to 1; remainders go to the largest fractions."""
    w = W.partitionBy(*groups)
    x = df.withColumn("__exact", share * total).withColumn("__floor", F.floor("__exact").cast("bigint"))
    x = x.withColumn("__short", total.cast("bigint") - F.sum("__floor").over(w))
    x = x.withColumn("__turn", F.row_number().over(w.orderBy(F.round(F.col("__exact") - F.col("__floor"), 9).desc(), key)))
    return x.withColumn(to, F.col("__floor") + (F.col("__turn") <= F.col("__short")).cast("bigint")).drop("__exact", "__floor", "__short", "__turn")


def stride_kept(rank: Column, take: Column, n: Column) -> Column:
    """Whether the 0-based rank is among `take` of `n` spread evenly (midpoints)."""
    step = lambda r: F.floor((2 * take * r + n - 1) / (2 * n))
    return (take >= n) | (step(rank + 1) > step(rank))


def stride_select(df: DataFrame, groups: list[str], order: str, take: str, size: str) -> DataFrame:
    """Rows of each group spread evenly over its order; `take` and `size` are columns of the row."""
    ranked = before_by_sort(df, groups, [order], F.lit(1), "__rank")
    return ranked.filter(stride_kept(F.col("__rank"), F.col(take), F.col(size))).drop("__rank")


def greedy_split(groups: DataFrame, strata: list[str], group: str, size: str, test: float, validation: float, seed: int = 42) -> DataFrame:
    """Adds ``split``: whole groups, in a seeded order within their stratum, first fill test, then validation.

    A group goes to test if fewer records than test's target lie before it, to validation if
    fewer than validation's target lie between test and it, else to train.
    """
    parts = [F.lit(str(seed)), *(F.col(s).cast("string") for s in strata), F.col(group).cast("string")]
    order = F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16), 16, -10).cast("bigint")
    keyed = groups.withColumn("__order", order).withColumns({f"__s{k}": F.coalesce(F.col(s).cast("string"), F.lit("")) for k, s in enumerate(strata)})
    named = [f"__s{k}" for k in range(len(strata))]
    totals = keyed.groupBy(*named).agg(F.sum(size).alias("__total"))
    x = before_by_hash(keyed, named, "__order", group, F.col(size), "__before").join(totals, named)
    in_test = F.col("__before") < F.lit(test) * F.col("__total")
    tested = x.filter(in_test).groupBy(*named).agg(F.sum(size).alias("__tested"))
    x = x.join(tested, named, "left")
    rest = F.col("__before") - F.coalesce("__tested", F.lit(0))
    split = F.when(in_test, "test").when(rest < F.lit(validation) * F.col("__total"), "validation").otherwise("train")
    return x.withColumn("split", split).drop("__order", "__total", "__before", "__tested", *named)


def sampling_plan(supply: DataFrame, ratio: float) -> DataFrame:
    """(class, source, available, cap, selected): each class at most `ratio` times the smallest, evenly over sources."""
    total = F.sum("available").over(W.partitionBy("class_name"))
    x = supply.withColumn("__total", total).withColumn("cap", F.floor(F.min("__total").over(W.partitionBy()) * F.lit(ratio)).cast("bigint"))
    return even_allocation(x.drop("__total"), ["class_name"], "source", "available", F.col("cap"))


def sampling_limits(supply: DataFrame, ratio: float) -> DataFrame:
    """One row: the smallest class (of equals the first name), the cap it sets, largest over smallest before and after."""
    totals = supply.groupBy("class_name").agg(F.sum("available").alias("total"))
    least = totals.agg(F.min(F.struct("total", "class_name")).alias("m"), F.max("total").alias("most"))
    cap = F.floor(F.col("m.total") * F.lit(ratio)).cast("bigint")
    return least.select(F.col("m.class_name").alias("binding_class"), cap.alias("cap"), (F.col("most") / F.col("m.total")).alias("imbalance_before"), (F.least("most", cap) / F.least(F.col("m.total"), cap)).alias("imbalance_after"))
