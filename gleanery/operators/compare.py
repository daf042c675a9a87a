"""Comparison of models, conditions and configurations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators.ordering import before_by_sort


def model_changes(rows: DataFrame, file: str, a: str, b: str) -> DataFrame:
    """Files whose prediction differs between two versions: fixed, broken, still wrong, not scored.

    `rows`: one row for each (file, model_version); a file takes one shuffle.
    """
    pick = lambda v, c: F.max(F.when(F.col("model_version") == v, F.col(c)))
    both = rows.filter(F.col("model_version").isin(a, b)).groupBy(file).agg(pick(a, "predicted_class").alias("before"), pick(b, "predicted_class").alias("after"), F.max("actual_class").alias("actual"))
    change = (
        F.when(F.col("actual").isNull(), "not scored")
        .when(F.col("after") == F.col("actual"), "fixed")
        .when(F.col("before") == F.col("actual"), "broken")
        .otherwise("still wrong")
    )
    return both.filter("before <> after").select(file, "before", "after", change.alias("change"))


def version_cells(rows: DataFrame, file: str, versions: list[str]) -> DataFrame:
    """One row a file, one column a version: the predicted class or null."""
    cells = (F.max(F.when(F.col("model_version") == v, F.col("predicted_class"))).alias(v) for v in versions)
    return rows.groupBy(file).agg(*cells)


def paired_deltas(rows: DataFrame, file: str, before: str, after: str) -> DataFrame:
    """Per class: accuracy in two conditions, their difference, changed predictions, median megapixels."""
    pick = lambda v, c: F.max(F.when(F.col("model_version") == v, F.col(c)))
    pairs = rows.filter(F.col("model_version").isin(before, after)).groupBy(file).agg(
        pick(before, "predicted_class").alias("p"), pick(after, "predicted_class").alias("q"), F.max("actual_class").alias("actual_class"), F.max("megapixels").alias("megapixels")
    ).filter("p is not null and q is not null and actual_class is not null")
    hit = lambda c: F.avg((F.col(c) == F.col("actual_class")).cast("int"))
    x = pairs.groupBy("actual_class").agg(F.count("*").alias("n"), hit("p").alias("accuracy_before"), hit("q").alias("accuracy_after"), F.count_if(F.col("p") != F.col("q")).alias("changed"), F.median("megapixels").alias("median_megapixels"))
    return x.withColumn("delta", F.col("accuracy_after") - F.col("accuracy_before"))


def config_differences(settings: DataFrame) -> DataFrame:
    """(setting, values): settings that differ between versions. `settings`: version, setting, value.

    A version without the setting counts as null; settings that are null everywhere don't differ.
    """
    versions = settings.agg(F.count_distinct("version")).first()[0]
    x = settings.groupBy("setting").agg(F.count_distinct("value").alias("d"), F.count_distinct(F.when(F.col("value").isNotNull(), F.col("version"))).alias("given"), F.array_sort(F.collect_list(F.struct("version", "value"))).alias("values"))
    return x.filter((F.col("d") > 1) | ((F.col("d") == 1) & (F.col("given") < versions))).select("setting", F.array_join(F.transform("values", lambda s: F.concat_ws("=", s["version"], F.coalesce(s["value"], F.lit("none")))), ", ").alias("values"))


def class_profiles(rows: DataFrame, label: str, order: list[str], keys: list[str], first: int | None = None) -> DataFrame:
    """(label, n, keys): means of each class, of its `first` rows in `order` if given."""
    if first is not None:
        numbered = before_by_sort(rows, [label], order, F.lit(1), "__place")
        rows = numbered.filter(F.col("__place") < first)
    return rows.groupBy(label).agg(F.count("*").alias("n"), *(F.avg(k).alias(k) for k in keys))


def nearest_profile(rows: DataFrame, profiles: DataFrame, key: str, keys: list[str], label: str) -> DataFrame:
    """(key, label, distance): the profile with the least Euclidean distance, ties by label.

    Profiles are one row a class: they are collected, at most 10,000, and compared in place, without a join.
    """
    table = profiles.select(label, *keys).limit(10_001).collect()
    if len(table) > 10_000:
        raise ValueError("more than 10,000 profiles")
    options = []
    for r in table:
        apart = F.sqrt(reduce(lambda s, k: s + F.pow(F.col(k) - F.lit(float(r[k] or 0.0)), 2), keys, F.lit(0.0)))
        options.append(F.struct(apart.alias("distance"), F.lit(r[label]).alias(label)))
    best = F.array_min(F.array(*options)) if options else F.lit(None).cast(f"struct<distance:double,{label}:string>")
    return rows.select(key, best.alias("b")).select(key, f"b.{label}", "b.distance")


def background_robustness(rows: DataFrame) -> DataFrame:
    """Per class: accuracy on originals and composites, the drop, share called the source class, confidence when wrong.

    `rows`: actual_class, predicted_class, confidence, composite (boolean), background_class.
    """
    hit = (F.col("actual_class") == F.col("predicted_class")).cast("int")
    on = F.col("composite")
    fooled = (F.col("predicted_class") == F.col("background_class")).cast("int")
    x = rows.filter("actual_class is not null").groupBy("actual_class").agg(
        F.avg(F.when(~on, hit)).alias("accuracy_plain"), F.avg(F.when(on, hit)).alias("accuracy_composite"), F.avg(F.when(on, fooled)).alias("called_background"), F.avg(F.when(on & (hit == 0), F.col("confidence"))).alias("confidence_wrong")
    )
    return x.withColumn("drop", F.col("accuracy_plain") - F.col("accuracy_composite"))
