"""Corpus profiles: counts, imbalance, overlap between sources, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def corpus_profile(df: DataFrame, classes: DataFrame, valid: str, ext: str) -> DataFrame:
    """Per class, empty ones too: total, valid, invalid, share, mean sizes of valid rows, files by format."""
    v = F.col(valid)
    base = df.groupBy("class_name").agg(F.count("*").alias("total"), F.count_if(v).alias("valid"), F.avg(F.when(v, F.col("width"))).alias("mean_width"), F.avg(F.when(v, F.col("height"))).alias("mean_height"))
    formats = df.filter(v).groupBy("class_name", ext).agg(F.count("*").alias("n")).groupBy("class_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(ext, "n"))), lambda s: F.concat_ws("=", s[ext], s["n"].cast("string"))), ", ").alias("formats"))
    x = classes.select("idx", "class_name").join(base, "class_name", "left").join(formats, "class_name", "left").na.fill(0, ["total", "valid"])
    share = F.col("valid") / F.sum("valid").over(W.partitionBy())
    return x.select("class_name", "total", "valid", (F.col("total") - F.col("valid")).alias("invalid"), share.alias("share"), "mean_width", "mean_height", "formats")


def imbalance(counts: DataFrame, limit: float) -> DataFrame:
    """One row: largest over smallest non-empty class (null for fewer than two), and whether above `limit`."""
    some = counts.filter("n > 0").agg(F.max("n").alias("hi"), F.min("n").alias("lo"), F.count("*").alias("classes"))
    ratio = F.when(F.col("classes") > 1, F.col("hi") / F.col("lo"))
    return some.select("classes", ratio.alias("ratio"), F.coalesce(ratio > limit, F.lit(False)).alias("warn"))


def too_few(counts: DataFrame, least: int) -> DataFrame:
    return counts.filter(f"n > 0 and n < {int(least)}").select("class_name", "n")


def split_counts(df: DataFrame, classes: DataFrame, splits: list[str]) -> DataFrame:
    """Class by split with zeros; a class's total and share of rows without split come along."""
    counts = df.groupBy("class_name").agg(*(F.count_if(F.col("split") == s).alias(s) for s in splits), F.count("*").alias("total"))
    return classes.select("class_name").join(counts, "class_name", "left").na.fill(0)


def overlap(grouped: DataFrame, group: str) -> DataFrame:
    """Per class: groups of several images within one source and across sources, images in the latter, rate."""
    sizes = grouped.groupBy("class_name", group).agg(F.count("*").alias("n"), F.min("source").alias("lo"), F.max("source").alias("hi"))
    many, cross = F.col("n") > 1, F.col("lo") < F.col("hi")
    x = sizes.groupBy("class_name").agg(
        F.sum("n").alias("images"), F.count_if(many & ~cross).alias("within_groups"), F.count_if(cross).alias("cross_groups"),
        F.coalesce(F.sum(F.when(cross, F.col("n"))), F.lit(0)).alias("cross_images"), F.coalesce(F.max(F.when(cross, F.col("n"))), F.lit(0)).alias("largest_cross"),
    )
    return x.withColumn("cross_rate", F.col("cross_images") / F.col("images"))


def shared_sources(grouped: DataFrame, group: str) -> DataFrame:
    """(left, right, shared_groups): pairs of sources with the number of groups that hold both.

    A group holds each source once, so pairs are at most those of the sources, whatever the group's size.
    """
    each = grouped.filter("source is not null").select(group, "source").distinct()
    right = each.select(group, F.col("source").alias("right"))
    pairs = each.withColumnRenamed("source", "left").join(right, group).filter(F.col("left") < F.col("right"))
    return pairs.groupBy("left", "right").agg(F.count("*").alias("shared_groups"))


def overlap_verdict(per_class: DataFrame, shared: DataFrame, sizes: DataFrame, rate: float = 0.05, pair_share: float = 0.20) -> DataFrame:
    """Reasons to treat sources as overlapping: a class's cross rate, or a pair's share of its smaller source."""
    by_class = per_class.filter(F.col("cross_rate") > rate).select(F.lit("class").alias("kind"), F.col("class_name").alias("name"), F.col("cross_rate").alias("value"))
    n = sizes.select("source", "n")
    x = shared.join(n.withColumnsRenamed({"source": "left", "n": "ln"}), "left").join(n.withColumnsRenamed({"source": "right", "n": "rn"}), "right")
    share = F.col("shared_groups") / F.least("ln", "rn")
    pairs = x.withColumn("value", share).filter(F.col("value") > pair_share).select(F.lit("pair").alias("kind"), F.concat_ws("|", "left", "right").alias("name"), "value")
    return by_class.union(pairs)


def variant_summary(df: DataFrame) -> DataFrame:
    """Of the full and the balanced variant: counts by class and split, family, source, split and
    family, class, and split; one pass of grouping sets over both."""
    in_full = F.col("split").isNotNull()
    variants = F.array_compact(F.array(F.when(in_full, "full"), F.when(in_full & F.col("in_balanced"), "balanced")))
    c, s, f, o = (F.col(x) for x in ("class_name", "split", "family", "source"))
    v = F.col("variant")
    sets = [[v, c, s], [v, c, f], [v, c, o], [v, c, s, f], [v, c], [v, s]]
    x = df.select(F.explode(variants).alias("variant"), c, s, f, o).groupingSets(sets, v, c, s, f, o)
    return x.agg(F.count("*").alias("n"), F.grouping_id(v, c, s, f, o).cast("bigint").alias("level"))


def removal_counts(removed: DataFrame) -> DataFrame:
    return removed.groupBy("reason", "class_name", "source").agg(F.count("*").alias("n"))


def largest_source(supply: DataFrame) -> DataFrame:
    """Per class: sources and the share of the largest."""
    return supply.groupBy("class_name").agg(F.count("*").alias("sources"), F.sum("available").alias("total"), (F.max("available") / F.sum("available")).alias("largest_share"))


def count_drift(expected: DataFrame, found: DataFrame, keys: list[str], least: int = 5, share: float = 0.10) -> DataFrame:
    """Keys whose count is off by more than `least` and by more than `share` of the expected."""
    x = expected.join(found, keys, "full").na.fill(0, ["expected", "found"])
    return x.filter(F.abs(F.col("found") - F.col("expected")) > F.greatest(F.lit(float(least)), F.col("expected") * share)).select(*keys, "expected", "found")


def merged_history(epochs: DataFrame) -> DataFrame:
    """One row a run: epochs of its phases in sequence, best and last values. `epochs`: run, phase, epoch, val_accuracy, val_loss."""
    at = F.struct("phase", "epoch")
    return epochs.groupBy("run").agg(F.count("*").alias("epochs"), F.max("val_accuracy").alias("best_accuracy"), F.min("val_loss").alias("best_loss"), F.max_by("val_accuracy", at).alias("last_accuracy"), F.max_by("val_loss", at).alias("last_loss"))
