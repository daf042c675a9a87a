"""Classification metrics over (actual, predicted, confidence) rows and a class table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CONDITIONS = ["lighting", "background", "distance", "angle", "quality"]


def _share(n: Column, of: Column) -> Column:
    return n / F.when(of != 0, of)


def per_class(scored: DataFrame, classes: DataFrame, actual: str = "actual_class", predicted: str = "predicted_class") -> DataFrame:
    """Support, precision, recall, F1 (0 where undefined), accuracy and mean confidence of every class.

    One pass: each row counts once for its actual and once for its predicted class. Rows
    without an actual class don't count. Accuracy and confidence are null for support 0.
    """
    known = scored.filter(F.col(actual).isNotNull())
    sides = F.array(
        F.struct(F.col(actual).alias("class_name"), F.lit(1).alias("is_actual")),
        F.struct(F.col(predicted).alias("class_name"), F.lit(0).alias("is_actual")),
    )
    each = known.select(F.explode(sides).alias("s"), (F.col(actual) == F.col(predicted)).alias("hit"), "confidence").select("s.*", "hit", "confidence")
    mine = F.col("is_actual") == 1
    counts = each.groupBy("class_name").agg(
        F.count_if(mine).alias("support"),
        F.count_if(~mine).alias("n_predicted"),
        F.count_if(mine & F.col("hit")).alias("true_positives"),
        F.avg(F.when(mine, F.col("confidence"))).alias("mean_confidence"),
    )
    x = classes.select("idx", "class_name").join(counts, "class_name", "left").na.fill(0, ["support", "n_predicted", "true_positives"])
    precision = F.coalesce(_share(F.col("true_positives"), F.col("n_predicted")), F.lit(0.0))
    recall = F.coalesce(_share(F.col("true_positives"), F.col("support")), F.lit(0.0))
    x = x.withColumn("precision", precision).withColumn("recall", recall)
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / F.when(F.col("precision") + F.col("recall") > 0, F.col("precision") + F.col("recall")), F.lit(0.0))
    accuracy = _share(F.col("true_positives"), F.col("support"))
    return x.select("idx", "class_name", "support", "n_predicted", "true_positives", "precision", "recall", f1.alias("f1"), accuracy.alias("accuracy"), "mean_confidence")


def overall(scored: DataFrame, classes: DataFrame) -> DataFrame:
    """One row: accuracy, macro scores over every class, weighted scores by support."""
    c = per_class(scored, classes)
    total = F.sum("support")
    aggs = [total.alias("n"), _share(F.sum("true_positives"), total).alias("accuracy")]
    for m in ("precision", "recall", "f1"):
        aggs += [F.avg(m).alias(f"macro_{m}"), _share(F.sum(F.col(m) * F.col("support")), total).alias(f"weighted_{m}")]
    return c.agg(*aggs)


def confusion(scored: DataFrame, classes: DataFrame) -> DataFrame:
    """(actual_idx, predicted_idx, n, share): every pair of classes; share of the actual class, 0 for empty ones."""
    names = classes.select("idx", "class_name")
    many = classes.count()  # the class table is configuration
    grid = names.select(F.col("idx").alias("actual_idx"), F.col("class_name").alias("actual_class"), F.explode(F.sequence(F.lit(0), F.lit(max(many - 1, 0)))).alias("predicted_idx"))
    grid = grid.join(names.select(F.col("idx").alias("predicted_idx"), F.col("class_name").alias("predicted_class")), "predicted_idx")
    counts = scored.filter("actual_class is not null and predicted_class is not null").groupBy("actual_class", "predicted_class").agg(F.count("*").alias("n"))
    x = grid.join(counts, ["actual_class", "predicted_class"], "left").na.fill(0, ["n"])
    share = F.coalesce(_share(F.col("n"), F.sum("n").over(W.partitionBy("actual_class"))), F.lit(0.0))
    return x.select("actual_idx", "predicted_idx", "actual_class", "predicted_class", "n", share.alias("share"))


def confused_pairs(matrix: DataFrame, k: int = 5) -> DataFrame:
    """The `k` most frequent wrong pairs; ties in class order."""
    wrong = matrix.filter("n > 0 and actual_idx <> predicted_idx")
    ranked = wrong.orderBy(F.desc("n"), "actual_idx", "predicted_idx").limit(k)
    return ranked.select("actual_class", "predicted_class", "n", "share")


def mean_confidences(scored: DataFrame) -> DataFrame:
    hit = F.col("actual_class") == F.col("predicted_class")
    return scored.filter("actual_class is not null").agg(
        F.avg("confidence").alias("mean_all"), F.avg(F.when(hit, F.col("confidence"))).alias("mean_correct"), F.avg(F.when(~hit, F.col("confidence"))).alias("mean_wrong")
    )


def thresholds(scored: DataFrame, levels: list[float]) -> DataFrame:
    """(threshold, n_above, coverage, accuracy_above, accuracy_below): one pass over the rows."""
    known = scored.filter("actual_class is not null").select((F.col("actual_class") == F.col("predicted_class")).cast("int").alias("hit"), "confidence")
    each = known.withColumn("threshold", F.explode(F.array(*map(F.lit, levels))))
    above = F.col("confidence") >= F.col("threshold")
    return each.groupBy("threshold").agg(
        F.count_if(above).alias("n_above"), _share(F.count_if(above), F.count("*")).alias("coverage"), F.avg(F.when(above, F.col("hit"))).alias("accuracy_above"), F.avg(F.when(~above, F.col("hit"))).alias("accuracy_below")
    )


def errors_per_class(scored: DataFrame, classes: DataFrame) -> DataFrame:
    """Errors, error rate, mean confidence when wrong, most frequent wrong class (ties in class order)."""
    known = scored.filter("actual_class is not null")
    wrong = F.col("actual_class") != F.col("predicted_class")
    base = known.groupBy("actual_class").agg(F.count("*").alias("n"), F.count_if(wrong).alias("errors"), F.avg(F.when(wrong, F.col("confidence"))).alias("mean_confidence_wrong"))
    order = classes.select(F.col("class_name").alias("predicted_class"), F.col("idx").alias("o"))
    most = known.filter(wrong).groupBy("actual_class", "predicted_class").agg(F.count("*").alias("c")).join(order, "predicted_class", "left")
    most = most.groupBy("actual_class").agg(F.max_by("predicted_class", F.struct("c", (-F.col("o")).alias("o"))).alias("most_common_wrong"))
    x = classes.select("idx", F.col("class_name").alias("actual_class")).join(base, "actual_class", "left").join(most, "actual_class", "left").na.fill(0, ["n", "errors"])
    return x.select("actual_class", "n", "errors", _share(F.col("errors"), F.col("n")).alias("error_rate"), "mean_confidence_wrong", "most_common_wrong")


def confident_errors(scored: DataFrame, key: str, k: int = 25) -> DataFrame:
    """The `k` surest wrong predictions that aren't flagged low."""
    wrong = scored.filter("actual_class is not null and actual_class <> predicted_class and not low_confidence")
    return wrong.orderBy(F.desc("confidence"), key).limit(k).select(key, "actual_class", "predicted_class", "confidence")


def bands(scored: DataFrame, n: int, by: list[str] | None = None) -> DataFrame:
    """Equal bands of confidence, the last closed, empty ones omitted: n, accuracy, mean confidence."""
    edges = F.lit(0)
    for k in range(1, n):
        edges = edges + (F.col("confidence") >= F.lit(k / n)).cast("int")
    known = scored.filter("confidence is not null").withColumn("band", edges).withColumn("__hit", (F.col("actual_class") == F.col("predicted_class")).cast("int"))
    return known.groupBy(*(by or []), "band").agg(F.count("*").alias("n"), F.avg("__hit").alias("accuracy"), F.avg("confidence").alias("mean_confidence"))


def condition_breakdown(rows: DataFrame, dims: list[str]) -> DataFrame:
    """(dimension, value, n, accuracy, ...): overall, per class and per value of each condition.

    Each row is unpivoted to its (dimension, value) entries once, then one aggregate.
    """
    pairs = [("overall", F.lit("all")), ("class", F.col("actual_class")), *((d, F.col(d)) for d in dims)]
    entries = [F.struct(F.lit(d).alias("dimension"), v.alias("value")) for d, v in pairs]
    known = rows.filter("actual_class is not null").withColumn("__hit", (F.col("actual_class") == F.col("predicted_class")).cast("int"))
    each = known.select(F.explode(F.array(*entries)).alias("e"), "__hit", "confidence", "low_confidence", "uncertain").select("e.*", "__hit", "confidence", "low_confidence", "uncertain")
    return each.groupBy("dimension", "value").agg(
        F.count("*").alias("n"), F.avg("__hit").alias("accuracy"), F.avg("confidence").alias("mean_confidence"), F.avg(F.col("low_confidence").cast("int")).alias("low_rate"), F.avg(F.col("uncertain").cast("int")).alias("uncertain_rate")
    )


def row_status(rows: DataFrame) -> DataFrame:
    status = F.when(F.col("predicted_class").isNull(), "failed").when(F.col("actual_class").isNull(), "unlabelled").otherwise("labelled")
    return rows.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def scorecard(rows: DataFrame, version: str = "model_version", *by: str) -> DataFrame:
    """Per model, and by further columns: labelled rows, accuracy, mean confidences, errors above the low-confidence mark."""
    hit = F.col("actual_class") == F.col("predicted_class")
    return rows.filter("actual_class is not null").groupBy(version, *by).agg(
        F.count("*").alias("n"), F.avg(hit.cast("int")).alias("accuracy"), F.avg("confidence").alias("mean_confidence"),
        F.avg(F.when(hit, F.col("confidence"))).alias("mean_correct"), F.avg(F.when(~hit, F.col("confidence"))).alias("mean_wrong"), F.count_if(~hit & ~F.col("low_confidence")).alias("confident_errors"),
    )


def class_weights(counts: DataFrame) -> DataFrame:
    """(class_name, n, weight): inverse frequency, 1 for absent classes, over the mean of all classes."""
    w = W.partitionBy()
    present = F.sum((F.col("n") > 0).cast("int")).over(w)
    raw = F.when(F.col("n") > 0, F.sum("n").over(w) / (present * F.col("n"))).otherwise(1.0)
    return counts.withColumn("__raw", raw).withColumn("weight", F.col("__raw") / F.avg("__raw").over(w)).drop("__raw")


def quality_comparison(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, outcome, mean, std, n): population deviation, long form."""
    entries = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics))
    outcome = F.when(F.col("actual_class") == F.col("predicted_class"), "correct").otherwise("incorrect")
    each = rows.filter("actual_class is not null").select(outcome.alias("outcome"), F.explode(entries).alias("e")).select("outcome", "e.*").filter("x is not null")
    return each.groupBy("metric", "outcome").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.count("*").alias("n"))


def notable(comparison: DataFrame) -> DataFrame:
    """Metrics whose means differ by more than the deviation among correct rows, of 3 errors or more."""
    side = lambda o: F.col("outcome") == o
    x = comparison.groupBy("metric").agg(*(F.max(F.when(side(o), F.col(c))).alias(f"{c}_{o}") for o in ("correct", "incorrect") for c in ("mean", "std", "n")))
    return x.filter("n_incorrect >= 3 and std_correct > 0 and abs(mean_incorrect - mean_correct) > std_correct").select("metric", "mean_correct", "mean_incorrect", "std_correct")
