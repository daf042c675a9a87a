"""Predictions: probabilities, flags, metrics, comparison of models, conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import scalars as S
from gleanery.operators import compare, metrics
from gleanery.plans.registry import query
from gleanery.plans.tables import LABELS, P_COLUMNS, SQL_MANIFEST, SQL_POOL, SQL_PRED, classes, manifest, pool, predictions
from gleanery.runtime import cut, table

W_PRED = "WITH " + SQL_PRED
_P = "[" + ", ".join(P_COLUMNS) + "]"
_LABELS = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"
_ENTROPY = f"list_sum(list_transform({_P}, lambda x: -least(greatest(x, 1e-12), 1.0) * ln(least(greatest(x, 1e-12), 1.0)))) / ln({len(LABELS)})"
_RANKED = f"list_reverse_sort({_P})"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 10) for c in columns})


@query(W_PRED + f" SELECT prediction_id, {_LABELS}[list_position({_P}, list_max({_P}))] AS top_class, list_max({_P}) AS top, array_to_string(list_transform(list_slice(list_sort(list_zip({_P}, list_transform(generate_series(1, {len(LABELS)}), lambda i: -i)), 'DESC'), 1, 3), lambda s: {_LABELS}[-s[2]]), ' > ') AS ranked FROM pred WHERE {' AND '.join(c + ' IS NOT NULL' for c in P_COLUMNS)}")
def prediction_struct(spark: SparkSession, d: str) -> DataFrame:
    x = predictions(spark, d).dropna(subset=P_COLUMNS)
    names = F.array(*map(F.lit, LABELS))
    ranked = F.array_join(F.transform(F.slice(S.ranked_distribution(F.col("p"), LABELS), 1, 3), lambda s: s["class"]), " > ")
    return x.select("prediction_id", F.element_at(names, S.top_index(F.col("p")) + 1).alias("top_class"), F.array_max("p").alias("top"), ranked.alias("ranked"))


@query(W_PRED + f""", f AS (SELECT prediction_id, {_ENTROPY} AS entropy, {_RANKED}[1] - {_RANKED}[2] AS margin, list_max({_P}) AS top FROM pred)
    SELECT prediction_id, round(entropy, 10) AS entropy, round(margin, 10) AS margin, top < 0.6 AS low, concat_ws(',', CASE WHEN entropy > 0.8 THEN 'high_entropy' END, CASE WHEN margin < 0.1 THEN 'thin_margin' END, CASE WHEN top < 0.6 THEN 'low_confidence' END) AS reasons FROM f""")
def uncertainty_flags(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p")
    return predictions(spark, d).select(
        "prediction_id", F.round(S.entropy(p), 10).alias("entropy"), F.round(S.margin(p), 10).alias("margin"), (F.array_max(p) < 0.6).alias("low"), F.array_join(S.uncertainty_reasons(p), ",").alias("reasons")
    )


_TP = W_PRED + """, k AS (SELECT * FROM pred WHERE actual_class IS NOT NULL), a AS (SELECT actual_class AS c, count(*) AS support, count(*) FILTER (predicted_class = actual_class) AS tp, avg(confidence) AS conf FROM k GROUP BY 1), b AS (SELECT predicted_class AS c, count(*) AS np FROM k GROUP BY 1),
    m AS (SELECT idx, class_name, coalesce(support, 0) AS support, coalesce(np, 0) AS n_predicted, coalesce(tp, 0) AS true_positives, coalesce(tp / nullif(np, 0), 0.0) AS precision, coalesce(tp / nullif(support, 0), 0.0) AS recall, tp / nullif(support, 0) AS accuracy, conf FROM classes LEFT JOIN a ON a.c = class_name LEFT JOIN b ON b.c = class_name),
    f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM m)"""


@query(_TP + " SELECT idx, class_name, support, n_predicted, true_positives, round(precision, 10) AS precision, round(recall, 10) AS recall, round(f1, 10) AS f1, round(accuracy, 10) AS accuracy, round(conf, 10) AS mean_confidence FROM f")
def per_class_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.per_class(predictions(spark, d, "prediction_id"), classes(spark, d)), "precision", "recall", "f1", "accuracy", "mean_confidence")


@query(_TP + " SELECT sum(support)::BIGINT AS n, round(sum(true_positives) / sum(support), 10) AS accuracy, " + ", ".join(f"round(avg({m}), 10) AS macro_{m}, round(sum({m} * support) / sum(support), 10) AS weighted_{m}" for m in ("precision", "recall", "f1")) + " FROM f")
def overall_metrics(spark: SparkSession, d: str) -> DataFrame:
    x = metrics.overall(predictions(spark, d, "prediction_id"), classes(spark, d))
    return rounded(x, *(c for c in x.columns if c != "n"))


_CONF = W_PRED + ", n AS (SELECT actual_class, predicted_class, count(*) AS n FROM pred WHERE actual_class IS NOT NULL AND predicted_class IS NOT NULL GROUP BY ALL), mat AS (SELECT a.idx AS actual_idx, b.idx AS predicted_idx, a.class_name AS actual_class, b.class_name AS predicted_class, coalesce(n, 0) AS n FROM classes a CROSS JOIN classes b LEFT JOIN n ON n.actual_class = a.class_name AND n.predicted_class = b.class_name), ms AS (SELECT *, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY actual_class), 0), 0.0), 10) AS share FROM mat)"


@query(_CONF + " SELECT actual_idx, predicted_idx, actual_class, predicted_class, n, share FROM ms")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.confusion(predictions(spark, d, "prediction_id"), classes(spark, d)), "share")


@query(_CONF + " SELECT actual_class, predicted_class, n, share FROM ms WHERE n > 0 AND actual_idx <> predicted_idx ORDER BY n DESC, actual_idx, predicted_idx LIMIT 5")
def confusion_topk(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confused_pairs(confusion_matrix(spark, d))


@query(W_PRED + " SELECT round(avg(confidence), 10) AS mean_all, round(avg(confidence) FILTER (actual_class = predicted_class), 10) AS mean_correct, round(avg(confidence) FILTER (actual_class <> predicted_class), 10) AS mean_wrong FROM pred WHERE actual_class IS NOT NULL")
def mean_confidence(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.mean_confidences(predictions(spark, d, "prediction_id")), "mean_all", "mean_correct", "mean_wrong")


LEVELS = [0.5, 0.6, 0.7, 0.8, 0.9, 0.95]


@query(W_PRED + f", t AS (SELECT unnest({LEVELS})::DOUBLE AS threshold), k AS (SELECT confidence, (actual_class = predicted_class)::INT AS hit FROM pred WHERE actual_class IS NOT NULL) SELECT threshold, count(*) FILTER (confidence >= threshold) AS n_above, round(count(*) FILTER (confidence >= threshold) / count(*), 10) AS coverage, round(avg(hit) FILTER (confidence >= threshold), 10) AS accuracy_above, round(avg(hit) FILTER (NOT confidence >= threshold), 10) AS accuracy_below FROM k CROSS JOIN t GROUP BY threshold")
def threshold_analysis(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.thresholds(predictions(spark, d, "prediction_id"), LEVELS), "coverage", "accuracy_above", "accuracy_below")


@query(W_PRED + ", k AS (SELECT * FROM pred WHERE actual_class IS NOT NULL), g AS (SELECT actual_class, count(*) AS n, count(*) FILTER (predicted_class <> actual_class) AS errors, avg(confidence) FILTER (predicted_class <> actual_class) AS mw FROM k GROUP BY 1), w AS (SELECT actual_class, predicted_class, row_number() OVER (PARTITION BY actual_class ORDER BY count(*) DESC, any_value(idx)) AS r FROM k JOIN classes c ON c.class_name = predicted_class WHERE predicted_class <> actual_class GROUP BY 1, 2) SELECT c.class_name AS actual_class, coalesce(n, 0) AS n, coalesce(errors, 0) AS errors, round(errors / n, 10) AS error_rate, round(mw, 10) AS mean_confidence_wrong, w.predicted_class AS most_common_wrong FROM classes c LEFT JOIN g ON g.actual_class = c.class_name LEFT JOIN w ON w.actual_class = c.class_name AND w.r = 1")
def error_per_class(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.errors_per_class(predictions(spark, d, "prediction_id"), classes(spark, d)), "error_rate", "mean_confidence_wrong")


@query(W_PRED + " SELECT prediction_id, actual_class, predicted_class, confidence FROM pred WHERE actual_class <> predicted_class AND NOT low_confidence ORDER BY confidence DESC, prediction_id LIMIT 25")
def confident_errors(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confident_errors(predictions(spark, d, "prediction_id"), "prediction_id")


def _band(n: int) -> str:
    return " + ".join(f"(confidence >= {k / n!r}::DOUBLE)::INT" for k in range(1, n))


@query(W_PRED + f" SELECT {_band(20)} AS band, count(*) AS n FROM pred WHERE confidence IS NOT NULL GROUP BY 1")
def confidence_histogram(spark: SparkSession, d: str) -> DataFrame:
    return metrics.bands(predictions(spark, d, "prediction_id"), 20).select("band", "n")


@query(W_PRED + f" SELECT model_version, {_band(5)} AS band, count(*) AS n, round(avg((actual_class = predicted_class)::INT), 10) AS accuracy, round(avg(confidence), 10) AS mean_confidence FROM pred WHERE confidence IS NOT NULL GROUP BY 1, 2")
def calibration_bands(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.bands(predictions(spark, d, "prediction_id"), 5, ["model_version"]), "accuracy", "mean_confidence")


@query(W_PRED + " SELECT model_version, count(*) AS n, round(avg((actual_class = predicted_class)::INT), 10) AS accuracy, round(avg(confidence), 10) AS mean_confidence, round(avg(confidence) FILTER (actual_class = predicted_class), 10) AS mean_correct, round(avg(confidence) FILTER (actual_class <> predicted_class), 10) AS mean_wrong, count(*) FILTER (actual_class <> predicted_class AND NOT low_confidence) AS confident_errors FROM pred WHERE actual_class IS NOT NULL GROUP BY 1")
def scorecard(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.scorecard(predictions(spark, d, "prediction_id")), "accuracy", "mean_confidence", "mean_correct", "mean_wrong")


@query(W_PRED + " SELECT CASE WHEN predicted_class IS NULL THEN 'failed' WHEN actual_class IS NULL THEN 'unlabelled' ELSE 'labelled' END AS status, count(*) AS n FROM pred GROUP BY 1")
def row_status(spark: SparkSession, d: str) -> DataFrame:
    return metrics.row_status(predictions(spark, d, "prediction_id"))


_COND = W_PRED + ", " + SQL_MANIFEST + f", mm AS (SELECT *, row_number() OVER (ORDER BY file, lighting, background, distance, angle, quality) - 1 AS k FROM (SELECT DISTINCT file, lighting, background, distance, angle, quality FROM man)), kk AS (SELECT count(*) AS m FROM mm), rows AS (SELECT pred.*, {_ENTROPY} > 0.8 OR {_RANKED}[1] - {_RANKED}[2] < 0.1 OR list_max({_P}) < 0.6 AS uncertain, mm.* EXCLUDE (file, k) FROM pred, kk JOIN mm ON mm.k = prediction_id % m WHERE actual_class IS NOT NULL), ent AS (SELECT unnest([{{'d': 'overall', 'v': 'all'}}, {{'d': 'class', 'v': actual_class}}, " + ", ".join(f"{{{{'d': '{c}', 'v': {c}}}}}".replace("{{", "{").replace("}}", "}") for c in metrics.CONDITIONS) + "]) AS e, (actual_class = predicted_class)::INT AS hit, confidence, low_confidence, uncertain FROM rows)"
_COND = _COND.replace("{{", "{").replace("}}", "}")


@query(_COND + " SELECT e.d AS dimension, e.v AS value, count(*) AS n, round(avg(hit), 10) AS accuracy, round(avg(confidence), 10) AS mean_confidence, round(avg(low_confidence::INT), 10) AS low_rate, round(avg(uncertain::INT), 10) AS uncertain_rate FROM ent GROUP BY 1, 2")
def condition_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Predictions dealt to the held-out conditions by their number."""
    from pyspark.sql import Window as W

    conditions = metrics.CONDITIONS
    m = manifest(spark, d).select("file", *conditions).distinct()
    m = m.withColumn("k", (F.row_number().over(W.orderBy("file", *conditions)) - 1).cast("bigint"))  # a small, fixed table
    rows = predictions(spark, d).withColumn("k", F.col("prediction_id") % F.lit(m.count())).join(m.drop("file"), "k")
    rows = rows.withColumn("uncertain", F.size(S.uncertainty_reasons(F.col("p"))) > 0)
    x = metrics.condition_breakdown(rows, conditions)
    return rounded(x, "accuracy", "mean_confidence", "low_rate", "uncertain_rate")


@query(W_PRED + ", c AS (SELECT class_name, idx, count(prediction_id) AS n FROM classes LEFT JOIN pred ON actual_class = class_name GROUP BY ALL), r AS (SELECT *, CASE WHEN n > 0 THEN sum(n) OVER () / (count(*) FILTER (n > 0) OVER () * n) ELSE 1.0 END AS raw FROM c) SELECT class_name, n, round(raw / avg(raw) OVER (), 10) AS weight FROM r")
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    n = predictions(spark, d, "prediction_id").filter("actual_class is not null").groupBy(F.col("actual_class").alias("class_name")).agg(F.count("*").alias("n"))
    counts = classes(spark, d).select("class_name").join(n, "class_name", "left").na.fill(0, ["n"])
    return rounded(metrics.class_weights(counts), "weight")


_QUAL = "WITH " + SQL_POOL + SQL_PRED[SQL_PRED.index(", pred AS") :] + """, q AS (SELECT CASE WHEN pred.actual_class = predicted_class THEN 'correct' ELSE 'incorrect' END AS outcome, unnest([{'m': 'megapixels', 'x': width * height / 1e6}, {'m': 'aspect', 'x': CASE WHEN height = 0 THEN 0.0 ELSE width / height END}, {'m': 'confidence', 'x': confidence}]) AS e FROM pred JOIN pool USING (image_id) WHERE pred.actual_class IS NOT NULL),
    g AS (SELECT e.m AS metric, outcome, avg(e.x) AS mean, stddev_pop(e.x) AS std, count(*) AS n FROM q WHERE e.x IS NOT NULL GROUP BY 1, 2)"""


def _quality(spark: SparkSession, d: str) -> DataFrame:
    sizes = pool(spark, d, "width", "height").select("image_id", S.megapixels(F.col("width"), F.col("height")).alias("megapixels"), S.aspect(F.col("width"), F.col("height")).alias("aspect"))
    return metrics.quality_comparison(predictions(spark, d, "image_id").join(sizes, "image_id"), ["megapixels", "aspect", "confidence"])


@query(_QUAL + " SELECT metric, outcome, round(mean, 10) AS mean, round(std, 10) AS std, n FROM g")
def quality_comparison(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_quality(spark, d), "mean", "std")


@query(_QUAL + " SELECT a.metric, round(a.mean, 10) AS mean_correct, round(b.mean, 10) AS mean_incorrect, round(a.std, 10) AS std_correct FROM g a JOIN g b ON a.metric = b.metric AND a.outcome = 'correct' AND b.outcome = 'incorrect' WHERE b.n >= 3 AND a.std > 0 AND abs(b.mean - a.mean) > a.std")
def notable_differences(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.notable(_quality(spark, d)), "mean_correct", "mean_incorrect", "std_correct")


_PAIR = ", v AS (SELECT filename, max(predicted_class) FILTER (model_version = 'v3_full') AS p, max(predicted_class) FILTER (model_version = 'v3_balanced') AS q, max(actual_class) AS a FROM pred WHERE model_version IN ('v3_full', 'v3_balanced') GROUP BY filename)"


@query(W_PRED + _PAIR + " SELECT filename, p AS before, q AS after, CASE WHEN a IS NULL THEN 'not scored' WHEN q = a THEN 'fixed' WHEN p = a THEN 'broken' ELSE 'still wrong' END AS change FROM v WHERE p <> q")
def model_changes(spark: SparkSession, d: str) -> DataFrame:
    return compare.model_changes(predictions(spark, d, "filename"), "filename", "v3_full", "v3_balanced")


VERSIONS = ["v2", "v3_balanced", "v3_full"]


@query(W_PRED + " SELECT filename, " + ", ".join(f"max(predicted_class) FILTER (model_version = '{v}') AS {v}" for v in VERSIONS) + " FROM pred GROUP BY filename")
def version_cells(spark: SparkSession, d: str) -> DataFrame:
    return compare.version_cells(predictions(spark, d, "filename"), "filename", VERSIONS)


@query(W_PRED + ", m AS (SELECT model_version, actual_class AS class_name, avg((actual_class = predicted_class)::INT) AS recall FROM pred WHERE actual_class IS NOT NULL GROUP BY ALL) SELECT c.class_name, " + ", ".join(f"round(coalesce(max(recall) FILTER (model_version = '{v}'), 0.0), 10) AS {v}" for v in VERSIONS) + " FROM classes c LEFT JOIN m USING (class_name) GROUP BY c.class_name")
def model_side_by_side(spark: SparkSession, d: str) -> DataFrame:
    hit = (F.col("actual_class") == F.col("predicted_class")).cast("int")
    m = predictions(spark, d, "prediction_id").filter("actual_class is not null").groupBy(F.col("actual_class").alias("class_name")).agg(*(F.avg(F.when(F.col("model_version") == v, hit)).alias(v) for v in VERSIONS))
    x = classes(spark, d).select("class_name").join(m, "class_name", "left").na.fill(0.0)
    return rounded(x, *VERSIONS)


_DELTA = "WITH " + SQL_POOL + SQL_PRED[SQL_PRED.index(", pred AS") :] + """, v AS (SELECT image_id, max(predicted_class) FILTER (model_version = 'v2') AS p, max(predicted_class) FILTER (model_version = 'v3_full') AS q, max(actual_class) AS a FROM pred WHERE model_version IN ('v2', 'v3_full') GROUP BY image_id),
    k AS (SELECT v.*, width * height / 1e6 AS mp FROM v LEFT JOIN pool USING (image_id) WHERE p IS NOT NULL AND q IS NOT NULL AND a IS NOT NULL)"""


@query(_DELTA + " SELECT a AS actual_class, count(*) AS n, round(avg((p = a)::INT), 10) AS accuracy_before, round(avg((q = a)::INT), 10) AS accuracy_after, round(avg((q = a)::INT) - avg((p = a)::INT), 10) AS delta, count(*) FILTER (p <> q) AS changed, round(median(mp), 10) AS median_megapixels FROM k GROUP BY a")
def paired_delta_median(spark: SparkSession, d: str) -> DataFrame:
    sizes = pool(spark, d, "width", "height").select("image_id", S.megapixels(F.col("width"), F.col("height")).alias("megapixels"))
    x = compare.paired_deltas(predictions(spark, d, "image_id").join(sizes, "image_id", "left"), "image_id", "v2", "v3_full")
    return rounded(x, "accuracy_before", "accuracy_after", "delta", "median_megapixels")


@query(W_PRED + " SELECT actual_class, round(avg((predicted_class = actual_class)::INT) FILTER (NOT c), 10) AS accuracy_plain, round(avg((predicted_class = actual_class)::INT) FILTER (c), 10) AS accuracy_composite, round(avg((predicted_class = 'Healthy')::INT) FILTER (c), 10) AS called_background, round(avg(confidence) FILTER (c AND predicted_class <> actual_class), 10) AS confidence_wrong, round(avg((predicted_class = actual_class)::INT) FILTER (NOT c) - avg((predicted_class = actual_class)::INT) FILTER (c), 10) AS drop FROM (SELECT *, model_version = 'v2' AS c FROM pred) WHERE actual_class IS NOT NULL GROUP BY 1")
def background_robustness(spark: SparkSession, d: str) -> DataFrame:
    """One version's rows stand for the composites, whose backgrounds are of the class Healthy."""
    x = predictions(spark, d, "prediction_id").withColumn("composite", F.col("model_version") == "v2").withColumn("background_class", F.lit("Healthy"))
    return rounded(compare.background_robustness(x), "accuracy_plain", "accuracy_composite", "called_background", "confidence_wrong", "drop")


_PROFILES = W_PRED + ", prof AS (SELECT actual_class AS class_name, " + ", ".join(f"avg({c}) AS m_{c}" for c in P_COLUMNS[:6]) + " FROM pred WHERE actual_class IS NOT NULL GROUP BY 1)"


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    x = predictions(spark, d).filter("actual_class is not null")
    return x.groupBy(F.col("actual_class").alias("class_name")).agg(*(F.avg(c).alias(c) for c in P_COLUMNS[:6]))


@query(_PROFILES + " SELECT class_name, " + ", ".join(f"round(m_{c}, 10) AS {c}" for c in P_COLUMNS[:6]) + " FROM prof")
def class_profile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_profiles(spark, d), *P_COLUMNS[:6])


@query(_PROFILES + ", n AS (SELECT prediction_id, class_name, sqrt(" + " + ".join(f"pow({c} - m_{c}, 2)" for c in P_COLUMNS[:6]) + ") AS distance FROM pred CROSS JOIN prof), r AS (SELECT *, row_number() OVER (PARTITION BY prediction_id ORDER BY distance, class_name) AS k FROM n) SELECT prediction_id, class_name, round(distance, 10) AS distance FROM r WHERE k = 1")
def nearest_profile(spark: SparkSession, d: str) -> DataFrame:
    x = compare.nearest_profile(predictions(spark, d), _profiles(spark, d), "prediction_id", P_COLUMNS[:6], "class_name")
    return rounded(x, "distance")


@query(W_PRED + ", s AS (SELECT model_version AS version, unnest([{'k': 'rows', 'v': count(*)::VARCHAR}, {'k': 'classes', 'v': count(DISTINCT predicted_class)::VARCHAR}, {'k': 'labels', 'v': '9'}]) AS e FROM pred GROUP BY 1), n AS (SELECT count(DISTINCT version) AS n FROM s) SELECT e.k AS setting, string_agg(version || '=' || e.v, ', ' ORDER BY version) AS values FROM s GROUP BY 1 HAVING count(DISTINCT e.v) > 1 OR count(e.v) < (SELECT n FROM n)")
def config_differences(spark: SparkSession, d: str) -> DataFrame:
    """Settings here are facts of each version's predictions."""
    x = predictions(spark, d, "prediction_id").groupBy(F.col("model_version").alias("version")).agg(F.count("*").cast("string").alias("rows"), F.count_distinct("predicted_class").cast("string").alias("classes"))
    entries = F.array(*(F.struct(F.lit(k).alias("setting"), v.alias("value")) for k, v in (("rows", F.col("rows")), ("classes", F.col("classes")), ("labels", F.lit("9")))))
    return compare.config_differences(x.select("version", F.explode(entries).alias("e")).select("version", "e.*"))


@query(W_PRED + ", t AS (SELECT actual_class, count(*) AS n FROM pred WHERE actual_class IS NOT NULL AND file LIKE 'train/%' GROUP BY 1 ORDER BY n DESC, actual_class LIMIT 1) SELECT t.actual_class AS majority, round(avg((p.actual_class = t.actual_class)::INT), 10) AS accuracy, round(1.0 / (SELECT count(*) FROM classes), 10) AS chance FROM pred p, t WHERE p.actual_class IS NOT NULL AND p.file LIKE 'test/%' GROUP BY 1")
def baseline_majority(spark: SparkSession, d: str) -> DataFrame:
    """The class most frequent in train, scored on test."""
    x = predictions(spark, d, "file").filter("actual_class is not null")
    top = x.filter("file like 'train/%'").groupBy("actual_class").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "actual_class").first()
    name = top["actual_class"] if top else None
    hit = (F.col("actual_class") == F.lit(name)).cast("int")
    return x.filter("file like 'test/%'").agg(F.lit(name).alias("majority"), F.round(F.avg(hit), 10).alias("accuracy"), F.lit(round(1.0 / classes(spark, d).count(), 10)).alias("chance"))


@query("WITH e AS (SELECT user_id % 5 AS run, CASE WHEN ts < (SELECT min(ts) + INTERVAL 7 DAY FROM events) THEN 1 ELSE 2 END AS phase, epoch_us(ts) AS epoch, value AS val_accuracy, 1 / (1 + abs(value)) AS val_loss, event_id FROM events) SELECT run, count(*) AS epochs, round(max(val_accuracy), 10) AS best_accuracy, round(min(val_loss), 10) AS best_loss FROM e GROUP BY run")
def history_merge(spark: SparkSession, d: str) -> DataFrame:
    """Training histories, played by the events of a user group in two phases."""
    from gleanery.operators.profile import merged_history

    x = table(spark, d, "events")
    start = x.agg(F.min("ts")).first()[0]
    x = x.select((F.col("user_id") % 5).alias("run"), F.when(F.col("ts") < F.lit(start) + F.expr("INTERVAL 7 DAYS"), 1).otherwise(2).alias("phase"), F.col("ts").alias("epoch"), F.col("value").alias("val_accuracy"), (1 / (1 + F.abs("value"))).alias("val_loss"))
    return rounded(merged_history(x).select("run", "epochs", "best_accuracy", "best_loss"), "best_accuracy", "best_loss")


@query("WITH " + SQL_POOL.split(", pool AS")[0] + ", " + SQL_MANIFEST + " SELECT file, actual_class, lighting, background, distance, angle, quality FROM man")
def condition_manifest(spark: SparkSession, d: str) -> DataFrame:
    return manifest(spark, d)


@query("WITH f AS (SELECT DISTINCT file FROM v3_external_fingerprints WHERE file IS NOT NULL), m AS (SELECT file, min(true_class) AS true_class FROM external_manifest WHERE file IS NOT NULL GROUP BY file) SELECT file, true_class, m.file IS NOT NULL AS listed FROM f LEFT JOIN m USING (file)")
def template_regeneration(spark: SparkSession, d: str) -> DataFrame:
    """A fresh template of the held-out files that keeps labels entered before."""
    from gleanery.sources.manifests import regenerate

    files = table(spark, d, "v3_external_fingerprints").select("file").filter("file is not null").distinct()
    return regenerate(files, table(spark, d, "external_manifest"), "file", ["true_class"])


@query("WITH f AS (SELECT DISTINCT file FROM v3_external_fingerprints) SELECT m.file, f.file IS NOT NULL AS present, count(*) AS n FROM external_manifest m LEFT JOIN f ON f.file = m.file GROUP BY ALL")
def held_out_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Manifest rows with whether their file is there."""
    files = table(spark, d, "v3_external_fingerprints").select("file").filter("file is not null").distinct().withColumn("there", F.lit(True))
    x = table(spark, d, "external_manifest").join(files, "file", "left")
    return x.groupBy("file", F.coalesce("there", F.lit(False)).alias("present")).agg(F.count("*").alias("n"))


@query(_TP.replace("FROM k GROUP BY 1)", "FROM k GROUP BY 1, 2)").replace("SELECT actual_class AS c,", "SELECT actual_class AS c, model_version AS v,").replace("SELECT predicted_class AS c,", "SELECT predicted_class AS c, model_version AS v,").replace("FROM classes LEFT JOIN a ON a.c = class_name LEFT JOIN b ON b.c = class_name)", "FROM (SELECT idx, class_name, v FROM classes, (SELECT DISTINCT model_version AS v FROM k)) q LEFT JOIN a ON a.c = class_name AND a.v = q.v LEFT JOIN b ON b.c = class_name AND b.v = q.v)").replace("m AS (SELECT idx,", "m AS (SELECT q.v AS model_version, idx,")
    + " SELECT class_name, " + ", ".join(f"round(coalesce(max({m}) FILTER (model_version = '{v}'), 0.0), 10) AS {v}_{m}" for v in VERSIONS for m in ("f1", "recall")) + " FROM f GROUP BY class_name")
def model_scores_side_by_side(spark: SparkSession, d: str) -> DataFrame:
    """F1 and recall of each class by version; 0 where a version lacks it."""
    x = cut(predictions(spark, d, "prediction_id").filter(F.col("model_version").isin(VERSIONS)))
    out = classes(spark, d).select("class_name")
    for v in VERSIONS:
        scores = metrics.per_class(x.filter(F.col("model_version") == v), classes(spark, d))
        out = out.join(scores.select("class_name", *(F.round(m, 10).alias(f"{v}_{m}") for m in ("f1", "recall"))), "class_name", "left")
    return out.na.fill(0.0)


@query(W_PRED + " SELECT model_version, actual_class, count(*) AS n, round(avg((actual_class = predicted_class)::INT), 10) AS accuracy, round(avg(confidence), 10) AS mean_confidence FROM pred WHERE actual_class IS NOT NULL GROUP BY 1, 2")
def scorecard_per_class(spark: SparkSession, d: str) -> DataFrame:
    """Only classes that a version was scored on."""
    return rounded(metrics.scorecard(predictions(spark, d, "prediction_id"), "model_version", "actual_class").select("model_version", "actual_class", "n", "accuracy", "mean_confidence"), "accuracy", "mean_confidence")


_FIRST = "WITH " + SQL_POOL + ", r AS (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY source_path, image_id) AS k FROM pool WHERE class_name IS NOT NULL)"


@query(_FIRST + " SELECT class_name, count(*) AS n, round(avg(width), 10) AS width, round(avg(height), 10) AS height FROM r WHERE k <= 150 GROUP BY class_name")
def first_files_profile(spark: SparkSession, d: str) -> DataFrame:
    """The profile of a class from its first 150 files by path, which is the operator's rule."""
    x = pool(spark, d, "class_name", "source_path", "width", "height").filter("class_name is not null")
    return rounded(compare.class_profiles(x, "class_name", ["source_path", "image_id"], ["width", "height"], 150), "width", "height")


@query(_PROFILES + ", n AS (SELECT prediction_id, predicted_class, class_name, sqrt(" + " + ".join(f"pow({c} - m_{c}, 2)" for c in P_COLUMNS[:6]) + ") AS distance FROM pred CROSS JOIN prof), r AS (SELECT *, row_number() OVER (PARTITION BY prediction_id ORDER BY distance, class_name) AS k FROM n) SELECT predicted_class, class_name, class_name = predicted_class AS warn, count(*) AS n FROM r WHERE k = 1 GROUP BY ALL")
def profile_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Whether the nearest profile is the predicted class: the picture then only looks like the class as a whole."""
    x = predictions(spark, d)
    near = compare.nearest_profile(x, _profiles(spark, d), "prediction_id", P_COLUMNS[:6], "class_name").join(x.select("prediction_id", "predicted_class"), "prediction_id")
    return near.groupBy("predicted_class", "class_name", (F.col("class_name") == F.col("predicted_class")).alias("warn")).agg(F.count("*").alias("n"))


@query("WITH " + SQL_POOL + ", s AS (SELECT class_name, count(*) AS n, count(width) AS k FROM pool GROUP BY class_name) SELECT class_name, round_even(100 * k / n, 1) AS percent, round_even(n / 1000, 2) AS thousands FROM s")
def reported_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of reports, rounded half to even."""
    s = pool(spark, d, "class_name", "width").groupBy("class_name").agg(F.count("*").alias("n"), F.count("width").alias("k"))
    return s.select("class_name", S.reported(100 * F.col("k") / F.col("n"), 1).alias("percent"), S.reported(F.col("n") / 1000, 2).alias("thousands"))
