"""Queries that train, stream or fan out. SQL tells what a trained model is scored on, and its bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.names import hex_value
from gleanery.operators import metrics
from gleanery.operators.pixels import fan_out, with_features
from gleanery.plans.registry import query
from gleanery.plans.tables import _HEX, LABELS, SQL_HELD, SQL_POOL, classes, held_out, pool
from gleanery.runtime import cut, scratch, table


def _baseline(spark: SparkSession, d: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(class_name, support, recall) and (n, accuracy, macro_f1) on the test images of a model that sees
    nothing but seven trivial features of the pictures, trained on the train images with class weights.

    The pool has no pixels; its pictures here are 8 by 8 in two colours of the perceptual hash.
    """
    from gleanery.operators.learning import as_vector, fit, predict

    side = lambda k: f"concat(substring(phash, {k} + 4, 2), substring(phash, {k} + 2, 2), substring(phash, {k}, 2))"
    x = pool(spark, d, "class_name", "split", "phash").filter("class_name is not null and phash is not null and length(phash) >= 12")
    x = x.withColumns({"width": F.lit(8), "height": F.lit(8), "channels": F.lit(3), "data": F.expr(f"unhex(repeat(concat(repeat({side(1)}, 4), repeat({side(7)}, 4)), 8))")})
    names = [f"f{k}" for k in range(7)]
    order = classes(spark, d).select("idx", "class_name")
    x = cut(with_features(x, 8).join(order, "class_name").withColumn("label", F.col("idx").cast("double")).select("image_id", "class_name", "split", "label", *names))
    counts = x.filter("split = 'train'").groupBy("class_name").agg(F.count("*").alias("n"))
    weights = metrics.class_weights(counts).select("class_name", "weight")
    x = as_vector(x, names)
    model = fit(x.filter("split = 'train'").join(weights, "class_name"), kind, "weight")
    labels = LABELS[: model.stages[-1].numClasses]
    scored = cut(predict(model, x.filter("split = 'test'"), labels).select(F.col("class_name").alias("actual_class"), "predicted_class", "confidence"))
    per_class = metrics.per_class(scored, classes(spark, d)).select("class_name", "support", "recall")
    return per_class, metrics.overall(scored, classes(spark, d)).select("n", "accuracy", "macro_f1")


_TESTED = "WITH " + SQL_POOL + ", t AS (SELECT * FROM pool WHERE class_name IS NOT NULL AND length(phash) >= 12 AND split = 'test')"


def _bounded(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """Trivial features tell nothing of these classes: accuracy and macro F1 stay far below a half."""
    _, overall = _baseline(spark, d, kind)
    return overall.select(F.lit(kind).alias("model"), "n", ((F.col("accuracy") > 0) & (F.col("accuracy") < 0.5) & (F.col("macro_f1") < 0.4)).alias("no_better_than_chance"))


@query(_TESTED + " SELECT 'lr' AS model, count(*) AS n, true AS no_better_than_chance FROM t")
def baseline_lr(spark: SparkSession, d: str) -> DataFrame:
    return _bounded(spark, d, "lr")


@query(_TESTED + " SELECT 'rf' AS model, count(*) AS n, true AS no_better_than_chance FROM t")
def baseline_rf(spark: SparkSession, d: str) -> DataFrame:
    return _bounded(spark, d, "rf")


@query(_TESTED + " SELECT c.class_name, count(t.image_id) AS support, true AS recall_known FROM classes c LEFT JOIN t USING (class_name) GROUP BY c.class_name")
def baseline_recall(spark: SparkSession, d: str) -> DataFrame:
    per_class, _ = _baseline(spark, d, "lr")
    return per_class.select("class_name", "support", F.col("recall").between(0.0, 1.0).alias("recall_known"))


@query("WITH " + SQL_POOL + """, c AS (SELECT source_path, unnest(generate_series(0, 2))::INT AS copy_index FROM pool WHERE split = 'train')
    SELECT source_path, copy_index, coalesce(regexp_extract(source_path, '^(.*/)?[^/]*$', 1), '') || 'aug__' || copy_index || '__' || regexp_extract(source_path, '([^/]*?)([.][^./]*)?$', 1) || '.png' AS augmented,
    ('0x' || substr(sha256(concat_ws('|', '42', source_path, copy_index::VARCHAR)), 1, 15))::BIGINT AS seed FROM c""")
def augment_fanout(spark: SparkSession, d: str) -> DataFrame:
    """Names and seeds of three copies of each train image."""
    x = pool(spark, d, "source_path", "split").filter("split = 'train'").select("source_path")
    return fan_out(x, "source_path", 3)


def _streamed(spark: SparkSession, d: str, name: str, build) -> DataFrame:
    """What a stream over a table's file wrote, after it took all there is."""
    from gleanery.streaming.curation import read_stream, run_once

    where = scratch(spark, "stream")
    schema = table(spark, d, name).schema
    run_once(build(read_stream(spark, f"{d}/{name}.parquet*", schema)), f"{where}/out", f"{where}/state")
    return spark.read.parquet(f"{where}/out")


_INTAKE_HASHES = f"SELECT DISTINCT {_HEX.format('sha256')} AS sha256 FROM intake_images"


@query("WITH " + SQL_HELD + f", h AS ({_INTAKE_HASHES}) SELECT sha256 FROM h WHERE sha256 IS NOT NULL AND sha256 NOT IN (SELECT sha256 FROM held WHERE sha256 IS NOT NULL)")
def streaming_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Intake rows as they arrive: each content once, none of the held-out ones."""
    from gleanery.streaming.curation import first_seen, read_stream, without_held_out

    where = scratch(spark, "stream")
    s = read_stream(spark, f"{d}/intake_images.parquet*", table(spark, d, "intake_images").schema)
    s = s.withColumn("sha256", hex_value(F.col("sha256"))).filter("sha256 is not null").select("intake_id", "sha256")
    first_seen(without_held_out(s, held_out(spark, d), "sha256"), ["sha256"], f"{where}/out", f"{where}/state", "intake_id")
    return spark.read.schema("sha256 string").option("recursiveFileLookup", "true").parquet(f"{where}/out")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e), g AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k)
    SELECT * FROM g WHERE session_end <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def streaming_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user, ended by six hours without an event, that the watermark has closed."""
    from gleanery.streaming.curation import sessions

    out = _streamed(spark, d, "events", lambda s: sessions(s.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id", "6 hours"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY ALL")
def streaming_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events of each day that the watermark has closed."""
    from gleanery.streaming.curation import windowed_counts

    return _streamed(spark, d, "events", lambda s: windowed_counts(s.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"])).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


