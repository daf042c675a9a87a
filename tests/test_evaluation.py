"""Metrics on a few rows counted by hand, and every query against its SQL."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gleanery.operators import compare, metrics, profile
from gleanery.plans import catalogue
from gleanery.operators.learning import as_vector, fit, predict
from gleanery.streaming import curation

DATA = "/root/testdata/sf0.001"
there = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def classes(spark):
    return spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "idx int, class_name string")


@pytest.fixture(scope="module")
def scored(spark):
    rows = [("a", "a", 0.9), ("a", "b", 0.8), ("b", "b", 0.7), ("b", "b", 0.5), (None, "a", 0.4), ("b", "a", 0.6)]
    return spark.createDataFrame(rows, "actual_class string, predicted_class string, confidence double").withColumn("low_confidence", F.col("confidence") < 0.6)


def test_metrics_by_hand(scored, classes):
    m = {r["class_name"]: r for r in metrics.per_class(scored, classes).collect()}
    assert (m["a"]["support"], m["a"]["precision"], m["a"]["recall"]) == (2, 0.5, 0.5)
    assert (m["b"]["support"], m["b"]["n_predicted"], m["b"]["true_positives"]) == (3, 3, 2)
    assert (m["c"]["support"], m["c"]["f1"], m["c"]["accuracy"], m["c"]["mean_confidence"]) == (0, 0.0, None, None)
    o = metrics.overall(scored, classes).first()
    assert o["n"] == 5 and math.isclose(o["accuracy"], 0.6) and math.isclose(o["macro_recall"], (0.5 + 2 / 3) / 3)
    matrix = metrics.confusion(scored, classes)
    assert matrix.count() == 9
    assert [tuple(r)[:3] for r in metrics.confused_pairs(matrix).collect()] == [("a", "b", 1), ("b", "a", 1)]
    t = {r["threshold"]: r for r in metrics.thresholds(scored, [0.7, 0.99]).collect()}
    assert t[0.7]["n_above"] == 3 and t[0.99]["accuracy_above"] is None
    e = {r["actual_class"]: r for r in metrics.errors_per_class(scored, classes).collect()}
    assert (e["b"]["errors"], e["b"]["most_common_wrong"], e["c"]["error_rate"]) == (1, "a", None)
    assert {r["band"]: r["n"] for r in metrics.bands(scored.withColumn("confidence", F.lit(1.0)), 5).collect()} == {4: 6}
    assert {r["status"]: r["n"] for r in metrics.row_status(scored).collect()} == {"labelled": 5, "unlabelled": 1}


def test_metrics_without_rows(scored, classes):
    none = scored.limit(0)
    assert {r["support"] for r in metrics.per_class(none, classes).collect()} == {0}
    assert metrics.overall(none, classes).first()["accuracy"] is None
    assert metrics.mean_confidences(none).first()["mean_all"] is None
    assert {r["share"] for r in metrics.confusion(none, classes).collect()} == {0.0}


def test_weights(spark):
    counts = spark.createDataFrame([("a", 1786), ("b", 335), ("c", 1855), ("d", 1263)], "class_name string, n long")
    got = {r["class_name"]: round(r["weight"], 3) for r in metrics.class_weights(counts).collect()}
    assert got == {"a": 0.459, "b": 2.449, "c": 0.442, "d": 0.65}


def test_imbalance(spark):
    counts = lambda *n: spark.createDataFrame([(str(k), x) for k, x in enumerate(n)], "class_name string, n long")
    assert tuple(profile.imbalance(counts(40, 4, 0), 3.0).first()) == (2, 10.0, True)
    assert tuple(profile.imbalance(counts(40), 3.0).first()) == (1, None, False)
    assert [r[0] for r in profile.too_few(counts(40, 4, 0), 10).collect()] == ["1"]


def test_changes_and_settings(spark):
    rows = spark.createDataFrame([("f1", "v1", "a", "b"), ("f1", "v2", "a", "a"), ("f2", "v1", "a", "a"), ("f2", "v2", "a", "b"), ("f3", "v1", None, "a"), ("f3", "v2", None, "b"), ("f4", "v1", "c", "a"), ("f4", "v2", "c", "b"), ("f5", "v1", "a", "a"), ("f5", "v2", "a", "a"), ("f6", "v1", "a", "a")], "f string, model_version string, actual_class string, predicted_class string")
    assert {r["f"]: r["change"] for r in compare.model_changes(rows, "f", "v1", "v2").collect()} == {"f1": "fixed", "f2": "broken", "f3": "not scored", "f4": "still wrong"}
    assert {r["f"]: (r["v1"], r["v2"]) for r in compare.version_cells(rows, "f", ["v1", "v2"]).collect()}["f6"] == ("a", None)
    s = spark.createDataFrame([("v1", "lr", "1"), ("v2", "lr", "2"), ("v1", "seed", "7"), ("v2", "seed", "7"), ("v1", "new", None), ("v2", "new", "x"), ("v1", "nil", None), ("v2", "nil", None)], "version string, setting string, value string")
    assert {r["setting"] for r in compare.config_differences(s).collect()} == {"lr", "new"}


def test_history(spark):
    rows = [("r", 1, 1, 0.5, 2.0), ("r", 1, 2, 0.9, 1.0), ("r", 2, 1, 0.8, 1.5)]
    r = profile.merged_history(spark.createDataFrame(rows, "run string, phase int, epoch int, val_accuracy double, val_loss double")).first()
    assert (r["epochs"], r["best_accuracy"], r["best_loss"], r["last_accuracy"], r["last_loss"]) == (3, 0.9, 1.0, 0.8, 1.5)


def test_learning(spark):
    rows = [(float(k % 2), float(k % 2) * 3 + (k % 7) / 10, float(k % 5)) for k in range(200)]
    x = as_vector(spark.createDataFrame(rows, "label double, f0 double, f1 double"), ["f0", "f1"])
    for kind in ("lr", "rf"):
        model = fit(x, kind, trees=5)
        out = predict(model, x, ["no", "yes"])
        assert out.filter((F.col("predicted_class") == "yes") == (F.col("label") == 1)).count() == 200
        assert abs(sum(out.first()["p"]) - 1) < 1e-9
        with pytest.raises(ValueError, match="classes"):
            predict(model, x, ["a", "b", "c"])


def test_streams(spark, tmp_path):
    day = lambda n: f"2026-01-{n:02d} 00:00:00"
    rows = [(1, "s1", day(1)), (2, "s1", day(2)), (3, "s2", day(3)), (4, "s3", day(20)), (5, "s4", day(25))]
    df = spark.createDataFrame(rows, "id long, sha256 string, at string").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = lambda: curation.read_stream(spark, str(tmp_path / "in"), df.schema)
    held = spark.createDataFrame([("f", "s2"), ("g", None)], "file string, sha256 string")
    out = curation.without_held_out(curation.first_arrivals(stream(), ["sha256"], "at"), held, "sha256")
    curation.run_once(out, str(tmp_path / "o1"), str(tmp_path / "c1"))
    got = {r["sha256"] for r in spark.read.parquet(str(tmp_path / "o1")).collect()}
    assert got == {"s1", "s3", "s4"}
    curation.run_once(curation.windowed_counts(stream(), "at", ["sha256"]), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "o2")).count() == 4
    curation.run_once(curation.sessions(stream(), "at", "sha256"), str(tmp_path / "o3"), str(tmp_path / "c3"))
    assert spark.read.parquet(str(tmp_path / "o3")).count() >= 4


def rows_of(df):
    df = df[sorted(df.columns)]
    text = lambda v: "null" if not isinstance(v, (list, dict)) and not hasattr(v, "__len__") and pd.isna(v) else f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted("|".join(text(v) for v in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


@there
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@there
@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, DATA).count() >= 0


@there
def test_entry(spark):
    assert entry.entry(spark).count() > 0
