import math

import pytest
from pyspark.sql import functions as F

from gleanery.functions import scalars as S
from gleanery.functions.names import alias_table, hex_value, normalised, resolve


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [(" Brown-Rust ", "brown_rust"), ("\tA b\n", "a_b"), ("  ", None), ("", None), (None, None)])
def test_normalised(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "v string")
    assert df.select(normalised(F.col("v"))).first()[0] == want


@pytest.mark.parametrize(("raw", "want"), [("0xAB-cd:01 ", "abcd01"), (" 0X0a", "0a"), ("xyz", None), (" ", None), (None, None)])
def test_hex_value(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "v string")
    assert df.select(hex_value(F.col("v"))).first()[0] == want


def test_resolve_with_clashing_column(spark):
    names = spark.createDataFrame([("Healthy", ["ok", None]), ("Brown Rust", None)], "name string, aliases array<string>")
    df = spark.createDataFrame([("OK", "old"), ("brown-rust", "old"), ("x", "old"), (None, "old")], "raw string, to string")
    got = {r["raw"]: r["to"] for r in resolve(df, "raw", alias_table(names, "name"), "to").collect()}
    assert got == {"OK": "Healthy", "brown-rust": "Brown Rust", "x": None, None: None}


def test_hamming(spark):
    a, b = "f" * 64, "f" * 63 + "0"
    df = spark.createDataFrame([(a, b), (a, a), ("0" * 16, "8" + "0" * 15), (None, a)], "a string, b string")
    assert [r[0] for r in df.select(S.hamming(F.col("a"), F.col("b"))).collect()] == [4, 0, 1, None]
    with pytest.raises(Exception, match="different length"):
        spark.createDataFrame([("ff", "f")], "a string, b string").select(S.hamming(F.col("a"), F.col("b"))).collect()


@pytest.mark.parametrize(("path", "want"), [("a/.DS_Store", True), ("a/._b.jpg", True), ("__MACOSX/a.jpg", True), ("a/b.jpg", False)])
def test_metadata(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(S.is_metadata(F.col("p"))).first()[0] is want


def test_staged_name(spark):
    df = spark.createDataFrame([("src", "images/brown rust/leaf (1).JPG", None), ("src", "a/b.webp", "webp->png")], "s string, p string, c string")
    got = [r[0] for r in df.select(S.staged_name(F.col("s"), F.col("p"), F.col("c"))).collect()]
    assert got == ["src__images_brown-rust__leaf-1.jpg", "src__a__b.png"]


def test_percent_aspect_relative(spark):
    df = spark.createDataFrame([(0.1234, 4, 0, "/r/a/b"), (None, 4, 2, "/q/b")], "s double, w int, h int, p string")
    got = [tuple(r) for r in df.select(S.percent(F.col("s")), S.aspect(F.col("w"), F.col("h")), S.relative(F.col("p"), "/r")).collect()]
    assert got == [("12.3%", 0.0, "a/b"), ("n/a", 2.0, "/q/b")]


def test_true_format(spark):
    heads = [b"\xff\xd8\xff\xe0", b"\x89PNG\r\n\x1a\n", b"RIFF\x00\x00\x00\x00WEBPVP8 ", b"BMxx", b"GIF89a", b"text", b""]
    df = spark.createDataFrame([(bytearray(h),) for h in heads], "c binary")
    assert [r[0] for r in df.select(S.true_format(F.col("c"))).collect()] == ["JPEG", "PNG", "WEBP", "BMP", "GIF", None, None]


def test_prediction_flags(spark):
    uniform, sure = [0.25] * 4, [0.97, 0.01, 0.01, 0.01]
    df = spark.createDataFrame([(uniform,), (sure,), ([1.0],), ([0.5, 0.5],)], "p array<double>")
    p = F.col("p")
    rows = df.select(S.top_index(p).alias("t"), S.entropy(p).alias("e"), S.margin(p).alias("m"), S.uncertainty_reasons(p).alias("r"), S.uncertainty_reasons(p, enabled=False).alias("q"), S.ranked_distribution(p, ["a", "b", "c", "d"]).alias("d")).collect()
    assert rows[0]["r"] == ["high_entropy", "thin_margin", "low_confidence"] and rows[0]["q"] == ["low_confidence"]
    assert math.isclose(rows[0]["e"], 1.0) and rows[0]["t"] == 0 and rows[1]["r"] == []
    assert rows[2]["m"] == 1.0 and rows[2]["e"] == 0.0
    assert [x["class"] for x in rows[3]["d"]] == ["a", "b"]
