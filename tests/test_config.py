import json

import pytest

from gleanery import config
from gleanery.config import ClassSpec, CurationConfig
from gleanery.operators.compare import config_differences
from gleanery.sources import reports


def test_layers():
    base = {"a": {"x": 1, "y": [1, 2]}, "b": 1}
    assert config.merged(base, {"a": {"y": [3]}, "c": {"d": 2}}) == {"a": {"x": 1, "y": [3]}, "b": 1, "c": {"d": 2}}
    assert base == {"a": {"x": 1, "y": [1, 2]}, "b": 1}


def test_load(tmp_path):
    (tmp_path / "a.json").write_text('{"a": {"x": 1}}')
    (tmp_path / "b.json").write_text('{"a": {"y": 2}}')
    assert config.load(str(tmp_path / "a.json"), str(tmp_path / "b.json"), overrides={"a": {"x": 5}}) == {"a": {"x": 5, "y": 2}}


def test_settings(spark):
    two = (ClassSpec("b", "B", ("bee",)), ClassSpec("a", "A"))
    c = CurationConfig(two, split={"train": 3, "test": 1})
    assert c.shares == {"train": 0.75, "test": 0.25}
    assert [(r["idx"], r["class_name"]) for r in c.class_table(spark).orderBy("idx").collect()] == [(0, "b"), (1, "a")]
    for bad in ({"image_size": 31}, {"batch_size": 0}, {"split": {}}, {"split": {"a": -1, "b": 2}}):
        with pytest.raises(ValueError):
            CurationConfig(two, **bad)
    for same in ((ClassSpec("a", "A"), ClassSpec("a", "B")), (ClassSpec("a", "A"), ClassSpec("b", "A"))):
        with pytest.raises(ValueError):
            CurationConfig(same)


def test_plans():
    ok = {"classes": ["a"], "background_sources": ["harvested", "procedural"], "harvest_from": "b"}
    assert config.augmentation_problems(ok, ["a", "b"], ["harvested", "procedural"]) == []
    assert len(config.augmentation_problems(ok | {"classes": ["x", "b"], "background_sources": ["y"]}, ["a", "b"], ["harvested"])) == 3
    assert config.augmentation_problems(ok | {"harvest_from": None}, ["a", "b"], ["harvested", "procedural"]) == ["no class to harvest from"]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 0.5, None), ("c", None, 2)], "n string, x double, k int")
    assert reports.markdown_table(df) == "| n | x | k |\n| --- | --- | --- |\n| a\\|b | 0.5000 | n/a |\n| c | n/a | 2 |\n"
    reports.write_json(df, str(tmp_path / "r/x.json"))
    assert json.loads((tmp_path / "r/x.json").read_text())[1] == {"n": "c", "x": None, "k": 2}
    with pytest.raises(ValueError):
        reports.small_rows(spark.range(5), 4)
    row = spark.createDataFrame([("Healthy", 0.5, ["thin_margin"])], "predicted_class string, confidence double, reasons array<string>").first()
    assert reports.prediction_sentence(row) == "Healthy (50.0% confidence); uncertain: thin_margin"


def test_versions(spark, tmp_path):
    for v, c in (("v1", {"model": {"lr": 0.1, "seed": 7}}), ("v2", {"model": {"lr": 0.2, "seed": 7}}), ("v3", None)):
        (tmp_path / v).mkdir()
        if c:
            (tmp_path / v / "config.json").write_text(json.dumps(c))
    (tmp_path / "v1/model.bin").write_bytes(b"x")
    got = reports.read_versions(spark, str(tmp_path))
    assert {(r["version"], r["has_model"], r["has_config"]) for r in got.collect()} == {("v1", True, True), ("v2", False, True), ("v3", False, False)}
    settings = got.filter("setting is not null").select("version", "setting", "value")
    assert [tuple(r) for r in config_differences(settings).collect()] == [("model.lr", "v1=0.1, v2=0.2")]
