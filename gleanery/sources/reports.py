"""Reports: small results as JSON, Markdown and sentences; model versions from their files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

MAX_ROWS = 10_000


def small_rows(df: DataFrame, most: int = MAX_ROWS) -> list[Row]:
    """The rows of a report; refuses results that are no report."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write a table, not a report")
    return rows


def write_json(df: DataFrame, path: str) -> None:
    rows = [r.asDict(recursive=True) for r in small_rows(df)]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(rows, indent=2, default=str, ensure_ascii=False) + "\n")


def markdown_table(df: DataFrame, digits: int = 4) -> str:
    show = lambda v: "n/a" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(show, r)) + " |" for r in small_rows(df))]) + "\n"


def prediction_sentence(row: Row) -> str:
    """One prediction for people: predicted_class, confidence, reasons (may be empty)."""
    text = f"{row['predicted_class']} ({row['confidence']:.1%} confidence)"
    return text + (f"; uncertain: {', '.join(row['reasons'])}" if row["reasons"] else "")


ARTEFACTS = ["model", "labels", "config", "metrics", "history"]


def read_versions(spark: SparkSession, root: str) -> DataFrame:
    """(version, setting, value, has_<artefact>): flattened config.json of each version folder with what else it has."""
    schema = T.StructType([T.StructField("version", T.StringType()), T.StructField("setting", T.StringType()), T.StructField("value", T.StringType()), *(T.StructField(f"has_{a}", T.BooleanType()) for a in ARTEFACTS)])

    def flat(prefix: str, x) -> list[tuple[str, str | None]]:
        if isinstance(x, dict):
            return [p for k, v in sorted(x.items()) for p in flat(f"{prefix}.{k}" if prefix else k, v)]
        return [(prefix, None if x is None else json.dumps(x, ensure_ascii=False))]

    rows = []
    for folder in sorted(p for p in Path(root).iterdir() if p.is_dir()):
        has = [any(folder.glob(f"{a}.*")) for a in ARTEFACTS]
        config = folder / "config.json"
        settings = flat("", json.loads(config.read_text())) if config.exists() else [(None, None)]
        rows += [(folder.name, k, v, *has) for k, v in settings]
    return spark.createDataFrame(rows, schema)
