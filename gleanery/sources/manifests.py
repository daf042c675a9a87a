"""CSV and parquet manifests, ledgers, templates and staged variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Field orders of the files.
MANIFEST = ["staged_name", "class", "class_dir", "source", "family", "source_commit", "source_path", "sha256", "original_sha256", "converted", "phash", "width", "height", "group_id", "split", "in_balanced"]
LEDGER = ["class", "source", "family", "source_path", "sha256", "reason", "kept_instead", "detail"]
FINGERPRINTS = ["file", "sha256", "phash"]
CONDITIONS = ["lighting", "background", "distance", "angle", "quality"]
VARIANTS = ["pool", "full", "balanced"]


#: Values as they are: blanks stay, quotes are doubled.
CSV = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"', "multiLine": True}


def _strings(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as strings, by the declared schema."""
    return spark.read.schema(_strings(columns)).options(header=True, **CSV).csv(path)


def read_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """Held-out fingerprints; no file gives no rows, rows without content hash are dropped."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], _strings(FINGERPRINTS))
    return read_csv(spark, path, FINGERPRINTS).filter("sha256 is not null and sha256 <> ''")


def read_predictions(spark: SparkSession, path: str, classes: list[str]) -> DataFrame:
    """Predictions with their types; true, 1 and yes in any case are true."""
    fixed = ["file", "filename", "actual_class", "predicted_class", "confidence", "correct", "low_confidence"]
    p = [f"p_{c}" for c in classes]
    x = read_csv(spark, path, fixed + p)
    flag = lambda c: F.lower(F.trim(c)).isin("true", "1", "yes").alias(c)
    return x.select("file", "filename", "actual_class", "predicted_class", F.col("confidence").try_cast("double").alias("confidence"), flag("correct"), flag("low_confidence"), *(F.col(c).try_cast("double").alias(c) for c in p))


def read_conditions(spark: SparkSession, path: str, lower: bool = True) -> DataFrame:
    """A condition manifest: blank conditions as 'unspecified', in lower case if `lower`."""
    x = read_csv(spark, path, ["file", "actual_class", *CONDITIONS, "notes"])
    tidy = lambda c: F.coalesce(F.nullif((F.lower(F.trim(c)) if lower else F.trim(c)), F.lit("")), F.lit("unspecified"))
    return x.withColumns({c: tidy(c) for c in CONDITIONS}).withColumn("actual_class", F.nullif(F.trim("actual_class"), F.lit("")))


def write_sorted_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """Rows sorted over numbered files, each a range: read in the order of their names they are sorted."""
    df.orderBy(*order).write.mode("overwrite").options(header=True, **CSV).csv(path)


def write_rows_csv(df: DataFrame, path: str) -> None:
    """All rows as CSV files with headers, in no order: for tables of any size."""
    df.write.mode("overwrite").options(header=True, **CSV).csv(path)


def write_manifest(pool: DataFrame, path: str) -> None:
    write_sorted_csv(pool.select(*MANIFEST).withColumn("in_balanced", F.col("in_balanced").cast("string")), path, ["class", "source", "source_path"])


def write_ledger(removed: DataFrame, path: str) -> None:
    write_sorted_csv(removed.select(*LEDGER), path, ["reason", "class", "source", "source_path"])


def stage(pool: DataFrame, root: str) -> None:
    """The pool, the full and the balanced variant as tables partitioned by split and class; only these are replaced."""
    parts = {"pool": pool, "full": pool.filter("split is not null"), "balanced": pool.filter("split is not null and in_balanced")}
    for name in VARIANTS:
        parts[name].write.mode("overwrite").partitionBy("split", "class_dir").parquet(f"{root.rstrip('/')}/{name}")


def record_fingerprints(scanned: DataFrame) -> DataFrame:
    """File, content hash and perceptual hash of held-out files, and nothing that tells their label."""
    return scanned.select(*FINGERPRINTS)


def regenerate(files: DataFrame, prior: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """A template row for each file with the values entered before; of several the least."""
    old = prior.filter(F.col(key).isNotNull()).groupBy(key).agg(*(F.min(c).alias(c) for c in keep), F.lit(True).alias("listed"))
    return files.select(key).join(old, key, "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
