"""The test tables in canonical form: one row an image or prediction, names resolved, hex notations undone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.names import alias_table, hex_value, resolve
from gleanery.runtime import table

# Class names, columns and splits of the tables.
LABELS = ["Healthy", "Yellow Rust", "Brown Rust", "Powdery Mildew", "Septoria Blotch", "Tan Spot", "Loose Smut", "Stem Rust", "Black Chaff"]
P_COLUMNS = ["p_" + x.lower().replace(" ", "_") for x in LABELS]
SPLITS = ["train", "validation", "test"]
POOL_COLUMNS = ["image_id", "staged_name", "class_name", "source", "family", "source_path", "sha256", "original_sha256", "converted", "phash", "width", "height", "group_id", "split", "in_balanced"]


def classes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "classes").select("idx", "class_name")


def pool(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Accepted images, deliveries of one image combined. Only `columns` (all if none) are read."""
    wanted = ["image_id", *(c for c in columns or POOL_COLUMNS if c != "image_id")]
    x = table(spark, d, "pool_images").select(*wanted).distinct()
    x = x.withColumns({c: hex_value(F.col(c)) for c in ("sha256", "original_sha256", "phash") if c in wanted})
    if "class_name" in wanted:
        x = resolve(x.withColumnRenamed("class_name", "raw_class"), "raw_class", alias_table(table(spark, d, "classes"), "class_name", order="idx"), "class_name")
    if "split" in wanted:
        x = resolve(x.withColumnRenamed("split", "raw_split"), "raw_split", alias_table(table(spark, d, "split_targets"), "split_name"), "split")
    return x.select(*wanted)


def held_out(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "v3_external_fingerprints").select("file", hex_value(F.col("sha256")).alias("sha256"), hex_value(F.col("phash")).alias("phash"))
    return x.distinct()


SCORED = ["prediction_id", "model_version", "actual_class", "predicted_class", "confidence", "low_confidence"]


def predictions(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Predictions without repeats, classes resolved; with ``p``, all probabilities, if no columns are named."""
    x = table(spark, d, "predictions")
    x = (x.select(*dict.fromkeys([*SCORED, *columns])) if columns else x).distinct()
    names = alias_table(table(spark, d, "classes"), "class_name", order="idx")
    x = resolve(x.withColumnRenamed("actual_class", "raw_actual"), "raw_actual", names, "actual_class")
    x = resolve(x.withColumnRenamed("predicted_class", "raw_predicted"), "raw_predicted", names, "predicted_class")
    x = x.drop("raw_actual", "raw_predicted")
    return x if columns else x.withColumn("p", F.array(*P_COLUMNS))


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """Held-out conditions: blanks as 'unspecified', lower case, unknown classes null."""
    x = table(spark, d, "external_manifest")
    conditions = {c: F.coalesce(F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit("unspecified")) for c in ("lighting", "background", "distance", "angle", "quality")}
    x = resolve(x.withColumns(conditions), "true_class", alias_table(table(spark, d, "classes"), "class_name", order="idx"), "actual_class")
    return x.select("file", "actual_class", *conditions)


_NORM = "nullif(translate(lower(trim({0})), ' -', '__'), '')"
_HEX = "nullif(regexp_replace(regexp_replace(lower({0}), '[\\s:-]+', '', 'g'), '^0x', ''), '')"
_ALIAS = "{n} AS (SELECT k, arg_min(canonical, ({o}, canonical)) AS canonical FROM (SELECT {c} AS canonical, {o}, " + _NORM.format("a") + " AS k FROM (SELECT {c}, {o}, unnest(list_append(aliases, {c})) AS a FROM {t})) WHERE k IS NOT NULL GROUP BY k)"

SQL_ALIASES = _ALIAS.format(n="calias", c="class_name", t="classes", o="idx") + ", " + _ALIAS.format(n="salias", c="split_name", t="(SELECT *, split_name AS name FROM split_targets)", o="name")
SQL_POOL = (
    SQL_ALIASES
    + ", pool AS (SELECT q.image_id, q.staged_name, c.canonical AS class_name, q.source, q.family, q.source_path, "
    + ", ".join(_HEX.format("q." + c) + f" AS {c}" for c in ("sha256", "original_sha256", "phash"))
    + ", q.converted, q.width, q.height, q.group_id, s.canonical AS split, q.in_balanced FROM (SELECT DISTINCT "
    + ", ".join(POOL_COLUMNS)
    + " FROM pool_images) q LEFT JOIN calias c ON c.k = "
    + _NORM.format("q.class_name")
    + " LEFT JOIN salias s ON s.k = "
    + _NORM.format("q.split")
    + ")"
)
SQL_HELD = "held AS (SELECT DISTINCT file, " + _HEX.format("sha256") + " AS sha256, " + _HEX.format("phash") + " AS phash FROM v3_external_fingerprints)"
SQL_PRED = (
    SQL_ALIASES
    + ", pred AS (SELECT q.* EXCLUDE (actual_class, predicted_class), a.canonical AS actual_class, b.canonical AS predicted_class FROM (SELECT DISTINCT * FROM predictions) q LEFT JOIN calias a ON a.k = "
    + _NORM.format("q.actual_class")
    + " LEFT JOIN calias b ON b.k = "
    + _NORM.format("q.predicted_class")
    + ")"
)
SQL_MANIFEST = (
    "man AS (SELECT file, a.canonical AS actual_class, "
    + ", ".join(f"coalesce(nullif(lower(trim({c})), ''), 'unspecified') AS {c}" for c in ("lighting", "background", "distance", "angle", "quality"))
    + " FROM external_manifest LEFT JOIN calias a ON a.k = "
    + _NORM.format("true_class")
    + ")"
)


#: Hashes in the tables have at most so many words.
WORDS = 4


def sql_words(column: str) -> list[str]:
    """The 64-bit words of a hash, as unsigned numbers; filled with zeros."""
    return [f"('0x' || rpad(substr({column}, {16 * k + 1}, 16), 16, '0'))::UBIGINT" for k in range(WORDS)]


def sql_apart(a: str, b: str) -> str:
    return " + ".join(f"bit_count(xor({x}, {y}))::INT" for x, y in zip([f"{a}{k}" for k in range(WORDS)], [f"{b}{k}" for k in range(WORDS)], strict=True))


def sql_near(a: str, b: str) -> str:
    """Whether two rows with words h0 to h3 have hashes of equal length at most 5 bits apart."""
    return f"length({a}.phash) = length({b}.phash) AND {sql_apart(a + '.h', b + '.h')} <= 5"


SQL_WORDS = ", w AS (SELECT *, " + ", ".join(f"{w} AS h{k}" for k, w in enumerate(sql_words("phash"))) + " FROM pool WHERE phash IS NOT NULL)"
