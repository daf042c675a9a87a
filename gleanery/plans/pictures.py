"""Pixel operators over pictures whose pixels are the held-out files' own hashes, so that SQL can tell
every value: 64 by 64, the left half in the colour of the first six digits, the right in that of the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.scalars import hamming
from gleanery.operators import pixels
from gleanery.plans.registry import query
from gleanery.plans.tables import SQL_HELD, held_out

_PIXEL = "concat(substring(phash, {0} + 4, 2), substring(phash, {0} + 2, 2), substring(phash, {0}, 2))"


def pictures(spark: SparkSession, d: str) -> DataFrame:
    """(path, class_name, split, phash_of, width, height, channels, data) of each distinct file and hash; no hash, no pixels."""
    x = held_out(spark, d).filter("file is not null").select("file", "phash").distinct()
    data = F.expr(f"unhex(repeat(concat(repeat({_PIXEL.format(1)}, 32), repeat({_PIXEL.format(7)}, 32)), 64))")
    return x.select(
        F.concat("file", F.lit("/"), F.coalesce(F.substring("phash", 1, 12), F.lit("none")), F.lit(".bmp")).alias("path"),
        F.lit("Healthy").alias("class_name"), F.lit("train").alias("split"), F.lit(64).alias("width"), F.lit(64).alias("height"), F.lit(3).alias("channels"), data.alias("data"),
    )


_CHANNELS = {c: (f"('0x' || substr(phash, {1 + 2 * k}, 2))::INT", f"('0x' || substr(phash, {7 + 2 * k}, 2))::INT") for k, c in enumerate("rgb")}
_SQL = (
    "WITH " + SQL_HELD + ", p AS (SELECT DISTINCT file || '/' || coalesce(substr(phash, 1, 12), 'none') || '.bmp' AS path, phash FROM held WHERE file IS NOT NULL), c AS (SELECT path, "
    + ", ".join(f"{side} AS {name}{c}" for c, sides in _CHANNELS.items() for name, side in zip("lr", sides))
    + " FROM p), q AS (SELECT *, greatest(lr, lg, lb) AS lt, greatest(rr, rg, rb) AS rt, (lr + lg + lb) / 3 AS lm, (rr + rg + rb) / 3 AS rm, CASE WHEN greatest(lr, lg, lb) > 0 THEN 1 - least(lr, lg, lb) / greatest(lr, lg, lb) WHEN lr = 0 THEN 0 END AS ls, CASE WHEN greatest(rr, rg, rb) > 0 THEN 1 - least(rr, rg, rb) / greatest(rr, rg, rb) WHEN rr = 0 THEN 0 END AS rs FROM c)"
)
_SHARE = "((NOT (lt / 255 > 0.7 AND ls < 0.35))::INT + (NOT (rt / 255 > 0.7 AND rs < 0.35))::INT) / 2"


def _rounded(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select("path", *(F.round(n, 9).alias(n) for n in names))


@query(_SQL + " SELECT path, round((lm + rm) / 510, 9) AS mean_brightness, round(abs(lm - rm) / 510, 9) AS brightness_std, round(pow((lm - rm) / 255, 2) / 31, 9) AS sharpness, round((ls + rs) / 2, 9) AS mean_saturation FROM q")
def pixel_quality(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(pixels.with_quality(pictures(spark, d)), ["mean_brightness", "brightness_std", "sharpness", "mean_saturation"])


@query(_SQL + " SELECT path, round((lr + rr) / 510, 9) AS mean_red, round((lg + rg) / 510, 9) AS mean_green, round((lb + rb) / 510, 9) AS mean_blue, round((lt + rt) / 510, 9) AS brightness, round((ls + rs) / 2, 9) AS saturation, round((lm + rm) / 510, 9) AS border_brightness FROM q")
def pixel_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(pixels.with_statistics(pictures(spark, d)), pixels.STATISTICS)


@query(_SQL + " SELECT path, " + ", ".join(f"round((l{c} + r{c}) / 510, 9) AS f{k}, round(abs(l{c} - r{c}) / 510, 9) AS f{k + 3}" for k, c in enumerate("rgb")) + ", round((lm + rm) / 510, 9) AS f6 FROM q")
def pixel_features(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(pixels.with_features(pictures(spark, d), 64), [f"f{k}" for k in range(7)])


@query(_SQL + f" SELECT path, round({_SHARE}, 9) AS foreground_share FROM q")
def pixel_foreground(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(pixels.with_foreground_share(pictures(spark, d)), ["foreground_share"])


@query("WITH " + SQL_HELD + ", p AS (SELECT DISTINCT file || '/' || coalesce(substr(phash, 1, 12), 'none') || '.bmp' AS path, phash FROM held WHERE file IS NOT NULL), s AS (SELECT path, phash, unnest([48, 64, 96]) AS edge FROM p) SELECT path, edge, CASE WHEN phash IS NOT NULL THEN least(edge, 64)::INT END AS shrunk, CASE WHEN phash IS NOT NULL THEN edge::INT END AS resized, CASE WHEN phash IS NOT NULL THEN 3 * edge * edge END AS bytes FROM s")
def pixel_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Pictures resized to a square and downsampled to a long edge, never up."""
    x = None
    for edge in (48, 64, 96):
        small = pixels.shrunk(pictures(spark, d), edge).select("path", F.col("width").alias("shrunk"))
        square = pixels.resized(pictures(spark, d), edge).select("path", F.col("height").alias("resized"), F.length("data").alias("bytes"))
        y = small.join(square, "path").select("path", F.lit(edge).alias("edge"), "shrunk", "resized", F.col("bytes").cast("bigint").alias("bytes"))
        x = y if x is None else x.union(y)
    return x


@query("WITH " + SQL_HELD + " SELECT DISTINCT file, sha256, 64 AS digits, true AS same_when_enlarged FROM held WHERE file IS NOT NULL AND length(sha256) = 64")
def pixel_hash(spark: SparkSession, d: str) -> DataFrame:
    """Grey pictures of bytes drawn from a content hash: enlarging one leaves its perceptual hash near."""
    x = held_out(spark, d).filter("file is not null and length(sha256) = 64").select("file", "sha256").distinct()
    x = x.select("file", "sha256", F.lit(16).alias("width"), F.lit(16).alias("height"), F.lit(1).alias("channels"), F.expr("unhex(concat_ws('', transform(sequence(0, 7), i -> sha2(concat(sha256, i), 256))))").alias("data"))
    small = pixels.with_hash(x).withColumnRenamed("phash", "before").select("file", "sha256", "before", "width", "height", "channels", "data")
    both = pixels.with_hash(pixels.resized(small, 64))
    return both.select("file", "sha256", F.length("phash").alias("digits"), (hamming(F.col("before"), F.col("phash")) <= 16).alias("same_when_enlarged"))


@query(_SQL + f", s AS (SELECT path, unnest(generate_series(0, 1))::INT AS copy_index FROM q WHERE {_SHARE} >= 0.04) SELECT path AS original, copy_index, regexp_replace(path, '[^/]*$', '') || 'aug__' || copy_index || '__' || regexp_extract(path, '([^/]*)[.]bmp$', 1) || '.png' AS path, 64 AS width, 64 AS height FROM s")
def pixel_composites(spark: SparkSession, d: str) -> DataFrame:
    """Two composites of each picture with a subject, before patches of the others."""
    x = pictures(spark, d)
    made = pixels.augmented(x, 2, patches=pixels.harvested(x))
    return made.select("original", "copy_index", "path", "width", "height")


@query("WITH " + SQL_HELD + ", p AS (SELECT DISTINCT file || '/' || coalesce(substr(phash, 1, 12), 'none') || '.bmp' AS path, phash FROM held WHERE file IS NOT NULL) SELECT path, unnest(generate_series(0, 3))::INT AS patch, 21 AS width, 21 AS height FROM p WHERE phash IS NOT NULL")
def pixel_patches(spark: SparkSession, d: str) -> DataFrame:
    return pixels.harvested(pictures(spark, d)).select("path", "patch", "width", "height")
