"""Sources and sinks over files that the queries write first: a tree of image folders made of the class
table, and tables written as the files of a build and read back."""

from __future__ import annotations

import struct
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.names import alias_table
from gleanery.functions.scalars import content_hash, file_name
from gleanery.operators import dedup, verify
from gleanery.plans.registry import query
from gleanery.plans.tables import LABELS, P_COLUMNS, SPLITS, SQL_HELD, SQL_POOL, held_out, pool
from gleanery.runtime import local_path, remove, scratch, table
from gleanery.sources import images, manifests

W_POOL = "WITH " + SQL_POOL


def _bitmap(width: int, height: int, shade: int) -> bytes:
    """A grey 24-bit BMP file."""
    row = bytes([shade, shade, shade]) * width + b"\0" * (-3 * width % 4)
    head = struct.pack("<2sIHHI", b"BM", 54 + len(row) * height, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(row) * height, 2835, 2835, 0, 0)
    return head + row * height


def _tree(spark: SparkSession, d: str) -> str:
    """Below s1 a folder for each class by its directory, with two images, below s2 one for every other
    class by its name, with one; bookkeeping, broken, empty, tiny and foreign files; an unknown folder."""
    root = scratch(spark, "tree")
    base = Path(local_path(root))
    for r in table(spark, d, "classes").select("idx", "class_name", "class_dir").limit(1000).collect():  # the class table is configuration
        first = base / "s1" / r["class_dir"]
        first.mkdir(parents=True)
        for k in range(2):
            (first / f"{k}.BMP").write_bytes(_bitmap(40, 36, 10 * r["idx"] + k))
        (first / ".DS_Store").write_bytes(b"x")
        (first / "note.txt").write_text(f"note {r['idx']}")
        if r["idx"] % 2 == 0:
            second = base / "s2" / r["class_name"]
            second.mkdir(parents=True)
            (second / "a.bmp").write_bytes(_bitmap(50, 33, 7 * r["idx"]))
    odd = base / "s1" / "nobody knows"
    odd.mkdir()
    (odd / "tiny.bmp").write_bytes(_bitmap(16, 40, 1))
    (odd / "empty.bmp").write_bytes(b"")
    (odd / "broken.bmp").write_bytes(_bitmap(40, 40, 2)[:200])
    (odd / "disguised.jpg").write_bytes(b"RIFF\x1a\0\0\0WEBPVP8 " + b"\0" * 20)
    return root


_FILES = """f AS (SELECT idx, class_name, 's1/' || class_dir || '/' || k || '.BMP' AS rel_path, class_dir AS folder, 's1' AS source FROM classes, (VALUES (0), (1)) v(k)
    UNION ALL SELECT idx, class_name, 's2/' || class_name || '/a.bmp', class_name, 's2' FROM classes WHERE idx % 2 = 0),
    odd AS (SELECT * FROM (VALUES ('tiny.bmp', 'too small', 'BMP'), ('empty.bmp', 'empty', NULL), ('broken.bmp', 'corrupt or truncated', 'BMP'), ('disguised.jpg', 'corrupt or truncated', 'WEBP')) v(name, reason, fmt))"""


@query("WITH " + _FILES + " SELECT rel_path, folder, 'bmp' AS ext FROM f UNION ALL SELECT 's1/nobody knows/' || name, 'nobody knows', regexp_extract(name, '[a-z]+$') FROM odd WHERE reason <> 'empty'")
def file_scan(spark: SparkSession, d: str) -> DataFrame:
    """Image files below a root, without bookkeeping and other files; Spark's reader passes over empty ones."""
    return images.scan(spark, _tree(spark, d)).select("rel_path", "folder", "ext")


@query("WITH " + _FILES + " SELECT 'class' AS kind, class_name AS name, count(*) AS n FROM f GROUP BY class_name UNION ALL SELECT 'unknown folder', 'nobody knows', NULL")
def class_folders(spark: SparkSession, d: str) -> DataFrame:
    """Files of each class over all its folders, folders of no class, classes without folder."""
    known, unknown, missing = images.class_scan(spark, _tree(spark, d), alias_table(table(spark, d, "classes"), "class_name", order="idx"))
    counts = known.groupBy(F.lit("class").alias("kind"), F.col("class_name").alias("name")).agg(F.count("*").alias("n"))
    rest = unknown.select(F.lit("unknown folder").alias("kind"), F.col("folder").alias("name")).union(missing.select(F.lit("missing class"), "class_name"))
    return counts.unionByName(rest.withColumn("n", F.lit(None).cast("bigint")))


@query("WITH " + _FILES + """ SELECT class_name, count(*) FILTER (folder = class_dir) AS counted, count(*) FILTER (folder <> class_dir) AS by_alias FROM f JOIN classes USING (class_name) GROUP BY class_name
    UNION ALL SELECT NULL, 0, 3""")
def strict_folders(spark: SparkSession, d: str) -> DataFrame:
    """Files in configured directories alone; those in folders that are only an alias are told apart."""
    x = images.strict_scan(spark, _tree(spark, d), table(spark, d, "classes"))
    return x.groupBy("class_name").agg(F.count_if("counted").alias("counted"), F.count_if(~F.col("counted")).alias("by_alias"))


@query("WITH " + _FILES + """ SELECT source, folder, class_name, count(*) AS n, false AS missing FROM (SELECT *, row_number() OVER (PARTITION BY source, folder ORDER BY rel_path) AS k FROM f WHERE source = 's1') WHERE k <= 1 GROUP BY ALL
    UNION ALL SELECT 's3', class_dir, class_name, 0, true FROM classes""")
def registry_folders(spark: SparkSession, d: str) -> DataFrame:
    """The first file of each registered folder, and the registered folders that aren't there."""
    root = _tree(spark, d)
    names = table(spark, d, "classes").select(F.explode(F.array(F.lit("s1"), F.lit("s3"))).alias("source"), F.col("class_dir").alias("folder"), "class_name")
    files = images.registry_scan(spark, root, names, strict=False, per_folder=1)
    found = files.groupBy("source", F.element_at(F.split("source_path", "/"), -2).alias("folder"), "class_name").agg(F.count("*").alias("n"))
    gone = images.missing_folders(spark, root, names).select("source", "folder", "class_name", F.lit(0).cast("bigint").alias("n"))
    return found.withColumn("missing", F.lit(False)).union(gone.withColumn("missing", F.lit(True)))


@query("WITH " + _FILES + " SELECT row_number() OVER (ORDER BY idx, rel_path) - 1 AS place, idx, rel_path FROM f")
def split_listing(spark: SparkSession, d: str) -> DataFrame:
    """Files in the order of classes, then of paths."""
    return images.class_order(images.class_scan(spark, _tree(spark, d), alias_table(table(spark, d, "classes"), "class_name", order="idx"))[0], table(spark, d, "classes"), "rel_path").select("place", "idx", "rel_path")


@query("WITH " + _FILES + ", a AS (SELECT 'BMP' AS true_format, NULL AS reason, count(*) AS n FROM f UNION ALL SELECT NULL, 'unsupported extension', count(*) FROM classes UNION ALL SELECT fmt, reason, count(*) FROM odd GROUP BY ALL) SELECT true_format, reason, sum(n)::BIGINT AS n FROM a GROUP BY ALL")
def file_inspection(spark: SparkSession, d: str) -> DataFrame:
    """All files but bookkeeping by their true format and the reason against them."""
    return images.inspect(spark, _tree(spark, d)).groupBy("true_format", "reason").agg(F.count("*").alias("n"))


@query("SELECT 's1/' || class_dir || '/note.txt' AS rel_path, sha256('note ' || idx) AS sha256 FROM classes")
def file_hashes(spark: SparkSession, d: str) -> DataFrame:
    x = images.scan(spark, _tree(spark, d), ["txt"])
    return x.select("rel_path", content_hash(F.col("content")).alias("sha256"))


@query("WITH " + _FILES + ", a AS (SELECT folder, class_name, count(*) AS n FROM f GROUP BY ALL) SELECT folder, class_name, n FROM a UNION ALL SELECT 'nobody knows', NULL, 3")
def download_listing(spark: SparkSession, d: str) -> DataFrame:
    """Folders of a downloaded tree with their images and the class they would be."""
    return images.folder_listing(spark, _tree(spark, d), alias_table(table(spark, d, "classes"), "class_name", order="idx"))


@query("SELECT image_id, coalesce(nullif(lower(trim(source)), ''), 'unspecified') AS lighting, 'unspecified' AS quality FROM (SELECT DISTINCT image_id, source FROM pool_images)")
def folder_conditions(spark: SparkSession, d: str) -> DataFrame:
    """Conditions in the names of folders."""
    x = table(spark, d, "pool_images").select("image_id", "source").distinct()
    path = F.concat(F.lit("/data/Lighting="), F.coalesce("source", F.lit("")), F.lit("/quality= /a.jpg"))
    return x.select("image_id", images.folder_conditions(path, ["lighting", "quality"]).alias("c")).select("image_id", "c.*")


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "classes").select("class_name", "class_dir")
    x = pool(spark, d, "staged_name", "class_name", "source", "family", "source_path", "sha256", "original_sha256", "converted", "phash", "width", "height", "group_id", "split", "in_balanced")
    x = x.join(names, "class_name", "left").withColumn("source_commit", F.lit("c0"))
    return x.withColumnRenamed("class_name", "class")


@query(W_POOL + " SELECT staged_name, class_name AS class, source_path, sha256, width::VARCHAR AS width, split, in_balanced::VARCHAR AS in_balanced FROM pool")
def manifest_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The manifest as sorted CSV, read back as strings."""
    path = scratch(spark, "manifest")
    manifests.write_manifest(_manifest(spark, d), path)
    return manifests.read_csv(spark, path, manifests.MANIFEST).select("staged_name", "class", "source_path", "sha256", "width", "split", "in_balanced")


@query("SELECT class_name AS class, source, family, source_path, sha256, reason, kept_instead, detail FROM removed_images")
def ledger_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "ledger")
    manifests.write_ledger(table(spark, d, "removed_images").withColumnRenamed("class_name", "class"), path)
    return manifests.read_csv(spark, path, manifests.LEDGER)


@query("WITH " + SQL_HELD + " SELECT file, sha256, phash FROM held WHERE sha256 IS NOT NULL")
def fingerprints_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Held-out fingerprints recorded and read: no labels, no rows without a content hash."""
    path = scratch(spark, "prints")
    manifests.write_sorted_csv(manifests.record_fingerprints(held_out(spark, d)), path, ["file"])
    assert manifests.read_fingerprints(spark, path + "-none").isEmpty()
    return manifests.read_fingerprints(spark, path)


@query("SELECT file, filename, actual_class, predicted_class, confidence, correct, low_confidence, " + ", ".join(P_COLUMNS) + " FROM predictions")
def predictions_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "predictions")
    fixed = ["file", "filename", "actual_class", "predicted_class", "confidence", "correct", "low_confidence"]
    manifests.write_rows_csv(table(spark, d, "predictions").select(*fixed, *P_COLUMNS), path)
    x = manifests.read_predictions(spark, path, [c.removeprefix("p_") for c in P_COLUMNS])
    return x.select(*fixed, *P_COLUMNS)


@query(W_POOL + " SELECT 'pool' AS variant, split, class_dir, count(*) AS n FROM pool LEFT JOIN classes USING (class_name) GROUP BY ALL UNION ALL SELECT 'full', split, class_dir, count(*) FROM pool LEFT JOIN classes USING (class_name) WHERE split IS NOT NULL GROUP BY ALL UNION ALL SELECT 'balanced', split, class_dir, count(*) FROM pool LEFT JOIN classes USING (class_name) WHERE split IS NOT NULL AND in_balanced GROUP BY ALL")
def staged_variants(spark: SparkSession, d: str) -> DataFrame:
    """The pool and its variants as partitioned tables, read back."""
    root = scratch(spark, "staged")
    manifests.stage(_manifest(spark, d), root)
    each = [spark.read.parquet(f"{root}/{v}").groupBy(F.lit(v).alias("variant"), "split", "class_dir").agg(F.count("*").alias("n")) for v in manifests.VARIANTS]
    return each[0].union(each[1]).union(each[2])


@query("SELECT DISTINCT source_path AS path, length(source_path) AS size, sha256(source_path) AS mark, 2::BIGINT AS computed_in FROM removed_images WHERE source_path IS NOT NULL AND length(source_path) % 2 = 1 UNION ALL SELECT DISTINCT source_path, length(source_path), sha256(source_path), 1 FROM removed_images WHERE source_path IS NOT NULL AND length(source_path) % 2 = 0")
def cached_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """A cache filled with some files; the second call computes only the others."""
    cache = scratch(spark, "cache")
    size = F.length("source_path").cast("bigint")
    files = table(spark, d, "removed_images").filter("source_path is not null").select(F.col("source_path").alias("path"), size.alias("size"), F.lit(0).cast("bigint").alias("mtime")).distinct()
    by = lambda call: lambda x: x.withColumn("mark", F.sha2("path", 256)).withColumn("computed_in", F.lit(call).cast("bigint"))
    images.with_cache(spark, files.filter("size % 2 = 0"), cache, by(1))
    return images.with_cache(spark, files, cache, by(2)).drop("mtime")


_BUILD = (
    W_POOL
    + """, full_v AS (SELECT * FROM pool WHERE split IS NOT NULL), bal AS (SELECT * FROM full_v WHERE in_balanced),
    v AS (SELECT 'pool_differs' AS name, 0::BIGINT AS violations UNION ALL SELECT 'full_differs', 0 UNION ALL SELECT 'balanced_differs', 0
    UNION ALL SELECT 'balanced_not_in_full', (SELECT count(*) FROM bal ANTI JOIN full_v USING (image_id, split)) UNION ALL SELECT 'content_differs', 0
    UNION ALL SELECT 'augmented_outside_train', (SELECT count(*) FROM full_v WHERE staged_name LIKE 'aug\\_\\_%' ESCAPE '\\' AND split <> 'train') UNION ALL SELECT 'reserved_prefix', (SELECT count(*) FROM pool WHERE staged_name LIKE 'aug\\_\\_%' ESCAPE '\\')
    UNION ALL SELECT 'name_collisions', (SELECT count(*) FROM (SELECT staged_name FROM pool GROUP BY staged_name HAVING count(*) > 1)))""".replace("\\\\", "\\")
)


@query(_BUILD + " SELECT name, violations, violations = 0 AS passed FROM v")
def verify_build(spark: SparkSession, d: str) -> DataFrame:
    """The staged pool and both variants against the manifest they were made of."""
    root = scratch(spark, "build")
    names = table(spark, d, "classes").select("class_name", "class_dir")
    x = pool(spark, d, "staged_name", "class_name", "sha256", "split", "in_balanced").join(names, "class_name", "left")
    manifests.stage(x, root)
    on_disk = {v: spark.read.parquet(f"{root}/{v}") for v in manifests.VARIANTS}
    return verify.build_checks(x, on_disk["pool"], on_disk["full"], on_disk["balanced"], "image_id")


@query("WITH " + _FILES + " SELECT 'undecodable' AS name, 2::BIGINT AS violations, false AS passed UNION ALL SELECT 'webp_content', 1, false UNION ALL SELECT 'content_differs', 1, false UNION ALL SELECT 'not_in_manifest', 0, true UNION ALL SELECT 'not_on_disk', 1, false UNION ALL SELECT 'augmented_outside_train', 0, true UNION ALL SELECT 'reserved_prefix', 0, true")
def verify_files(spark: SparkSession, d: str) -> DataFrame:
    """Files on disk against a manifest that lists one more: hashes, bytes, decoding."""
    root = _tree(spark, d)
    found = images.scan(spark, root).withColumn("sha256", content_hash(F.col("content"))).withColumn("split", F.lit("train")).withColumn("staged_name", file_name(F.col("rel_path")))
    decoded = images.decode(spark, root).select("path", (F.col("width") > 0).alias("decodes"))
    listed = found.select("rel_path", "sha256").union(spark.createDataFrame([("s1/gone.bmp", "00")], "rel_path string, sha256 string"))
    return verify.file_checks(found.join(decoded, "path", "left"), listed, path="rel_path", content="content", decodes="decodes")
