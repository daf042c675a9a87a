"""Image files: scans, inspection, upload rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.scalars import EXTENSIONS, extension, is_metadata, relative, true_format

MIN_SIDE = 32
MAX_UPLOAD = 10 * 1024 * 1024


def rejection(readable: Column, size: Column, ext: Column, decodes: Column, width: Column, height: Column) -> Column:
    """Why a file is no usable image, the first reason that holds; null if none does."""
    return (
        F.when(~readable, "unreadable")
        .when(size == 0, "empty")
        .when(~ext.isin(EXTENSIONS), "unsupported extension")
        .when(~decodes, "corrupt or truncated")
        .when((width < MIN_SIDE) | (height < MIN_SIDE), "too small")
    )


def upload_status(model_ready: Column, name: Column, size: Column, width: Column, height: Column, largest: int = MAX_UPLOAD) -> Column:
    """(status, message) of an upload."""
    say = lambda code, text: F.struct(F.lit(code).alias("status"), F.lit(text).alias("message"))
    return (
        F.when(~model_ready, say(503, "no model"))
        .when(name.isNull() | (F.trim(name) == ""), say(400, "no file name"))
        .when(~extension(name).isin(EXTENSIONS), say(415, "unsupported extension"))
        .when(size == 0, say(400, "empty file"))
        .when(size > largest, say(413, "too large"))
        .when(width.isNull() | height.isNull() | (width < 0), say(400, "not an image"))
        .when((width < MIN_SIDE) | (height < MIN_SIDE), say(400, "too small"))
        .otherwise(say(200, "ok"))
    )


def _plain(root: str) -> str:
    """A root as paths show it: file URLs without their scheme."""
    return re.sub("^file:/+", "/", root)


def scan(spark: SparkSession, root: str, extensions: list[str] | None = EXTENSIONS) -> DataFrame:
    """Files below `root`: path, rel_path, folder, ext, size, content; no bookkeeping files.

    `extensions` None keeps every file. Rows come in no order: sort by path where order matters.
    """
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    x = x.withColumn("path", F.regexp_replace("path", "^file:/+", "/")).withColumn("rel_path", relative(F.col("path"), _plain(root)))
    x = x.withColumn("ext", extension(F.col("path"))).filter(~is_metadata(F.col("rel_path")))
    if extensions is not None:
        x = x.filter(F.col("ext").isin(extensions))
    folder = F.when(F.col("rel_path").contains("/"), F.element_at(F.split("rel_path", "/"), -2))
    return x.select("path", "rel_path", folder.alias("folder"), "ext", F.col("length").alias("size"), "content")


def class_scan(spark: SparkSession, root: str, aliases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files of class folders with their class; folders without class; classes without folder."""
    from gleanery.functions.names import resolve

    found = resolve(scan(spark, root), "folder", aliases, "class_name")
    unknown = found.filter("class_name is null").select("folder").distinct()
    known = found.filter("class_name is not null")
    missing = aliases.select(F.col("canonical").alias("class_name")).distinct().join(known, "class_name", "left_anti")
    return known, unknown, missing


def strict_scan(spark: SparkSession, root: str, classes: DataFrame) -> DataFrame:
    """Files with ``class_name`` and ``counted``: whether their folder is a class's configured directory.

    Files in folders that only an alias resolves aren't counted, those in others have no class.
    """
    from gleanery.functions.names import alias_table, resolve

    found = resolve(scan(spark, root), "folder", alias_table(classes, "class_name", order="idx" if "idx" in classes.columns else None), "class_name")
    exact = classes.select(F.col("class_dir").alias("folder"), F.col("class_name").alias("__exact"))
    x = found.join(exact, "folder", "left").withColumn("counted", F.col("__exact").isNotNull())
    return x.withColumn("class_name", F.coalesce("__exact", "class_name")).drop("__exact")


def class_order(files: DataFrame, classes: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``idx``, the number of the class, and ``place``, the file's place by (idx, path)."""
    from gleanery.operators.ordering import before_by_sort

    x = files.join(classes.select("class_name", "idx"), "class_name").withColumn("__all", F.lit(0))
    return before_by_sort(x, ["__all"], ["idx", path], F.lit(1), "place").drop("__all")


def folder_listing(spark: SparkSession, root: str, aliases: DataFrame) -> DataFrame:
    """(folder, class_name, n): folders with images, and the class that their name resolves to."""
    from gleanery.functions.names import resolve

    counts = scan(spark, root).groupBy("folder").agg(F.count("*").alias("n"))
    return resolve(counts, "folder", aliases, "class_name").select("folder", "class_name", "n")


def _by_folder(files: DataFrame) -> DataFrame:
    return files.withColumn("key", F.regexp_extract("rel_path", "^(.*)/[^/]*$", 1))


def missing_folders(spark: SparkSession, root: str, registry: DataFrame) -> DataFrame:
    """The registry's rows whose folder has no files: a warning each."""
    wanted = registry.withColumn("key", F.concat_ws("/", "source", "folder"))
    return wanted.join(_by_folder(scan(spark, root)).select("key").distinct(), "key", "left_anti").drop("key")


def registry_scan(spark: SparkSession, root: str, registry: DataFrame, strict: bool = True, per_folder: int | None = None) -> DataFrame:
    """Files of the registry's (source, folder, class_name) entries below root/source/folder.

    Missing folders raise if `strict`, else they are left out and `missing_folders` gives them.
    `per_folder` keeps the first files by path.
    """
    from pyspark.sql import Window as W

    files = _by_folder(scan(spark, root))
    wanted = registry.withColumn("key", F.concat_ws("/", "source", "folder"))
    if strict:
        gone = [f"{r['source']}/{r['folder']}" for r in missing_folders(spark, root, registry).limit(20).collect()]
        if gone:
            raise FileNotFoundError(f"missing folders: {', '.join(sorted(gone))}")
    x = files.drop("folder").join(wanted.select("key", "source", "class_name"), "key").withColumnRenamed("rel_path", "source_path")
    if per_folder is not None:
        x = x.withColumn("__k", F.row_number().over(W.partitionBy("key").orderBy("source_path"))).filter(F.col("__k") <= per_folder).drop("__k")
    return x.drop("key")


def decode(spark: SparkSession, root: str) -> DataFrame:
    """(path, width, height, channels, data) by Spark's image source; width -1 where it can't decode."""
    x = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "false").load(root)
    # The source gives URLs, in which blanks and the like are escaped; a plus is a plus.
    x = x.select("image.*").withColumn("path", F.regexp_replace(F.url_decode(F.replace("origin", F.lit("+"), F.lit("%2B"))), "^file:/+", "/"))
    return x.select("path", "width", "height", F.col("nChannels").alias("channels"), "data")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, size) of every file below `root`, empty ones too, which Spark's readers pass over.

    The driver lists the entries of `root` alone; each is walked by a task.
    """
    import pandas as pd
    from pyarrow import fs

    def walk(batches):
        for pdf in batches:
            found = []
            for uri in pdf["uri"]:
                system, path = fs.FileSystem.from_uri(uri)
                infos = system.get_file_info([path])
                if infos[0].type == fs.FileType.Directory:
                    infos = system.get_file_info(fs.FileSelector(path, recursive=True))
                found += [(i.path, i.size) for i in infos if i.type == fs.FileType.File]
            yield pd.DataFrame(found, columns=["path", "size"])

    base = _plain(root)
    base = base if "://" in base else f"file://{base}"
    system, path = fs.FileSystem.from_uri(base)
    tops = [(base.rstrip("/") + "/" + i.base_name,) for i in system.get_file_info(fs.FileSelector(path))]
    entries = spark.createDataFrame(tops, "uri string")
    return entries.repartition(max(1, min(len(tops), 1000))).mapInPandas(walk, "path string, size bigint")


def inspect(spark: SparkSession, root: str) -> DataFrame:
    """Every file with its true format, sizes and the reason against it (null if it is usable)."""
    files = listing(spark, root).withColumn("rel_path", relative(F.col("path"), _plain(root))).filter(~is_metadata(F.col("rel_path")))
    content = scan(spark, root, None).select("path", "content")
    sizes = decode(spark, root).select("path", "width", "height")
    x = files.withColumn("ext", extension(F.col("path"))).join(content, "path", "left").join(sizes, "path", "left")
    decodes = F.coalesce(F.col("width") > 0, F.lit(False))
    reason = rejection(F.col("content").isNotNull() | (F.col("size") == 0), F.col("size"), F.col("ext"), decodes, F.col("width"), F.col("height"))
    return x.select("path", "rel_path", "ext", "size", true_format(F.col("content")).alias("true_format"), F.sha2("content", 256).alias("sha256"), F.when(decodes, F.col("width")).alias("width"), F.when(decodes, F.col("height")).alias("height"), reason.alias("reason"))


def folder_conditions(path: Column, dims: list[str]) -> Column:
    """A struct of the ``key=value`` folder names of a path, blanks as 'unspecified'."""
    pairs = F.filter(F.split(path, "/"), lambda p: p.contains("="))
    values = F.map_from_entries(F.array_distinct(F.transform(pairs, lambda p: F.struct(F.lower(F.split_part(p, F.lit("="), F.lit(1))), F.split_part(p, F.lit("="), F.lit(2))))))
    return F.struct(*(F.coalesce(F.nullif(F.lower(F.trim(values[d])), F.lit("")), F.lit("unspecified")).alias(d) for d in dims))


def with_cache(spark: SparkSession, files: DataFrame, cache: str, compute) -> DataFrame:
    """Fingerprints of `files` (path, size, mtime), read from a parquet cache or computed and appended.

    Only files whose (path, size, mtime) the cache lacks reach `compute`, which adds columns.
    """
    key = ["path", "size", "mtime"]
    try:
        known = spark.read.parquet(cache)
    except Exception as e:  # no cache yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        compute(files).write.mode("append").parquet(cache)
    else:
        compute(files.join(known, key, "left_anti")).write.mode("append").parquet(cache)
    return spark.read.parquet(cache).join(files.select(key), key, "left_semi")
