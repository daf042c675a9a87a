"""Checks of a finished dataset. Each check is a count of violations; zero passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions.scalars import true_format
from gleanery.operators.hamming import near_pairs
from gleanery.runtime import cut

#: Names of augmented files begin so.
RESERVED = "aug__"


def difference(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of either side that the other lacks, with the side: one shuffle for both directions."""
    both = a.select(*columns, F.lit(1).alias("__n")).unionByName(b.select(*columns, F.lit(-1).alias("__n")))
    x = both.groupBy(*columns).agg(F.sum("__n").alias("__n")).filter("__n <> 0")
    return x.select(*columns, F.when(F.col("__n") > 0, "left").otherwise("right").alias("only_in"), F.abs("__n").cast("bigint").alias("n"))


def straddling(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys whose rows lie in several splits."""
    return df.filter(F.col(key).isNotNull() & F.col(split).isNotNull()).groupBy(key).agg(F.min(split).alias("lo"), F.max(split).alias("hi")).filter("lo < hi").select(key)


def near_leaks(df: DataFrame, key: str, digits: str, limit: int = 5, split: str = "split") -> DataFrame:
    """Pairs of near classes (of equal hash and split) across splits."""
    known = df.filter(F.col(split).isNotNull())
    pairs = near_pairs(known, None, key, digits, limit, keep=(split,))
    return pairs.filter(F.col(f"a_{split}") != F.col(f"b_{split}"))


def checks(df: DataFrame, held_out: DataFrame, key: str = "image_id", limit: int = 5) -> DataFrame:
    """(name, violations, passed) of the leakage and nesting checks over a pool.

    The pool's columns that the checks need are written once and read by each of them.
    """
    df = cut(df.select(key, "sha256", "original_sha256", "phash", "group_id", "split", "in_balanced", "source_path", "converted", "staged_name"))
    held = held_out.select(F.col("sha256").alias("__sha")).filter("__sha is not null").distinct()
    exact = lambda c: df.join(held, df[c] == held["__sha"], "left_semi")
    found = {
        "exact_straddles_splits": straddling(df, "sha256"),
        "group_straddles_splits": straddling(df, "group_id"),
        "near_straddles_splits": near_leaks(df, key, "phash", limit),
        "held_out_exact": exact("sha256").select(key).union(exact("original_sha256").select(key)).distinct(),
        "held_out_near": near_pairs(df.select(F.col(key).cast("string").alias(key), "phash"), held_out.select(F.col("file").alias(key), "phash"), key, "phash", limit),
        "balanced_without_split": df.filter("in_balanced and split is null"),
        "webp_left": df.filter("lower(source_path) like '%.webp' and converted is null"),
        "name_collisions": df.groupBy("staged_name").agg(F.count_distinct(key).alias("n")).filter("n > 1"),
    }
    counts = [x.agg(F.lit(name).alias("name"), F.count("*").alias("violations")) for name, x in found.items()]
    return reduce(DataFrame.union, counts).withColumn("passed", F.col("violations") == 0)


def _passed(counts: DataFrame, names: list[str]) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.col(k).alias("violations")) for k in names))).alias("x")
    return counts.select(each).select("x.*").withColumn("passed", F.col("violations") == 0)


def file_checks(df: DataFrame, manifest: DataFrame, path: str = "path", name: str = "staged_name", split: str = "split", sha: str = "sha256", content: str | None = None, decodes: str | None = None) -> DataFrame:
    """(name, violations, passed) of the checks over the files of a build, `path` being their key.

    Each file in the manifest (`path`, `sha`) with its hash, and the reverse; augmented files
    (``aug__``) only in train; no other file's name with the reserved prefix (`manifest` may
    have a boolean ``augmented``; without, every listed file counts as none); with `content`, no
    WebP by its first bytes; with `decodes`, every file decodes. A file without a hash or a
    split, or one that only one side has, violates what asks for it.
    """
    marked = F.col("augmented") if "augmented" in manifest.columns else F.lit(False)
    listed = manifest.select(F.col(path).alias("__path"), F.col(sha).alias("__sha"), F.coalesce(marked, F.lit(False)).alias("__augmented"))
    both = df.join(listed, df[path] == F.col("__path"), "full")
    there, known = F.col(path).isNotNull(), F.col("__path").isNotNull()
    prefixed = F.coalesce(F.element_at(F.split(name, "/"), -1).startswith(RESERVED), F.lit(False))
    bad = {
        "not_on_disk": ~there,
        "not_in_manifest": ~known,
        "content_differs": ~F.coalesce(F.col(sha) == F.col("__sha"), F.lit(False)),
        "augmented_outside_train": prefixed & ~F.coalesce(F.col(split) == "train", F.lit(False)),
        "reserved_prefix": prefixed & ~F.coalesce("__augmented", F.lit(False)),
    }
    if content is not None:
        bad["webp_content"] = F.coalesce(true_format(F.col(content)) == "WEBP", F.lit(False))
    if decodes is not None:
        bad["undecodable"] = there & ~F.coalesce(F.col(decodes), F.lit(False))
    return _passed(both.agg(*(F.count_if(x).alias(k) for k, x in bad.items())), list(bad))


def build_checks(manifest: DataFrame, pool: DataFrame, full: DataFrame, balanced: DataFrame, key: str, name: str = "staged_name", split: str = "split", sha: str = "sha256") -> DataFrame:
    """(name, violations, passed) of a staged build against its manifest (with ``in_balanced``): the pool
    and both variants hold what they should, each balanced record is in the full variant and the
    same split, content is the manifest's, augmented records are in train alone, and names
    neither collide nor begin with the reserved prefix.

    Each record is one row of one aggregate, with flags for where it was found.
    """
    flags = {"m": manifest, "p": pool, "f": full, "b": balanced}
    each = None
    for tag, df in flags.items():
        own = df.select(F.col(key).alias("key"), F.lit(tag).alias("tag"), F.col(split).alias("split"), F.col(sha).alias("sha"), F.col(name).alias("name"), "in_balanced")
        each = own if each is None else each.unionByName(own)
    of = lambda tag, c: F.max(F.when(F.col("tag") == tag, F.col(c)))
    found = each.groupBy("key").agg(*(F.count_if(F.col("tag") == t).alias(t) for t in flags), *(of(t, "split").alias(f"{t}_split") for t in "mfb"), *(of(t, "sha").alias(f"{t}_sha") for t in "mp"), of("m", "name").alias("name"), of("m", "in_balanced").alias("chosen"))
    chosen = F.coalesce("chosen", F.lit(False)) & F.col("m_split").isNotNull()
    augmented = F.coalesce(F.col("name").startswith(RESERVED), F.lit(False))
    bad = {
        "pool_differs": F.col("p") != F.col("m"),
        "full_differs": F.col("f") != F.when(F.col("m_split").isNotNull(), F.col("m")).otherwise(0),
        "balanced_differs": F.col("b") != F.when(chosen, F.col("m")).otherwise(0),
        "balanced_not_in_full": (F.col("b") > 0) & ((F.col("f") == 0) | ~F.col("b_split").eqNullSafe(F.col("f_split"))),
        "content_differs": (F.col("p") > 0) & ~F.col("p_sha").eqNullSafe(F.col("m_sha")),
        "augmented_outside_train": augmented & (F.col("f") > 0) & ~F.col("f_split").eqNullSafe(F.lit("train")),
        "reserved_prefix": augmented,
    }
    counts = _passed(found.agg(*(F.count_if(x).alias(k) for k, x in bad.items())), list(bad))
    names = manifest.groupBy(name).agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias("violations"))
    return counts.union(names.select(F.lit("name_collisions"), "violations", F.col("violations") == 0))


def verdict(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count_if("passed").alias("passed_checks"), F.count("*").alias("checks"), F.min("passed").alias("passed"))
