"""Exact and near duplicates, label conflicts, contamination, and the removal ledger.

Operators give (kept, removed). Ledger rows: `LEDGER` columns; `kept_instead` names the
record that stays, `detail` explains. Keep-first is an aggregate of a least struct, so copies
of one content are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.hamming import near_pairs
from gleanery.runtime import cut

LEDGER = ["class_name", "source", "family", "source_path", "sha256", "reason", "kept_instead", "detail"]


def uid(source: Column | None = None, path: Column | None = None) -> Column:
    """A record's name: source/source_path."""
    return F.concat_ws("/", F.col("source") if source is None else source, F.col("source_path") if path is None else path)


def ledger(rows: DataFrame, reason: Column, kept_instead: Column | None = None, detail: Column | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    none = F.lit(None).cast("string")
    extra = {"reason": reason, "kept_instead": none if kept_instead is None else kept_instead, "detail": none if detail is None else detail}
    return rows.select(*(extra[c].alias(c) if c in extra else F.col(c) for c in LEDGER), *more)


def keep_first(df: DataFrame, keys: list[str], order: list[str], name: str, reason: str = "exact_duplicate", unread: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The first row of each key in `order`, which must tell rows apart.

    Rows with a null key stay, or with `unread`, the reason to give, leave. Only keys of several
    rows are joined back, so that single ones pass by.
    """
    known = F.lit(True)
    for k in keys:
        known &= F.col(k).isNotNull()
    first = df.filter(known).groupBy(*keys).agg(F.min(F.struct(*order, F.col(name).alias("__name"))).alias("__first"), F.count("*").alias("__n"))
    first = first.filter("__n > 1").select(*keys, F.struct(*(F.col("__first")[c].alias(c) for c in order)).alias("__first"), F.col("__first")["__name"].alias("__kept"))
    marked = df.join(first, keys, "left").withColumn("__drop", F.coalesce(F.struct(*order) > F.col("__first"), F.lit(False)))
    if unread is None:
        return marked.filter(~F.col("__drop")).select(*df.columns), ledger(marked.filter("__drop"), F.lit(reason), F.col("__kept"))
    kept = marked.filter(~F.col("__drop") & known).select(*df.columns)
    removed = marked.filter(F.col("__drop") | ~known)
    return kept, ledger(removed, F.when(known, reason).otherwise(unread), F.col("__kept"))


def label_conflicts(df: DataFrame, content: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Content under several labels leaves all of them. Rows with null content stay."""
    seen = df.filter(F.col(content).isNotNull()).groupBy(content).agg(F.min(label).alias("lo"), F.max(label).alias("hi"), F.sort_array(F.collect_set(label)).alias("__labels"))
    bad = seen.filter("lo < hi").select(content, "__labels")
    removed = df.join(bad, content)
    kept = df.join(bad, content, "left_anti")
    others = F.array_join(F.array_except("__labels", F.array(label)), ", ")
    return kept.select(*df.columns), ledger(removed, F.lit("label_conflict_exact"), None, F.concat(F.lit("also seen as "), others))


def drop_family_copies(df: DataFrame, key: str, digits: str, rank: str, limit: int = 5) -> tuple[DataFrame, DataFrame]:
    """Members of a family leave if near a record of the family's own source in the same class.

    The primary record that comes first by (`rank`, source_path) is named. Primary records stay.
    Ledger rows have the record's `key` too.
    """
    df = cut(df)
    primary, member = df.filter("source = family"), df.filter("source <> family")
    named = primary.withColumn("__first", F.struct(F.col(rank), F.col("source_path")))
    firsts = named.groupBy(digits, "class_name", "family").agg(F.min("__first").alias("__first"), F.min(key).alias(key))
    pairs = near_pairs(member.select(key, digits, "class_name", "family", F.lit(None).cast(firsts.schema["__first"].dataType).alias("__first")), firsts, key, digits, limit, keep=("__first",), same=("class_name", "family"))
    first = pairs.groupBy("a_hash", "a_class_name", "a_family").agg(F.min("b___first").alias("m"))
    hit = first.select(F.col("a_hash").alias(digits), F.col("a_class_name").alias("class_name"), F.col("a_family").alias("family"), F.col("m.source_path").alias("__path"))
    on = [digits, "class_name", "family"]
    removed = member.join(hit, on)
    kept = df.join(hit.withColumn("__hit", F.lit(True)), on, "left").filter("__hit is null or source = family").select(*df.columns)
    return kept, ledger(removed, F.concat(F.lit("near_duplicate_of_"), "family"), uid(F.col("family"), F.col("__path")), more=(key,))


def drop_held_out(df: DataFrame, held_out: DataFrame, key: str, contents: list[str], digits: str, limit: int = 5) -> tuple[DataFrame, DataFrame]:
    """Records that equal or nearly equal a held-out file leave; `detail` lists the files.

    Exact matches come first; a near match of a file already matched exactly isn't repeated.
    `held_out`: file, sha256, phash and no label.
    """
    exact = None
    for c in contents:
        found = df.select(F.col(key).alias("id"), F.col(c).alias("sha256")).join(held_out.select("file", "sha256"), "sha256").select("id", "file", F.lit(-1).alias("apart"))
        exact = found if exact is None else exact.union(found)
    slim = df.select(key, digits, F.lit(None).cast("string").alias("file"))
    classes = near_pairs(slim, held_out.select(F.col("file").alias(key), F.col("phash").alias(digits), "file"), key, digits, limit, keep=("file",))
    near = df.select(F.col(key).alias("id"), F.col(digits).alias("a_hash")).join(classes.select("a_hash", F.col("b_file").alias("file"), "distance"), "a_hash")
    notes = exact.union(near.select("id", "file", F.col("distance"))).groupBy("id", "file").agg(F.min("apart").alias("apart"))
    text = F.when(F.col("apart") < 0, F.concat(F.lit("exact "), "file")).otherwise(F.concat(F.lit("near "), "file", F.lit(" ("), F.col("apart").cast("string"), F.lit(" bits)")))
    listed = notes.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((F.col("apart") >= 0).alias("o"), F.col("file"), text.alias("t")))).alias("x"))
    detail = listed.select(F.col("id").alias(key), F.array_join(F.transform("x", lambda s: s["t"]), "; ").alias("__detail"))
    removed = df.join(detail, key)
    return df.join(detail, key, "left_anti").select(*df.columns), ledger(removed, F.lit("held_out_overlap"), None, F.col("__detail"))


def exact_groups(df: DataFrame, content: str, name: str) -> DataFrame:
    """(content, member, n): a row for each record of content that several records have."""
    some = df.filter(F.col(content).isNotNull()).groupBy(content).agg(F.count("*").alias("n")).filter("n > 1")
    return df.select(content, F.col(name).alias("member")).join(some, content)
