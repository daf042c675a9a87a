"""Pairs of near hashes by an exact banded join.

With a limit of t bits, hashes cut into t + 1 bands agree in at least one: joining on (band,
value) finds all pairs, and the distance is then tested. Only hashes of equal length are compared;
short ones, whose bands would be too common, are cut into t + 2 bands of which a pair shares two.
Records with equal hashes are one class, which its least record represents: pairs are pairs of
classes, so that many copies of one image make one row and not all pairs of them. A band value
that many classes share is replaced by t + 1 finer ones, of disjoint parts of the whole hash, of
which a pair again shares one, and these in turn while they are shared by many.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.scalars import hash_words, word_distance
from gleanery.runtime import cut

HOT_BAND = 2_000
#: Times a band is made finer; what many share even then is joined as it is.
FINER = 3
#: Bits that a band must have to be a key by itself.
BAND_BITS = 32


def hash_classes(df: DataFrame, key: str, digits: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(hash, `by`, representative, n): records of equal hash (and equal `by`) as one row; null hashes are none."""
    known = df.filter(F.col(digits).isNotNull())
    return known.groupBy(digits, *by).agg(F.min(key).alias("representative"), F.count("*").alias("n"))


def members(df: DataFrame, key: str, digits: str) -> DataFrame:
    """(key, representative) of each record with a hash; only hashes of several records are joined back."""
    classes = hash_classes(df, key, digits)
    several = classes.filter("n > 1").select(digits, "representative")
    known = df.filter(F.col(digits).isNotNull())
    return known.join(several, digits, "left").select(key, F.coalesce("representative", F.col(key)).alias("representative"))


def _cuts(length: int, parts: int) -> list[tuple[int, int]]:
    at = [length * k // parts for k in range(parts + 1)]
    return [(a + 1, b - a) for a, b in zip(at, at[1:])]


def _key(digits: str, parts, *more: object) -> str:
    return f"xxhash64({', '.join([*map(str, more), *(f'substring({digits}, {a}, {n})' for a, n in parts)])})"


def _bands(limit: int, length: int) -> list[list[tuple[int, int]]]:
    if length * 4 // (limit + 1) >= BAND_BITS:
        return [[b] for b in _cuts(length, limit + 1)]
    return [list(c) for c in combinations(_cuts(length, limit + 2), 2)] if length >= limit + 2 else [[]]


def _sets(limit: int, length: int, level: int) -> list[list[tuple[int, int]]]:
    """`limit` + 1 disjoint sets of parts, other ones at each level."""
    parts = _cuts(length, min(length, 3 * (limit + 1)))
    return [[p for j, p in enumerate(parts) if (j + level * (j // (limit + 1))) % (limit + 1) == g] for g in range(limit + 1)]


def _by_length(digits: str, lengths: list[int], of) -> Column:
    cases = " ".join(f"WHEN length({digits}) = {n} THEN array({', '.join(of(n))})" for n in lengths)
    return F.expr(f"CASE {cases} END")


def _banded(classes: DataFrame, digits: str, limit: int, lengths: list[int], side: str, keep: list[str]) -> DataFrame:
    named = [F.col("representative").alias(f"{side}_id"), F.col(digits).alias(f"{side}_hash"), *(F.col(c).alias(f"{side}_{c}") for c in keep)]
    bands = _by_length(f"{side}_hash", lengths, lambda n: [_key(f"{side}_hash", b, n, k) for k, b in enumerate(_bands(limit, n))])
    words = hash_words(F.col(f"{side}_hash"), (max(lengths) + 15) // 16)
    return classes.select(*named).withColumn(f"{side}_words", words).withColumn("band", F.explode(bands))


def near_pairs(a: DataFrame, b: DataFrame | None, key: str, digits: str, limit: int = 5, keep: tuple[str, ...] = (), same: tuple[str, ...] = ()) -> DataFrame:
    """(a_id, b_id, distance, a_hash, b_hash, a_*, b_*): pairs of classes at most `limit` bits apart, each once.

    A class holds the records of one hash and equal `keep` and `same` columns; ids are those
    of representatives, `members` gives the rest. Within `a` (`b` None) with a_id < b_id,
    else between the two. Columns of `same` must be equal, as part of the join. Hashes of
    different lengths and nulls match nothing; no hashes give no rows.
    """
    columns = list(dict.fromkeys((*keep, *same)))
    mine = cut(hash_classes(a, key, digits, tuple(columns)))
    other = mine if b is None else cut(hash_classes(b, key, digits, tuple(columns)))
    sizes = mine.select(F.length(digits).alias("n")).union(other.select(F.length(digits)))
    lengths = sorted(r[0] for r in sizes.filter("n > 0").distinct().collect()) or [64]  # a row a length
    as_b = lambda x: x.withColumnsRenamed({c: "b_" + c[2:] for c in x.columns if c != "band"})
    left = _banded(mine, digits, limit, lengths, "a", columns)
    right = _banded(other, digits, limit, lengths, "b", columns) if b is not None else as_b(left)
    for level in range(FINER):
        hot = cut(right.groupBy("band").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_BAND).select("band"))
        if hot.isEmpty():
            break
        mark = hot.withColumn("__hot", F.lit(True))

        def finer(x: DataFrame, side: str) -> DataFrame:
            sets = _by_length(f"{side}_hash", lengths, lambda n: [_key(f"{side}_hash", s, "band", level, g) for g, s in enumerate(_sets(limit, n, level))])  # noqa: B023
            return cut(x.join(mark, "band", "left").withColumn("band", F.explode(F.when(F.col("__hot"), sets).otherwise(F.array("band")))).drop("__hot"))  # noqa: B023

        left = finer(left, "a")
        right = finer(right, "b") if b is not None else as_b(left)
    on = left["band"] == right["band"]
    for c in same:
        on &= left[f"a_{c}"] == right[f"b_{c}"]
    if b is None:
        on &= left["a_id"] < right["b_id"]
    pairs = left.join(right, on).withColumn("distance", word_distance(F.col("a_words"), F.col("b_words"), (max(lengths) + 15) // 16))
    pairs = pairs.filter((F.col("distance") <= limit) & (F.length("a_hash") == F.length("b_hash")))
    return pairs.select("a_id", "b_id", "distance", "a_hash", "b_hash", *(f"{s}_{c}" for c in columns for s in "ab")).distinct()


def near_links(df: DataFrame, key: str, digits: str, limit: int = 5) -> DataFrame:
    """(a_id, b_id): links that connect all records near each other, directly or through others.

    Pairs of classes, and each record with its class: as many rows as records and pairs of classes.
    """
    df = cut(df.select(key, digits).filter(F.col(digits).isNotNull()))
    own = members(df, key, digits).select(F.col("representative").alias("a_id"), F.col(key).alias("b_id")).filter("a_id <> b_id")
    return near_pairs(df, None, key, digits, limit).select("a_id", "b_id").union(own)
