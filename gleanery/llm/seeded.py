"""Seeded draws from groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.ordering import before_by_hash


def priority(seed: int, *columns: str) -> Column:
    """A number that permutes records the same way in every run with this seed."""
    return F.xxhash64(F.lit(seed), *columns)


def weight_before(df: DataFrame, groups: list[str], order: str, tie: str, weight: Column) -> DataFrame:
    """Adds ``before``: the weight of the group's rows that come earlier in the permutation."""
    return before_by_hash(df, groups, order, tie, weight)
