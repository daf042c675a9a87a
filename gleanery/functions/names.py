"""Names, hex values and other scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalised(name: Column) -> Column:
    """Trimmed, lower-cased, blanks and hyphens as underscores; null for null or blank."""
    text = F.translate(F.lower(F.regexp_replace(name, r"^\s+|\s+$", "")), " -", "__")
    return F.when(text != "", text)


def hex_value(value: Column) -> Column:
    """Hex digits in lower case without blanks, separators and a leading ``0x``.

    Null, blank and anything that is no hex number give null.
    """
    text = F.regexp_replace(F.regexp_replace(F.lower(value), r"[\s:\-]+", ""), "^0x", "")
    return F.when(text.rlike("^[0-9a-f]+$"), text)


def alias_table(names: DataFrame, name: str, aliases: str = "aliases", order: str | None = None) -> DataFrame:
    """(alias, canonical) of a name table; a name is an alias of itself.

    Of names with a common alias the first in `order` wins, without `order` the least name.
    """
    every = F.concat(F.array(F.col(name)), F.coalesce(F.col(aliases), F.array().cast("array<string>")))
    return (
        names.select(F.col(name).alias("canonical"), F.col(order or name).alias("place"), F.explode(every).alias("alias"))
        .select("canonical", "place", normalised(F.col("alias")).alias("alias"))
        .filter("alias is not null")
        .groupBy("alias")
        .agg(F.min(F.struct("place", "canonical"))["canonical"].alias("canonical"))
    )


def resolve(df: DataFrame, column: str, aliases: DataFrame, to: str) -> DataFrame:
    """Adds `to`, the canonical name of `column`, or null where no alias fits; a column `to` is replaced."""
    key = f"__{to}_key"
    dim = aliases.select(F.col("alias").alias(key), F.col("canonical").alias(to))
    return df.withColumn(key, normalised(F.col(column))).drop(to).join(dim, key, "left").drop(key)
