"""Connected components and group numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.runtime import cut


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("node", "to").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(h)).first())


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): linked nodes with the least node of their component.

    Rounds of large and small stars: links of a node to larger ones, then to smaller ones, are
    hung onto the least of them, until every component is a star around its least node. Each
    link stays one row, however large a component is. Self links and nulls link nothing.
    """
    one = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    links = cut(one.select(F.greatest("x", "y").alias("node"), F.least("x", "y").alias("to")).distinct())
    state = _state(links)
    for _ in range(max_rounds):
        both = links.union(links.select("to", "node"))
        least = both.groupBy("node").agg(F.least("node", F.min("to")).alias("least"))
        large = both.filter("to > node").join(least, "node").select(F.col("to").alias("node"), F.col("least").alias("to")).filter("node <> to").distinct()
        large = cut(large)
        least = large.groupBy("node").agg(F.min("to").alias("least"))
        hung = large.join(least, "node").filter("to <> least").select(F.col("to").alias("node"), F.col("least").alias("to"))
        links = cut(hung.union(least.select("node", F.col("least").alias("to"))).distinct())
        before, state = state, _state(links)
        if state == before:
            tops = links.select(F.col("to").alias("node"), F.col("to").alias("component")).distinct()
            return links.select("node", F.col("to").alias("component")).union(tops)
    raise RuntimeError(f"links still change after {max_rounds} rounds")


def number_groups(members: DataFrame, component: str, to: str = "group_id") -> DataFrame:
    """Numbers from 0 in the order of `component`; a range-wise rank, not one sorted task."""
    from gleanery.operators.ordering import before_by_sort

    names = members.select(component).distinct().withColumn("__all", F.lit(0))
    numbered = before_by_sort(names, ["__all"], [component], F.lit(1), to).drop("__all")
    return members.join(numbered, component)


def group_counts(grouped: DataFrame, group: str, label: str) -> DataFrame:
    """One row: groups of several members, members in them, groups of several labels."""
    sizes = grouped.groupBy(group).agg(F.count("*").alias("n"), F.min(label).alias("lo"), F.max(label).alias("hi"))
    several = F.col("n") > 1
    return sizes.agg(
        F.count_if(several).alias("groups"),
        F.coalesce(F.sum(F.when(several, F.col("n"))), F.lit(0)).alias("members"),
        F.count_if(several & (F.col("lo") < F.col("hi"))).alias("cross_label"),
    )


