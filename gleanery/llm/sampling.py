"""Samples whose category shares meet targets, by top-down allocation over a category tree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.llm.seeded import priority, weight_before
from gleanery.runtime import cut

ANY = "*"


def fill(df: DataFrame, groups: list[str], amount: str, room: str, weight: str, tie: str, to: str) -> DataFrame:
    """Adds `to`: whole parts of the group's `amount`, in proportion to `weight`, none above `room`.

    What a full entry can't take goes to the others; the group gets all of `amount` or all of
    its room. Entries fill up in the order of room / weight, so prefix sums give the level
    at which the others stand. Remainders go to the largest fractions, then by `tie`. Entries
    without weight get nothing before all others are full.
    """
    w = W.partitionBy(*groups)
    by_level = w.orderBy("__level", tie)
    eps = 1e-9
    x = df.withColumn("__w", F.when(F.col(weight) > 0, F.col(weight).cast("double")).otherwise(F.lit(eps)))
    x = x.withColumn("__level", F.col(room) / F.col("__w"))
    x = x.withColumn("__a", F.least(F.col(amount).cast("double"), F.sum(room).over(w).cast("double")))
    x = x.withColumn("__below", F.coalesce(F.sum(room).over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("__rest", F.sum("__w").over(by_level.rowsBetween(W.currentRow, W.unboundedFollowing)))
    x = x.withColumn("__full", F.col("__below") + F.col("__level") * F.col("__rest") <= F.col("__a") + eps)
    x = x.withColumn("__over", F.col("__a") - F.sum(F.when(F.col("__full"), F.col(room)).otherwise(0)).over(w))
    x = x.withColumn("__open", F.sum(F.when(F.col("__full"), F.lit(0.0)).otherwise(F.col("__w"))).over(w))
    exact = F.when(F.col("__full"), F.col(room)).otherwise(F.least(F.col(room), F.col("__over") * F.col("__w") / F.col("__open")))
    x = x.withColumn("__exact", exact).withColumn("__floor", F.floor(F.col("__exact") + eps).cast("bigint"))
    x = x.withColumn("__short", F.round(F.col("__a") - F.sum("__floor").over(w)).cast("bigint"))
    can = (F.col("__floor") < F.col(room)).cast("int")
    x = x.withColumn("__next", F.row_number().over(w.orderBy(can.desc(), (F.col("__exact") - F.col("__floor")).desc(), tie)))
    x = x.withColumn(to, F.col("__floor") + ((F.col("__next") <= F.col("__short")) & (can == 1)).cast("bigint"))
    return x.drop("__w", "__level", "__a", "__below", "__rest", "__full", "__over", "__open", "__exact", "__floor", "__short", "__next")


class TargetSample:
    """A sample per plan.

    `records`: one row per record with ``record``, ``scope`` (string or null), ``flag`` (boolean
    or null) and the string columns that plans name as category, some of them null; `parents`
    gives for a category field the column with the parent of its categories (categories of one
    parent are siblings, the others cousins), `leaves` the column that divides a category.

    `plans`: plan_id, category_field, scope_split, scope_balanced, sample_share, category,
    target_share, min_rows. A null scope restricts nothing; a record with a null where a plan
    restricts is outside. Targets with null plan, category or share are no targets; a null
    min_rows is 0. No plans, or no records: empty results, or demands that nothing meets.
    """

    def __init__(self, records: DataFrame, plans: DataFrame, parents: dict[str, str], leaves: dict[str, str], seed: int = 42):
        self.seed = seed
        fields = sorted(leaves)
        plans = plans.filter("plan_id is not null and category is not null and target_share is not null")
        self.plans = plans.withColumns({"min_rows": F.coalesce("min_rows", F.lit(0)), "__scope": F.coalesce("scope_split", F.lit(ANY)), "__flag": F.coalesce(F.col("scope_balanced").cast("string"), F.lit(ANY))})
        self.heads = self.plans.groupBy("plan_id", "category_field", "__scope", "__flag").agg(F.max("sample_share").alias("sample_share"))
        kind = lambda columns: F.element_at(F.create_map(*(x for f in fields for x in (F.lit(f), F.coalesce(F.col(columns[f]) if columns.get(f) else F.lit(""), F.lit(""))))), F.col("category_field"))
        category = F.element_at(F.create_map(*(x for f in fields for x in (F.lit(f), F.col(f)))), F.col("category_field"))
        columns = sorted({*fields, *parents.values(), *leaves.values()})
        self.records = records.select("record", "scope", "flag", *columns)
        self._described = [category.alias("category"), kind(parents).alias("parent"), kind(leaves).alias("leaf")]
        self._fields = ["scope", "flag", *columns]
        self._kept: dict[str, DataFrame] = {}

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A small aggregate that several results need, written once."""
        if name not in self._kept:
            self._kept[name] = cut(make())
        return self._kept[name]

    @property
    def supply(self) -> DataFrame:
        """(plan_id, category, parent, leaf, n): the leaves of the category tree with their records."""

        def make() -> DataFrame:
            cube = self.records.groupBy(*self._fields).agg(F.count("*").alias("n"))
            return self._in_scope(cube).groupBy("plan_id", "category", "parent", "leaf").agg(F.sum("n").alias("n"))

        return self._once("supply", make)

    def _in_scope(self, rows: DataFrame) -> DataFrame:
        """Rows once for each plan whose scope they are in; by equality, as a row is in few kinds of scope."""
        scopes = F.array_compact(F.array(F.lit(ANY), F.col("scope")))
        flags = F.array_compact(F.array(F.lit(ANY), F.col("flag").cast("string")))
        rows = rows.withColumn("__scope", F.explode(scopes)).withColumn("__flag", F.explode(flags))
        return rows.join(self.heads, ["__scope", "__flag"]).select("plan_id", *self._described, *(c for c in ("record", "n") if c in rows.columns))

    def allocation(self) -> DataFrame:
        """Each target through the steps of the allocation, from the top of the tree down.

        A category first draws its demand from its own leaves (``own``, the sum of what `fill`
        takes there) and hands on what they can't give (``handed_on``): to its siblings' records,
        in proportion to their targets (``from_kin`` is what a category gives for others), and
        what these can't take to its cousins'. Written once: the report, the draw and the unmet
        targets all read it.
        """
        return self._once("allocation", self._allocated)

    def _allocated(self) -> DataFrame:
        scoped = self.supply.groupBy("plan_id").agg(F.sum("n").alias("in_scope"))
        known = self.supply.filter("category is not null")
        have = known.groupBy("plan_id", "category").agg(F.sum("n").alias("available"), F.max_by("parent", F.struct("n", "parent")).alias("parent"))
        t = self.plans.join(scoped, "plan_id", "left").join(have, ["plan_id", "category"], "left")
        t = t.withColumns({"available": F.coalesce("available", F.lit(0)), "in_scope": F.coalesce("in_scope", F.lit(0)), "parent": F.coalesce("parent", F.lit(""))})
        t = t.withColumn("size", F.floor(F.col("sample_share") * F.col("in_scope")).cast("bigint"))
        t = t.withColumn("demand", F.greatest(F.col("min_rows").cast("bigint"), F.floor(F.col("target_share") * F.col("size")).cast("bigint")))
        leaves = known.groupBy("plan_id", "category", "leaf").agg(F.sum("n").alias("n"))
        at_leaves = leaves.join(t.groupBy("plan_id", "category").agg(F.max("demand").alias("demand")), ["plan_id", "category"])
        own = fill(at_leaves, ["plan_id", "category"], "demand", "n", "n", "leaf", "take").groupBy("plan_id", "category").agg(F.sum("take").alias("own"))
        t = t.join(own, ["plan_id", "category"], "left").withColumn("own", F.least(F.coalesce("own", F.lit(0)), F.col("demand")))
        t = t.withColumn("handed_on", F.col("demand") - F.col("own"))
        for near, got, groups in (("own", "kin", ["plan_id", "parent"]), ("kin", "allotted", ["plan_id"])):
            w = W.partitionBy(*groups)
            t = t.withColumn("__lack", F.sum(F.col("demand")).over(w) - F.sum(near).over(w)).withColumn("__room", F.col("available") - F.col(near))
            t = t.withColumn("__lack", F.greatest("__lack", F.lit(0)))
            t = fill(t, groups, "__lack", "__room", "target_share", "category", "__more").withColumn(got, F.col(near) + F.col("__more"))
        whole = W.partitionBy("plan_id")
        reached = F.col("allotted") / F.nullif(F.sum("allotted").over(whole), F.lit(0))
        return t.select(
            "plan_id", "category", "target_share", "in_scope", "size", "demand", "available", "own", "handed_on", (F.col("allotted") - F.col("own")).alias("from_kin"),
            "allotted", F.sum("allotted").over(whole).alias("sample_rows"), reached.alias("reached_share"),
        )

    def report(self) -> DataFrame:
        """Demand, supply and allotted rows of each target; ``missing`` is what the target lacks.

        ``sample_rows`` is the whole sample of the plan: floors leave it up to a row a category
        below ``size``, minima may take it above.
        """
        return self.allocation().select("plan_id", "category", "target_share", "in_scope", "size", "demand", "available", "allotted", "sample_rows", "reached_share", F.col("handed_on").alias("missing"))

    def unmet(self) -> DataFrame:
        """The targets whose category handed quota on, as its own leaves couldn't give it."""
        return self.allocation().filter("handed_on > 0").select("plan_id", "category")

    def draw(self) -> DataFrame:
        """(plan_id, category, record): the sample. A category's leaves give in proportion to their records."""
        leaves = self.supply.filter("category is not null").groupBy("plan_id", "category", "leaf").agg(F.sum("n").alias("n"))
        parts = leaves.join(self.allocation().select("plan_id", "category", "allotted"), ["plan_id", "category"])
        parts = fill(parts, ["plan_id", "category"], "allotted", "n", "n", "leaf", "take").select("plan_id", "category", "leaf", "take")
        rows = self._in_scope(self.records).filter("category is not null").join(parts, ["plan_id", "category", "leaf"])
        rows = rows.filter("take > 0").withColumn("__order", priority(self.seed, "record"))
        ranked = weight_before(rows, ["plan_id", "category", "leaf"], "__order", "record", F.lit(1))
        return ranked.filter(F.col("before") < F.col("take")).select("plan_id", "category", "record")


def distinct_records(df: DataFrame, record: str, columns: list[Column], names: list[str]) -> DataFrame:
    """One row for each non-null record; of differing rows the smallest."""
    slim = df.select(F.col(record).alias("record"), F.struct(*(c.alias(n) for c, n in zip(columns, names, strict=True))).alias("x"))
    return slim.filter("record is not null").groupBy("record").agg(F.min("x").alias("x")).select("record", "x.*")
