"""Connected components by hash-to-min, for links of any number.

Each vertex keeps a cluster, at first itself and its neighbours. In a round it sends the cluster
to the cluster's minimum and the minimum to every member, until nothing changes; then the
minimum holds the whole component and every other vertex just the minimum. A cluster is kept
as rows (vertex, member), never as one value, so that a component of any size is spread
over tasks. Components that are done leave the rounds. Minima are those of a scrambled order: in
the order of their numbers a path's clusters grow with its square.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.runtime import cut


def _scrambled(x: Column) -> Column:
    """A one-to-one map of 64-bit numbers that leaves no order of theirs."""
    for step in (lambda v: F.shiftleft(v, 13), lambda v: F.shiftrightunsigned(v, 7), lambda v: F.shiftleft(v, 17)):
        x = x.bitwiseXOR(step(x))
    return x


def _restored(df: DataFrame, column: str) -> DataFrame:
    """Undoes `_scrambled`: each step's inverse is the sum of its powers."""
    for shift, by in ((F.shiftleft, 17), (F.shiftrightunsigned, 7), (F.shiftleft, 13)):
        x = F.col(column)
        df = df.withColumn(column, reduce(lambda s, k: s.bitwiseXOR(shift(x, k)), range(by, 64, by), x))  # noqa: B023
    return df


def hash_to_min(links: DataFrame, a: str, b: str, max_rounds: int = 100) -> DataFrame:
    """(vertex, component): each linked vertex with the smallest vertex of its component.

    `links` may hold either order, repeats, self links and nulls; self links and links with a
    null end link nothing. Vertices without links don't come out; no links give no rows.
    Other columns are ignored. Raises if `max_rounds` rounds (enough for a path of over
    2**50 vertices) don't reach the end.
    """
    number = not isinstance(links.schema[a].dataType, T.StringType)
    there = _scrambled if number else lambda c: F.concat(F.substring(F.md5(c), 1, 8), c)
    one = links.select(F.col(a).alias("vertex"), F.col(b).alias("member")).filter("vertex <> member")
    one = one.select(*(there(F.col(c).cast("bigint") if number else F.col(c)).alias(c) for c in ("vertex", "member")))
    both = one.union(one.select("member", "vertex"))
    clusters = cut(both.union(both.select("vertex", "vertex")).distinct())
    finished = []
    for _ in range(max_rounds):
        least = clusters.groupBy("vertex").agg(F.min("member").alias("least"))
        others = least.select(F.col("vertex").alias("member"), F.col("least").alias("its_least"))
        known = cut(clusters.join(least, "vertex").join(others, "member"))
        # A component is done if its rows are a star around its minimum and no row leads out.
        astray = known.filter("least <> its_least or (vertex <> least and member <> least)")
        going = cut(astray.select(F.explode(F.array("least", "its_least")).alias("least")).distinct())
        finished.append(known.join(going, "least", "left_anti").filter("vertex = least").select(F.col("member").alias("vertex"), F.col("least").alias("component")))
        if going.isEmpty():
            done = reduce(DataFrame.union, finished)
            done = _restored(done, "vertex").withColumn("vertex", F.col("vertex").cast(links.schema[a].dataType)) if number else done.withColumn("vertex", F.substr("vertex", F.lit(9)))
            names = done.groupBy("component").agg(F.min("vertex").alias("name"))
            return done.join(names, "component").select("vertex", F.col("name").alias("component"))
        sent = known.join(going, "least", "left_semi").select("member", "least")
        to = F.explode(
            F.array(
                F.struct(F.col("least").alias("vertex"), F.col("member").alias("member")),
                F.struct(F.col("member").alias("vertex"), F.col("least").alias("member")),
            )
        )
        clusters = cut(sent.select(to.alias("x")).select("x.*").distinct())
    raise RuntimeError(f"components not stable after {max_rounds} rounds")


def match_groups(pairs: DataFrame, records: DataFrame, a: str, b: str, record: str, limit: int = 5, distance: str = "distance") -> DataFrame:
    """(group, record) of each record that a valid pair links to another, directly or not.

    A pair is valid if its ends differ, both are among `records` and the distance is known and
    at most `limit`. The group is its smallest record, which comes out with itself too.
    """
    known = records.select(F.col(record).alias("__id")).filter("__id is not null").distinct()
    found = pairs.select(F.col(a).alias("__a"), F.col(b).alias("__b"), F.col(distance).alias("__d")).filter(f"__d <= {int(limit)} and __a <> __b")
    found = found.select(F.least("__a", "__b").alias("__a"), F.greatest("__a", "__b").alias("__b")).distinct()
    for end in ("__a", "__b"):
        found = found.join(known.withColumnRenamed("__id", end), end, "left_semi")
    groups = hash_to_min(found, "__a", "__b")
    return groups.select(F.col("component").alias("group"), F.col("vertex").alias("record"))
