"""Splits, allocation and balanced selection over the image pool."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.operators import allocate
from gleanery.plans.registry import query
from gleanery.plans.tables import SQL_POOL, pool

W_POOL = "WITH " + SQL_POOL
SEED = 42
RATIO = 3.0
#: Budget, as a share of a class's images, of the allocation queries.
BUDGET = 0.4

_SUPPLY = W_POOL + ", supply AS (SELECT class_name, source, count(*) AS available FROM pool WHERE class_name IS NOT NULL AND source IS NOT NULL GROUP BY ALL)"
_EVEN = """SELECT *, rank() OVER (PARTITION BY class_name ORDER BY used DESC, source) AS turn2 FROM (SELECT *, CASE WHEN smaller + available * left_n <= b THEN 1 ELSE 0 END AS used FROM
    (SELECT *, coalesce(sum(available) OVER (PARTITION BY class_name ORDER BY available, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS smaller,
    count(*) OVER (PARTITION BY class_name) - row_number() OVER (PARTITION BY class_name ORDER BY available, source) + 1 AS left_n,
    least(budget, sum(available) OVER (PARTITION BY class_name)) AS b FROM {0}))"""
_EVEN_SELECTED = """SELECT class_name, source, available, (CASE WHEN used = 1 THEN available ELSE rest // greatest(open_n, 1) + CASE WHEN turn <= rest % greatest(open_n, 1) THEN 1 ELSE 0 END END)::BIGINT AS selected{1} FROM
    (SELECT *, b - coalesce(sum(CASE WHEN used = 1 THEN available END) OVER (PARTITION BY class_name), 0) AS rest, count(*) FILTER (used = 0) OVER (PARTITION BY class_name) AS open_n, row_number() OVER (PARTITION BY class_name ORDER BY used, source) AS turn FROM (""" + _EVEN + "))"


def _supply(spark: SparkSession, d: str) -> DataFrame:
    return pool(spark, d, "class_name", "source").filter("class_name is not null and source is not null").groupBy("class_name", "source").agg(F.count("*").alias("available"))


@query(_SUPPLY + f", bs AS (SELECT *, floor(sum(available) OVER (PARTITION BY class_name) * {BUDGET})::BIGINT AS budget FROM supply) " + _EVEN_SELECTED.format("bs", ""))
def even_allocation(spark: SparkSession, d: str) -> DataFrame:
    x = _supply(spark, d).withColumn("budget", F.floor(F.sum("available").over(W.partitionBy("class_name")) * BUDGET).cast("bigint"))
    return allocate.even_allocation(x, ["class_name"], "source", "available", F.col("budget")).drop("budget")


@query(_SUPPLY + f", t AS (SELECT *, sum(available) OVER (PARTITION BY class_name) AS total FROM supply), bs AS (SELECT class_name, source, available, floor(min(total) OVER () * {RATIO})::BIGINT AS budget FROM t) " + _EVEN_SELECTED.format("bs", ", budget AS cap"))
def sampling_plan(spark: SparkSession, d: str) -> DataFrame:
    return allocate.sampling_plan(_supply(spark, d), RATIO)


@query(W_POOL + """, c AS (SELECT class_name, split, count(*) AS n FROM pool WHERE class_name IS NOT NULL AND split IS NOT NULL GROUP BY ALL),
    s AS (SELECT *, n / sum(n) OVER (PARTITION BY class_name) * 100 AS exact FROM c), f AS (SELECT *, floor(exact)::BIGINT AS fl, 100 - sum(floor(exact)) OVER (PARTITION BY class_name) AS short FROM s),
    k AS (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY round(exact - fl, 9) DESC, split) AS turn FROM f) SELECT class_name, split, n, fl + CASE WHEN turn <= short THEN 1 ELSE 0 END AS seats FROM k""")
def largest_remainder(spark: SparkSession, d: str) -> DataFrame:
    counts = pool(spark, d, "class_name", "split").filter("class_name is not null and split is not null").groupBy("class_name", "split").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy("class_name"))
    return allocate.largest_remainder(counts.withColumn("share", share), ["class_name"], "split", F.col("share"), F.lit(100)).drop("share")


_STRIDE = "(k >= n OR (2 * k * (r + 1) + n - 1) // (2 * n) > (2 * k * r + n - 1) // (2 * n))"


@query(W_POOL + f", r AS (SELECT image_id, class_name, row_number() OVER (PARTITION BY class_name ORDER BY image_id) - 1 AS r, count(*) OVER (PARTITION BY class_name) AS n FROM pool WHERE class_name IS NOT NULL), t AS (SELECT *, floor(n * {BUDGET})::BIGINT AS k FROM r) SELECT image_id, class_name FROM t WHERE {_STRIDE}")
def stride_select(spark: SparkSession, d: str) -> DataFrame:
    p = pool(spark, d, "class_name").filter("class_name is not null").select("image_id", "class_name")
    sizes = p.groupBy("class_name").agg(F.count("*").alias("n")).withColumn("k", F.floor(F.col("n") * BUDGET).cast("bigint"))
    return allocate.stride_select(p.join(sizes, "class_name"), ["class_name"], "image_id", "k", "n").select("image_id", "class_name")


_GROUPS = W_POOL + """, members AS (SELECT *, CASE WHEN group_id >= 0 THEN 'g' || group_id ELSE 'i' || image_id END AS grp FROM pool),
    anchors AS (SELECT grp, count(*) AS n, arg_min(class_name, image_id) AS class_name, arg_min(coalesce(class_name, ''), image_id) AS k1, arg_min(coalesce(family, ''), image_id) AS k2 FROM members GROUP BY grp),
    o AS (SELECT *, ('0x' || substr(sha256(concat_ws('|', '42', k1, k2, grp)), 1, 16))::UBIGINT AS u FROM anchors),
    q AS (SELECT *, CASE WHEN u >= 9223372036854775808 THEN (u::HUGEINT - 18446744073709551616)::BIGINT ELSE u::BIGINT END AS ord FROM o),
    b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY k1, k2 ORDER BY ord, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY k1, k2) AS total FROM q),
    t AS (SELECT *, sum(CASE WHEN before < 0.125::DOUBLE * total THEN n ELSE 0 END) OVER (PARTITION BY k1, k2) AS tested FROM b),
    assigned AS (SELECT grp, n, k1, k2, CASE WHEN before < 0.125::DOUBLE * total THEN 'test' WHEN before - tested < 0.125::DOUBLE * total THEN 'validation' ELSE 'train' END AS split FROM t)"""


def _assigned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    grp = F.when(F.col("group_id") >= 0, F.concat(F.lit("g"), "group_id")).otherwise(F.concat(F.lit("i"), "image_id"))
    members = pool(spark, d, "group_id", "class_name", "family").withColumn("grp", grp)
    first = lambda c: F.min_by(F.coalesce(c, F.lit("")), "image_id")
    groups = members.groupBy("grp").agg(F.count("*").alias("n"), first("class_name").alias("k1"), first("family").alias("k2"))
    return members, allocate.greedy_split(groups, ["k1", "k2"], "grp", "n", 0.125, 0.125, SEED)


@query(_GROUPS + " SELECT image_id, a.split FROM members m JOIN assigned a USING (grp)")
def group_split(spark: SparkSession, d: str) -> DataFrame:
    members, assigned = _assigned(spark, d)
    return members.drop("split").join(assigned.select("grp", "split"), "grp").select("image_id", "split")


@query(_GROUPS + " SELECT k1 AS class_name, k2 AS family, split, count(*) AS groups, sum(n)::BIGINT AS images FROM assigned GROUP BY ALL")
def group_split_counts(spark: SparkSession, d: str) -> DataFrame:
    _, assigned = _assigned(spark, d)
    return assigned.groupBy(F.col("k1").alias("class_name"), F.col("k2").alias("family"), "split").agg(F.count("*").alias("groups"), F.sum("n").alias("images"))


_BALANCED = (
    W_POOL
    + f""", p AS (SELECT image_id, class_name, split, coalesce(family, '') AS family FROM pool WHERE class_name IS NOT NULL AND split IS NOT NULL),
    c AS (SELECT class_name, split, count(*) AS n FROM p GROUP BY ALL), ct AS (SELECT *, sum(n) OVER (PARTITION BY class_name) AS total FROM c),
    cc AS (SELECT *, least(total, floor(min(total) OVER () * {RATIO}))::BIGINT AS cap FROM ct), ex AS (SELECT *, n / total * cap AS exact FROM cc),
    fl AS (SELECT *, floor(exact)::BIGINT AS f, cap - sum(floor(exact)) OVER (PARTITION BY class_name) AS short FROM ex),
    seats AS (SELECT class_name, split, f + CASE WHEN row_number() OVER (PARTITION BY class_name ORDER BY round(exact - f, 9) DESC, split) <= short THEN 1 ELSE 0 END AS seats FROM fl),
    fam AS (SELECT class_name || '|' || split AS class_name, family AS source, count(*) AS available, any_value(seats) AS budget FROM p JOIN seats USING (class_name, split) GROUP BY ALL),
    sel AS ("""
    + _EVEN_SELECTED.format("fam", "")
    + f"""), r AS (SELECT image_id, p.class_name, split, family, selected AS k, row_number() OVER (PARTITION BY p.class_name, split, family ORDER BY image_id) - 1 AS r, count(*) OVER (PARTITION BY p.class_name, split, family) AS n
    FROM p JOIN sel ON sel.class_name = p.class_name || '|' || split AND sel.source = family) SELECT image_id, class_name, split, family FROM r WHERE k > 0 AND {_STRIDE}"""
)


@query(_BALANCED)
def balanced_nested(spark: SparkSession, d: str) -> DataFrame:
    """Cap by class, remainders over splits, even over families, strides within a family."""
    p = pool(spark, d, "class_name", "split", "family").filter("class_name is not null and split is not null").select("image_id", "class_name", "split", F.coalesce("family", F.lit("")).alias("family"))
    cells = p.groupBy("class_name", "split", "family").agg(F.count("*").alias("available"))
    c = cells.groupBy("class_name", "split").agg(F.sum("available").alias("n"))
    c = c.withColumn("total", F.sum("n").over(W.partitionBy("class_name")))
    c = c.withColumn("cap", F.least("total", F.floor(F.min("total").over(W.partitionBy()) * RATIO)).cast("bigint"))
    seats = allocate.largest_remainder(c, ["class_name"], "split", F.col("n") / F.col("total"), F.col("cap")).select("class_name", "split", "seats")
    take = allocate.even_allocation(cells.join(seats, ["class_name", "split"]), ["class_name", "split"], "family", "available", F.col("seats"), "take")
    rows = p.join(take.filter("take > 0").select("class_name", "split", "family", "take", "available"), ["class_name", "split", "family"])
    return allocate.stride_select(rows, ["class_name", "split", "family"], "image_id", "take", "available").select("image_id", "class_name", "split", "family")


@query(W_POOL + """, o AS (SELECT image_id, staged_name, ('0x' || substr(sha256('42|' || image_id), 1, 16))::UBIGINT AS u FROM pool WHERE class_name = 'Brown Rust'),
    s AS (SELECT image_id, staged_name, CASE WHEN u >= 9223372036854775808 THEN (u::HUGEINT - 18446744073709551616)::BIGINT ELSE u::BIGINT END AS ord FROM o) SELECT image_id, staged_name FROM s ORDER BY ord, image_id LIMIT 60""")
def audit_sample(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample of 60 images of one class, by stable priority."""
    order = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(SEED)), "image_id"), 256), 1, 16), 16, -10).cast("bigint")
    return pool(spark, d, "staged_name", "class_name").filter("class_name = 'Brown Rust'").orderBy(order, "image_id").limit(60).select("image_id", "staged_name")


@query(W_POOL + ", k AS (SELECT image_id, source, image_id % 7 + 1 AS w, sum(image_id % 7 + 1) OVER (PARTITION BY source ORDER BY image_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM pool) SELECT image_id, source, coalesce(b, 0)::BIGINT AS before FROM k")
def running_weight(spark: SparkSession, d: str) -> DataFrame:
    """Running sums within sources by image, as the allocation operators use them."""
    from gleanery.operators.ordering import before_by_sort

    return before_by_sort(pool(spark, d, "source").select("image_id", "source"), ["source"], ["image_id"], F.col("image_id") % 7 + 1).select("image_id", "source", "before")




@query(W_POOL + f""", t AS (SELECT class_name, count(*) AS total FROM pool WHERE class_name IS NOT NULL AND source IS NOT NULL GROUP BY class_name), c AS (SELECT *, floor(min(total) OVER () * {RATIO})::BIGINT AS cap FROM t)
    SELECT (SELECT class_name FROM t ORDER BY total, class_name LIMIT 1) AS binding_class, any_value(cap) AS cap, round(max(total) / min(total), 10) AS imbalance_before, round(max(least(total, cap)) / min(least(total, cap)), 10) AS imbalance_after FROM c""")
def sampling_limits(spark: SparkSession, d: str) -> DataFrame:
    """The class that sets the cap (of equals the first name), and the imbalance before and after sampling."""
    x = allocate.sampling_limits(_supply(spark, d), RATIO)
    return x.withColumns({c: F.round(c, 10) for c in ("imbalance_before", "imbalance_after")})


_BY_CLASS = _GROUPS.replace("coalesce(family, '')", "''").replace("concat_ws('|', '42', k1, k2, grp)", "concat_ws('|', '42', k1, grp)").replace("PARTITION BY k1, k2", "PARTITION BY k1")


@query(_BY_CLASS + " SELECT k1 AS class_name, split, count(*) AS groups, sum(n)::BIGINT AS images FROM assigned GROUP BY ALL")
def class_split_counts(spark: SparkSession, d: str) -> DataFrame:
    """The split by class alone."""
    grp = F.when(F.col("group_id") >= 0, F.concat(F.lit("g"), "group_id")).otherwise(F.concat(F.lit("i"), "image_id"))
    members = pool(spark, d, "group_id", "class_name").withColumn("grp", grp)
    groups = members.groupBy("grp").agg(F.count("*").alias("n"), F.min_by(F.coalesce("class_name", F.lit("")), "image_id").alias("k1"))
    assigned = allocate.greedy_split(groups, ["k1"], "grp", "n", 0.125, 0.125, SEED)
    return assigned.groupBy(F.col("k1").alias("class_name"), "split").agg(F.count("*").alias("groups"), F.sum("n").alias("images"))
