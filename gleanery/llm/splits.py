"""Splits that keep records with a common key together, in target proportions by stratum."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.components import hash_to_min
from gleanery.runtime import cut

#: A component of at least this share of its stratum is drawn before the rest.
LARGE_SHARE = 0.01
MAX_SPLITS = 1000


def _as_numbers(df: DataFrame, keys: list[str]) -> bool:
    """Whether the values of all keys are whole numbers that leave room for the number of their key."""
    whole = ("tinyint", "smallint", "int", "bigint")
    if any(df.schema[k].dataType.simpleString() not in whole for k in keys):
        return False
    room = (1 << 63) // len(keys) - 1
    lo, hi = df.agg(F.least(*(F.min(k) for k in (*keys, keys[0]))), F.greatest(*(F.max(k) for k in (*keys, keys[0])))).first()
    return lo is None or (-room <= lo and hi <= room)


def components(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``component``: the same for all rows that share a non-null value of any key, directly
    or through other rows. A column of that name is replaced.

    Each value of each key is a vertex; a row links the values it holds, and is itself named by
    its first value that isn't null. All links go through hash-to-min. Rows without any value
    belong to no component (null). A component is named by one of its values: a number if
    all keys are whole numbers, else text.
    """
    df = df.drop("component", "__node")
    numbers = _as_numbers(df, keys)
    nodes = []
    for k, key in enumerate(keys):
        value = F.col(key).cast("bigint") * len(keys) + k if numbers else F.concat(F.lit(f"{key}:"), F.col(key).cast("string"))
        nodes.append(F.when(F.col(key).isNotNull(), value))
    named = df.withColumn("__node", F.coalesce(*nodes))
    if len(nodes) == 1:
        return named.withColumnRenamed("__node", "component")
    ends = F.array(*(F.struct(F.col("__node").alias("a"), n.alias("b")) for n in nodes[1:]))
    links = named.select(F.explode(ends).alias("e")).select("e.*").filter("a <> b").distinct()
    labels = hash_to_min(links, "a", "b").select(F.col("vertex").alias("__node"), "component")
    return named.join(labels, "__node", "left").withColumn("component", F.coalesce("component", "__node")).drop("__node")


def _rendezvous(seed: int, names: list[str], weights: list[Column]) -> Column:
    """The name that wins a weighted draw by hashes of the component; null if no weight is positive."""
    scores = []
    for name, weight in zip(names, weights, strict=True):
        h = F.xxhash64(F.lit(seed), F.col("component"), F.lit(name))
        u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)
        scores.append(F.when(weight > 0, F.struct((-F.log(u) / weight).alias("score"), F.lit(name).alias("name"))))
    return F.array_min(F.array_compact(F.array(*scores)))["name"]


def split_shares(targets: DataFrame, name: str, share: str) -> list[tuple[str, float]]:
    """The (name, share) of every target; more than `MAX_SPLITS` are an error."""
    rows = targets.select(name, share).limit(MAX_SPLITS + 1).collect()
    if len(rows) > MAX_SPLITS:
        raise ValueError(f"more than {MAX_SPLITS} splits")
    return sorted((r[0], float(r[1])) for r in rows)


def grouped_split(df: DataFrame, record: str, keys: list[str], strata: list[str], targets: list[tuple[str, float]], seed: int = 42, earlier: DataFrame | None = None) -> DataFrame:
    """Rows of `df` with ``component`` and ``assigned``, the split of the component.

    A component belongs to the stratum of its smallest record. With `earlier` (`record`,
    ``assigned``: what an earlier call gave and was kept), a component that holds a record of it
    stays where most of these records are (of equals the least name), so that new rows move none
    of the old ones. Components without are drawn by rendezvous: those of `LARGE_SHARE` of
    their stratum or more first, each among the splits it leaves within their targets (if none,
    the largest), then the others with what is left of the targets as weights. Shares are
    so met even where few components hold most rows.

    Rows without any key value get no split; null strata are a stratum of their own. Columns of
    the two new names are replaced. No rows give no rows.
    """
    if not 0 < len(targets) <= MAX_SPLITS:
        raise ValueError(f"between 1 and {MAX_SPLITS} splits are needed")
    names, shares = [n for n, _ in targets], [float(s) for _, s in targets]
    placed = components(df.drop("assigned"), keys)
    slim = placed.select("component", F.col(record).alias("r"), *(F.coalesce(F.col(s), F.lit("")).alias(f"s{k}") for k, s in enumerate(strata)), F.lit("").alias("whole"))
    slim = slim.filter("component is not null")
    stratum = [f"s{k}" for k in range(len(strata))] or ["whole"]
    counted = [F.count("*").alias("n"), F.min(F.struct("r", *stratum)).alias("m")]
    if earlier is not None:
        old = earlier.groupBy(F.col(record).alias("r")).agg(F.min("assigned").alias("old"))
        slim = slim.join(old, "r", "left")
        counted += [F.count_if(F.col("old") == n).alias(f"o{k}") for k, n in enumerate(names)]
    sizes = slim.groupBy("component").agg(*counted)
    votes = F.array(*(F.struct((-F.col(f"o{k}")).alias("o"), F.lit(n).alias("name")) for k, n in enumerate(names))) if earlier is not None else None
    kept = F.lit(None).cast("string") if votes is None else F.when(F.array_min(votes)["o"] < 0, F.array_min(votes)["name"])
    sizes = cut(sizes.select("component", "n", kept.alias("assigned"), *(F.col(f"m.{s}").alias(s) for s in stratum)))
    sizes = sizes.join(sizes.groupBy(*stratum).agg(F.sum("n").alias("total")), stratum)

    def left_of(done: DataFrame) -> list[Column]:
        """Adds what components of `done` took of each stratum; the targets less that."""
        nonlocal sizes
        had = [F.sum(F.when(F.col("assigned") == n, F.col("n")).otherwise(0)).alias(f"t{k}") for k, n in enumerate(names)]
        sizes = sizes.drop(*(f"t{k}" for k in range(len(names)))).join(done.groupBy(*stratum).agg(*had), stratum, "left")
        return [F.greatest(F.lit(0.0), F.lit(s) * F.col("total") - F.coalesce(F.col(f"t{k}"), F.lit(0))) for k, s in enumerate(shares)]

    is_large = F.col("assigned").isNull() & (F.col("n") >= F.greatest(F.lit(2), LARGE_SHARE * F.col("total")))
    left = left_of(sizes.filter("assigned is not null")) if earlier is not None else [F.lit(s) * F.col("total") for s in shares]
    fitting = _rendezvous(seed, names, [F.when(x >= F.col("n"), x) for x in left])
    roomiest = F.array_max(F.array(*(F.struct(x.cast("double").alias("x"), F.lit(n).alias("name")) for n, x in zip(names, left))))["name"]
    sizes = cut(sizes.withColumn("assigned", F.when(is_large, F.coalesce(fitting, roomiest)).otherwise(F.col("assigned"))))
    left = left_of(sizes.filter("assigned is not null"))
    drawn = F.coalesce("assigned", _rendezvous(seed, names, left), _rendezvous(seed, names, [F.lit(s) for s in shares]))
    result = sizes.select("component", drawn.alias("assigned"))
    return placed.join(result, "component", "left")


def split_conflicts(placed: DataFrame, key: str, recorded: str) -> DataFrame:
    """The values of `key` that the recorded splits cut up: some of their rows are recorded off the
    split their component was assigned, and off others of the same value."""
    each = placed.filter(F.col(key).isNotNull() & F.col(recorded).isNotNull())
    moved = F.count_if(F.col(recorded) != F.col("assigned"))
    found = each.groupBy("component", key).agg(moved.alias("moved"), F.min(recorded).alias("lo"), F.max(recorded).alias("hi"))
    return found.filter("moved > 0 and lo <> hi").select(key)


def reached_shares(placed: DataFrame, strata: list[str]) -> DataFrame:
    """Rows and share of each split within each stratum."""
    counts = placed.filter("assigned is not null").groupBy(*strata, "assigned").agg(F.count("*").alias("n"))
    totals = counts.groupBy(*(F.col(s).alias(f"__{s}") for s in strata)).agg(F.sum("n").alias("total"))
    same = reduce(lambda x, y: x & y, [F.col(s).eqNullSafe(F.col(f"__{s}")) for s in strata])
    return counts.join(totals, same).select(*strata, "assigned", "n", (F.col("n") / F.col("total")).alias("share"))
