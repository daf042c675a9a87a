"""Closed forms against the loops they replace."""

import random

import pytest
from pyspark.sql import functions as F

from gleanery.operators import allocate
from gleanery.operators.ordering import before_by_hash, before_by_sort


def water(supply, budget):
    """Even allocation by giving one at a time, in rounds by key."""
    left = dict(supply)
    got = dict.fromkeys(supply, 0)
    budget = min(budget, sum(supply.values()))
    while budget:
        for k in sorted(left):
            if left[k] and budget and got[k] == min(got[x] for x in left if left[x]):
                left[k] -= 1
                got[k] += 1
                budget -= 1
    return got


@pytest.mark.parametrize(
    ("supply", "budget", "want"),
    [
        ({"wpldd": 1642, "suhas": 718, "kiran": 128}, 1341, {"suhas": 607, "wpldd": 606, "kiran": 128}),
        ({"wpldd": 1545, "suhas": 620, "hg": 101, "kiran": 122}, 1341, {"wpldd": 559, "suhas": 559, "hg": 101, "kiran": 122}),
    ],
)
def test_golden_allocations(spark, supply, budget, want):
    df = spark.createDataFrame([("c", k, n) for k, n in supply.items()], "g string, k string, n long")
    got = {r["k"]: r["selected"] for r in allocate.even_allocation(df, ["g"], "k", "n", F.lit(budget)).collect()}
    assert sorted(got.values()) == sorted(want.values()) and got["kiran"] == want["kiran"]
    assert got == water(supply, budget)


def test_even_allocation_like_rounds(spark):
    rng = random.Random(1)
    cases = {g: ({str(k): rng.randrange(0, 15) for k in range(rng.randrange(1, 7))}, rng.randrange(0, 50)) for g in range(150)}
    rows = [(g, k, n, b) for g, (s, b) in cases.items() for k, n in s.items()]
    df = spark.createDataFrame(rows, "g int, k string, n long, b long")
    got = {(r["g"], r["k"]): r["selected"] for r in allocate.even_allocation(df, ["g"], "k", "n", F.col("b")).collect()}
    for g, (s, b) in cases.items():
        assert {k: got[g, k] for k in s} == water(s, b), (s, b)


def test_stride_takes_as_many_as_asked(spark):
    rows = [(f"{n}-{k}", r, n, k) for n in range(1, 25) for k in range(n + 2) for r in range(n)]
    df = spark.createDataFrame(rows, "g string, r long, n long, k long")
    kept = df.filter(allocate.stride_kept(F.col("r"), F.col("k"), F.col("n"))).groupBy("g").agg(F.count("*").alias("c"), F.min("r").alias("lo")).collect()
    got = {r["g"]: r["c"] for r in kept}
    for n in range(1, 25):
        for k in range(n + 2):
            assert got.get(f"{n}-{k}", 0) == min(n, k)


def test_largest_remainder_sums_up(spark):
    df = spark.createDataFrame([("a", "x", 1 / 3), ("a", "y", 1 / 3), ("a", "z", 1 / 3), ("b", "x", 0.5), ("b", "y", 0.5)], "g string, k string, s double")
    got = {(r["g"], r["k"]): r["seats"] for r in allocate.largest_remainder(df, ["g"], "k", F.col("s"), F.lit(100)).collect()}
    assert got == {("a", "x"): 34, ("a", "y"): 33, ("a", "z"): 33, ("b", "x"): 50, ("b", "y"): 50}


def test_greedy_split_like_the_loop(spark):
    rng = random.Random(2)
    rows = [(f"s{s}", f"g{s}-{k}", rng.choice([1, 1, 1, 2, 5, 9])) for s in range(20) for k in range(rng.randrange(1, 40))]
    df = spark.createDataFrame(rows, "stratum string, grp string, n long")
    out = {r["grp"]: r["split"] for r in allocate.greedy_split(df, ["stratum"], "grp", "n", 0.125, 0.125).collect()}
    import hashlib

    for s in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == s]
        total = sum(r[2] for r in mine)

        def turn(r):
            v = int(hashlib.sha256(f"42|{r[0]}|{r[1]}".encode()).hexdigest()[:16], 16)
            return (v - (1 << 64) if v >= 1 << 63 else v, r[1])

        test = validation = 0
        for r in sorted(mine, key=turn):
            if test < 0.125 * total:
                want, test = "test", test + r[2]
            elif validation < 0.125 * total:
                want, validation = "validation", validation + r[2]
            else:
                want = "train"
            assert out[r[1]] == want


def test_sampling_plan(spark):
    df = spark.createDataFrame([("Rare", "a", 100), ("Common", "a", 5000), ("Common", "b", 5000)], "class_name string, source string, available long")
    rows = allocate.sampling_plan(df, 3.0).collect()
    assert {r["cap"] for r in rows} == {300}
    assert {(r["class_name"], r["source"]): r["selected"] for r in rows} == {("Rare", "a"): 100, ("Common", "a"): 150, ("Common", "b"): 150}


def test_running_sums_of_a_hot_group(spark):
    rng = random.Random(3)
    rows = [("hot" if k % 3 else f"g{k % 7}", rng.getrandbits(63) - (1 << 62), k, rng.randrange(5)) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, o long, id long, w long")
    for got, key in ((before_by_hash(df, ["g"], "o", "id", F.col("w")), lambda r: (r[1], r[2])), (before_by_sort(df, ["g"], ["id"], F.col("w")), lambda r: r[2])):
        have = {r["id"]: r["before"] for r in got.collect()}
        sums = {}
        for r in sorted(rows, key=key):
            assert have[r[2]] == sums.get(r[0], 0)
            sums[r[0]] = sums.get(r[0], 0) + r[3]
    assert before_by_sort(df.limit(0), ["g"], ["id"], F.col("w")).collect() == []
