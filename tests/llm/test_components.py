import os
import random

import pytest
from pyspark.sql import functions as F

from gleanery.llm.components import _restored, _scrambled, hash_to_min, match_groups
from gleanery.llm import queries, splits
from gleanery.llm.splits import MAX_SPLITS, components, grouped_split, split_conflicts, split_shares

DATA = "/root/testdata/sf0.001"


def union_find(pairs):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        ra, rb = root(a), root(b)
        up[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in up}


def test_random_graphs_paths_and_stars(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)]
    pairs += [(1000 + k, 1001 + k) for k in range(64)]  # a path
    pairs += [(2999, 2000 + k) for k in range(400)]  # a star around its largest vertex
    pairs += [(5, 5), (7, 3), (3, 7), (3, 7)]
    df = spark.createDataFrame([(a, b, "x") for a, b in pairs] + [(None, 1, "x"), (1, None, "x")], "a long, b long, vertex string")
    got = {r["vertex"]: r["component"] for r in hash_to_min(df, "a", "b").collect()}
    assert got == union_find([(a, b) for a, b in pairs if a != b])


def test_scrambling_is_one_to_one(spark):
    ids = [0, 1, -1, 5, 2**63 - 1, -(2**63), *range(10**9, 10**9 + 500)]
    df = spark.createDataFrame([(k,) for k in ids], "k long").withColumn("x", _scrambled(F.col("k")))
    rows = _restored(df, "x").collect()
    assert all(r["x"] == r["k"] for r in rows) and df.select("x").distinct().count() == len(ids)


def test_types_of_vertices(spark):
    for kind, values in (("int", [(1, 2), (2, 3)]), ("string", [("x", "y"), ("y", "b:z")])):
        got = {r["vertex"]: r["component"] for r in hash_to_min(spark.createDataFrame(values, f"a {kind}, b {kind}"), "a", "b").collect()}
        low = min(v for p in values for v in p)
        assert got == {v: low for p in values for v in p}


def test_no_links(spark):
    empty = spark.createDataFrame([], "a long, b long")
    assert hash_to_min(empty, "a", "b").collect() == []
    assert hash_to_min(spark.createDataFrame([(1, 1)], "a long, b long"), "a", "b").collect() == []


def test_matches_count_only_if_valid(spark):
    pairs = spark.createDataFrame([(1, 2, 3), (2, 1, 9), (2, 3, 5), (3, 4, 6), (5, 6, None), (7, 99, 1), (8, 8, 0), (None, 8, 1)], "a long, b long, distance int")
    known = spark.createDataFrame([(k,) for k in [1, 2, 3, 4, 5, 6, 7, 8, 8, None]], "id long")
    got = sorted(tuple(r) for r in match_groups(pairs, known, "a", "b", "id").collect())
    assert got == [(1, 1), (1, 2), (1, 3)]


ROWS = "id long, author string, entity string, kind string, component string, assigned string"


def test_shared_keys_link_rows(spark):
    rows = [(1, "a", "x", "k"), (2, "a", "y", "k"), (3, "b", "y", None), (4, None, "y", "k"), (5, "c", None, "k"), (6, None, None, "k"), (7, None, "z", "k"), (8, "d", "z", "k")]
    df = spark.createDataFrame([(*r, "old", "old") for r in rows], ROWS)
    got = {r["id"]: r["component"] for r in components(df, ["author", "entity"]).collect()}
    assert got[1] == got[2] == got[3] == got[4]
    assert got[7] == got[8] != got[1]
    assert got[5] not in (got[1], got[7], None) and got[6] is None


TARGETS = [("train", 0.75), ("validation", 0.125), ("test", 0.125)]


def grouped_rows(rng, groups, start=0, name="g"):
    rows = []
    for g in range(groups):
        for _ in range(400 if g == 0 else 90 if g < 4 else rng.choice([1, 1, 1, 2, 3, 8])):
            k = start + len(rows)
            rows.append((k, f"{name}{g}", f"e{k}", "ab"[g % 2], None, None))
    return rows


def test_split_keeps_components_and_meets_shares(spark):
    rows = grouped_rows(random.Random(1), 1500)
    df = spark.createDataFrame(rows, ROWS)
    out = grouped_split(df, "id", ["author", "entity"], ["kind"], TARGETS)
    got = out.collect()
    assert len(got) == len(rows) and {r["assigned"] for r in got} == {"train", "validation", "test"}
    split_of = {}
    assert all(split_of.setdefault(r["author"], r["assigned"]) == r["assigned"] for r in got)
    for kind in "ab":
        mine = [r["assigned"] for r in got if r["kind"] == kind]
        assert all(abs(mine.count(n) / len(mine) - s) < 0.03 for n, s in TARGETS)
    again = {r["id"]: r["assigned"] for r in grouped_split(df, "id", ["author", "entity"], ["kind"], TARGETS).collect()}
    assert again == {r["id"]: r["assigned"] for r in got}


def test_new_rows_move_no_earlier_component(spark):
    rng = random.Random(5)
    rows = grouped_rows(rng, 400)
    first = grouped_split(spark.createDataFrame(rows, ROWS), "id", ["author", "entity"], ["kind"], TARGETS).select("id", "assigned")
    old = {r["id"]: r["assigned"] for r in first.collect()}
    more = rows + grouped_rows(rng, 900, 50_000, "n") + [(90_000 + k, f"g{k}", f"e{90_000 + k}", "ab"[k % 2], None, None) for k in range(300)]
    earlier = spark.createDataFrame([*old.items(), (None, "train"), (rows[0][0], old[rows[0][0]])], "id long, assigned string")
    out = grouped_split(spark.createDataFrame(more, ROWS), "id", ["author", "entity"], ["kind"], TARGETS, earlier=earlier).collect()
    now = {r["id"]: r["assigned"] for r in out}
    assert len(out) == len(more) and all(now[k] == s for k, s in old.items())
    assert all(now[90_000 + k] == now[next(r[0] for r in rows if r[1] == f"g{k}")] for k in range(300))
    for kind in "ab":
        mine = [r["assigned"] for r in out if r["kind"] == kind]
        assert all(abs(mine.count(n) / len(mine) - s) < 0.03 for n, s in TARGETS)


def test_conflicts_and_empty(spark):
    df = spark.createDataFrame([(1, "a", None, None, None, None), (2, "a", None, None, None, None), (3, "b", None, None, None, None), (4, "c", None, None, None, None), (5, "c", None, None, None, None)], ROWS)
    out = grouped_split(df, "id", ["author"], [], [("train", 0.5), ("test", 0.5)])
    recorded = spark.createDataFrame([(1, "train"), (2, "test"), (3, None), (4, "validation"), (5, "validation")], "id long, recorded string")
    assert [r[0] for r in split_conflicts(out.join(recorded, "id"), "author", "recorded").collect()] == ["a"]
    assert grouped_split(df.limit(0), "id", ["author", "entity"], ["kind"], [("train", 1.0)]).collect() == []


def test_numbers_and_too_many_splits(spark):
    rows = [(1, 7, 1), (2, 7, 2), (3, 8, 2), (4, None, 4), (5, 9, None), (6, -3, 6), (7, -3, 7)]
    df = spark.createDataFrame(rows, "id long, a long, b int")
    got = {r["id"]: r["component"] for r in components(df, ["a", "b"]).collect()}
    assert got[1] == got[2] == got[3] and got[6] == got[7] and len({got[k] for k in (1, 4, 5, 6)}) == 4
    large = spark.createDataFrame([(1, 2**62, 1), (2, 2**62, 2)], "id long, a long, b int")
    assert len({r["component"] for r in components(large, ["a", "b"]).collect()}) == 1
    many = spark.createDataFrame([(f"s{k}", 0.1) for k in range(MAX_SPLITS + 1)], "split_name string, target_share double")
    with pytest.raises(ValueError, match="splits"):
        split_shares(many, "split_name", "target_share")
    assert split_shares(many.limit(2), "split_name", "target_share")[0][1] == 0.1


def test_queries_run_the_method(spark, monkeypatch):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    calls = []
    plain = splits.hash_to_min
    monkeypatch.setattr(splits, "hash_to_min", lambda *a, **k: calls.append(a) or plain(*a, **k))
    found = queries.p3_found(spark, DATA)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert calls and "assigned" in plan
