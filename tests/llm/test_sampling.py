import random

from pyspark.sql import functions as F

from gleanery.llm.sampling import TargetSample, distinct_records, fill

PLAN = "plan_id int, category_field string, scope_split string, scope_balanced boolean, sample_share double, category string, target_share double, min_rows int"
RECORD = "record long, scope string, flag boolean, class_name string, source string, family string, extra string"


def make(spark, records, plans):
    r = spark.createDataFrame(records, RECORD)
    p = spark.createDataFrame(plans, PLAN)
    return TargetSample(r, p, {"source": "family"}, {"class_name": "source", "source": "class_name"})


def records():
    rng = random.Random(2)
    out = []
    for k in range(3000):
        c = "big" if k % 3 == 0 else rng.choice(["big", "mid", "mid", "low"]) if k % 50 else "rare"
        s = rng.choice(["s1", "s1", "s1", "s2", "s3"])
        out.append((k, rng.choice(["train", "test", None]), rng.choice([True, False, None]), c, s, "f1" if s != "s3" else "f2", None))
    return out + [(9001, "train", True, None, None, None, None)]


def test_fill_spends_all_and_keeps_proportions(spark):
    rng = random.Random(4)
    cases = [(g, k, rng.randrange(0, 40), rng.choice([0.0, 1.0, 2.0, 0.5]), rng.randrange(0, 120)) for g in range(60) for k in range(rng.randrange(1, 7))]
    amount = {g: a for g, _, _, _, a in cases}
    df = spark.createDataFrame([(g, str(k), room, w, amount[g]) for g, k, room, w, _ in cases], "g int, k string, room long, w double, amount long")
    got = fill(df, ["g"], "amount", "room", "w", "k", "took").collect()
    for g in amount:
        mine = [r for r in got if r["g"] == g]
        assert sum(r["took"] for r in mine) == min(amount[g], sum(r["room"] for r in mine))
        assert all(0 <= r["took"] <= r["room"] for r in mine)
        open_rates = [r["took"] / r["w"] for r in mine if r["took"] < r["room"] and r["w"] > 0]
        if len(open_rates) > 1:
            assert max(open_rates) - min(open_rates) <= 2 / min(r["w"] for r in mine if r["w"] > 0) + 1e-9


def test_unmet_targets_and_shares(spark):
    rows = records()
    plans = [(1, "class_name", None, None, 0.5, c, s, m) for c, s, m in (("big", 0.4, 5), ("mid", 0.3, 5), ("low", 0.2, 5), ("rare", 0.1, 5), ("gone", 0.0, 3))]
    plans += [(2, "source", "train", True, 0.3, c, s, None) for c, s in (("s1", 0.2), ("s2", 0.7), ("s3", 0.1))]
    plans += [(None, "source", None, None, 0.3, "s1", 0.5, 1), (3, "source", None, None, 0.3, None, 0.5, 1)]
    sample = make(spark, rows, plans)
    n1 = len(rows)
    scope2 = [r for r in rows if r[1] == "train" and r[2] is True]
    want = set()
    for p in plans[:8]:
        scope, at = (rows, 3) if p[0] == 1 else (scope2, 4)
        need = max(p[7] or 0, int(p[6] * int(p[4] * (n1 if p[0] == 1 else len(scope2)))))
        if need > sum(r[at] == p[5] for r in scope):
            want.add((p[0], p[5]))
    assert {tuple(r) for r in sample.unmet().collect()} == want and (1, "gone") in want
    report = {(r["plan_id"], r["category"]): r for r in sample.report().collect()}
    drawn = sample.draw().collect()
    assert len(drawn) == len({(r["plan_id"], r["record"]) for r in drawn})
    by_id = {r[0]: r for r in rows}
    for (plan, category), r in report.items():
        mine = [x for x in drawn if x["plan_id"] == plan and x["category"] == category]
        assert len(mine) == r["allotted"] <= r["available"]
        assert all(by_id[x["record"]][3 if plan == 1 else 4] == category for x in mine)
        if plan == 2:
            assert all(by_id[x["record"]] in scope2 for x in mine)
    for plan in (1, 2):
        rs = [r for (p, _), r in report.items() if p == plan]
        assert sum(r["allotted"] for r in rs) == min(sum(r["demand"] for r in rs), sum(r["available"] for r in rs))


def test_siblings_before_cousins(spark):
    rows = [(k, None, None, "c", s, f, None) for k, (s, f) in enumerate([("small", "f1")] * 2 + [("sib", "f1")] * 50 + [("far", "f2")] * 50)]
    plans = [(1, "source", None, None, 0.3, c, s, 0) for c, s in (("small", 0.5), ("sib", 0.2), ("far", 0.3))]
    r = {x["category"]: x for x in make(spark, rows, plans).report().collect()}
    assert r["small"]["allotted"] == 2 and r["small"]["missing"] == 13
    assert r["far"]["allotted"] == 9 and r["sib"]["allotted"] == 6 + 13


def test_empty_and_repeated(spark):
    none = make(spark, [], [(1, "source", None, None, 0.5, "s1", 0.5, 3)])
    assert [tuple(x) for x in none.unmet().collect()] == [(1, "s1")] and none.draw().collect() == []
    assert make(spark, records()[:10], []).report().collect() == []
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, None)], "image long, c string")
    got = sorted(tuple(r) for r in distinct_records(df, "image", [F.col("c")], ["x"]).collect())
    assert got == [(1, "a"), (2, None)]


def test_cases_come_out_of_the_allocation(spark):
    rows = records()
    plans = [(1, "class_name", None, None, 0.5, c, s, 5) for c, s in (("big", 0.4), ("low", 0.6), ("gone", 0.1))]
    sample = make(spark, rows, plans)
    steps = {r["category"]: r for r in sample.allocation().collect()}
    for c, r in steps.items():
        assert r["own"] == min(r["demand"], r["available"]) and r["handed_on"] == r["demand"] - r["own"], c
    assert steps["big"]["from_kin"] == min(steps["low"]["handed_on"] + steps["gone"]["handed_on"], steps["big"]["available"] - steps["big"]["own"])
    assert {r[1] for r in sample.unmet().collect()} == {c for c, r in steps.items() if r["handed_on"]} == {"low", "gone"}
    assert len({r["sample_rows"] for r in sample.report().collect()}) == 1
    assert len(sample._kept) == 2  # supply and allocation are written once for all results
