import random
from itertools import product

from gleanery.llm import mixing
from gleanery.llm.mixing import SourceMix, route

DOC = "doc long, source string, text_key string, tokens long, extra string"
TARGET = "mix_id int, total_share double, source string, target_share double, max_repeats int"


def cheapest(texts, rows, quotas, repeats):
    """Least cost of meeting all that can be met, by trying every whole flow (small cases)."""
    keys = [(p, s) for p, s in rows if s in quotas]
    best = None
    for flow in product(*(range(repeats[s] * rows[p, s] + 1) for p, s in keys)):
        per = {s: sum(f for (p, q), f in zip(keys, flow) if q == s) for s in quotas}
        if any(per[s] > quotas[s] for s in quotas):
            continue
        cost = 0
        for p in texts:
            used = sum(f for (q, s), f in zip(keys, flow) if q == p)
            level = 1
            while used > 0:
                cost += level * min(used, texts[p])
                used -= texts[p]
                level += 1
        key = (-sum(per.values()), cost)
        best = key if best is None or key < best else best
    return best


def test_flow_is_cheapest():
    rng = random.Random(7)
    a, b, ab = frozenset("a"), frozenset("b"), frozenset("ab")
    for _ in range(25):
        rows = {(a, "a"): rng.randrange(1, 3), (b, "b"): rng.randrange(1, 3), (ab, "a"): rng.randrange(1, 3), (ab, "b"): rng.randrange(1, 3)}
        texts = {a: rows[a, "a"], b: rows[b, "b"], ab: min(rows[ab, "a"], rows[ab, "b"])}
        quotas = {"a": rng.randrange(0, 7), "b": rng.randrange(0, 7)}
        repeats = {"a": rng.randrange(1, 3), "b": 1}
        flow = route(texts, rows, quotas, repeats)
        total, cost = sum(flow.values()), 0
        for p in texts:
            used, level = sum(f for (q, _), f in flow.items() if q == p), 1
            while used > 0:
                cost += level * min(used, texts[p])
                used -= texts[p]
                level += 1
        assert (-total, cost) == cheapest(texts, rows, quotas, repeats)


def documents():
    rng = random.Random(1)
    out = [(k, rng.choice(["a", "a", "a", "b", "c", None]), f"t{k}", rng.randrange(1, 60), "x") for k in range(2000)]
    out += [(5000 + k, "b", f"t{k}", out[k][3], "x") for k in range(0, 200, 2)]  # texts of other sources again
    out += [(9000, "a", None, 0, "x"), (9001, "a", "t1", out[1][3], "x")]
    return out


def test_shares_and_caps(spark):
    docs = documents()
    total = sum(d[3] for d in docs)
    have = {s: sum(d[3] for d in docs if d[1] == s) for s in "abc"}
    targets = [(1, 0.5, "a", 0.5, 1), (1, 0.5, "b", 0.3, 2), (1, 0.5, "c", 0.1, 1), (1, 0.5, "gone", 0.1, 3), (2, 1.2, "b", 1.0, 2), (2, 1.2, None, 0.5, 1)]
    mix = SourceMix(spark, spark.createDataFrame(docs, DOC), spark.createDataFrame(targets, TARGET))
    want = {(m, s) for m, t, s, p, r in targets if s and r * have.get(s, 0) < p * t * total}
    assert {tuple(x) for x in mix.unmet().collect()} == want and (1, "gone") in want
    drawn = mix.draw().collect()
    assert len({(r["mix_id"], r["doc"]) for r in drawn}) == len(drawn)
    caps = {(m, s): r for m, _, s, _, r in targets}
    assert all(1 <= r["repeats"] <= caps[r["mix_id"], r["source"]] for r in drawn)
    for x in mix.shares().collect():
        aim = min(x["quota"], x["capacity"])
        assert abs(x["reached"] - aim) <= 60, x


def test_empty(spark):
    mix = SourceMix(spark, spark.createDataFrame([], DOC), spark.createDataFrame([(1, 1.0, "a", 1.0, 2)], TARGET))
    assert mix.unmet().collect() == [] and mix.draw().collect() == []
    mix = SourceMix(spark, spark.createDataFrame(documents()[:5], DOC), spark.createDataFrame([], TARGET))
    assert mix.draw().collect() == [] and mix.shares().collect() == []


def test_many_patterns_keep_their_overlap(spark):
    rng = random.Random(4)
    docs = [(k, "a", f"own{k}", 40, "x") for k in range(500)]
    rows = set()
    for k in range(2000):  # texts that a and b share, in over 5,000 (pattern, source) rows
        held = ["a", "b", *(f"x{j}" for j in range(12) if rng.random() < 0.5)]
        rows.update((tuple(held), s) for s in held)
        docs += [(1000 + 20 * k + j, s, f"both{k}", 10, "x") for j, s in enumerate(held)]
    assert len(rows) > 5000
    share = 40_000 / sum(d[3] for d in docs)
    mix = SourceMix(spark, spark.createDataFrame(docs, DOC), spark.createDataFrame([(1, share, "a", 0.5, 1), (1, share, "b", 0.5, 1)], TARGET))
    drawn = mix.draw().collect()
    # Both quotas can be met without a second use of any text: a's by its own, b's by the shared ones.
    assert {r["doc"] for r in drawn if r["source"] == "a"} <= set(range(500))
    assert all(abs(sum(r["tokens"] * r["repeats"] for r in drawn if r["source"] == s) - 20_000) <= 20 for s in "ab")


def test_flow_over_many_patterns():
    rng = random.Random(5)
    names = [f"s{k}" for k in range(20)]
    texts = {tuple(sorted(rng.sample(names, rng.randrange(1, 8)))): rng.randrange(50, 500) for _ in range(8000)}
    rows = {(p, s): n for p, n in texts.items() for s in p}
    quota = sum(texts.values()) // 20
    flow = route(texts, rows, dict.fromkeys(names, quota), dict.fromkeys(names, 1))
    assert sum(flow.values()) == 20 * quota
    assert all(sum(flow.get((p, s), 0) for s in p) <= n for p, n in texts.items())  # no text twice


def test_levels_beyond_the_linear_ones_are_all_there():
    one, many = ("a",), 10**6
    flow = route({one: 10}, {(one, "a"): 10}, {"a": 10 * many + 5}, {"a": many})
    assert flow == {(one, "a"): 10 * many}


def test_unmet_comes_out_of_the_flow(spark, monkeypatch):
    solved = []
    plain = mixing.route
    monkeypatch.setattr(mixing, "route", lambda *a: solved.append(a) or plain(*a))
    docs = documents()
    total = sum(d[3] for d in docs)
    have = {s: sum(d[3] for d in docs if d[1] == s) for s in "abc"}
    exact = have["c"] / total  # all that c has, to the token
    targets = [(1, 1.0, "c", exact, 1), (2, 1.0, "c", exact * 1.0001, 1), (3, 1.0, "b", 0.0, 1), (3, 1.0, "a", 0.9, 1)]
    mix = SourceMix(spark, spark.createDataFrame(docs, DOC), spark.createDataFrame(targets, TARGET))
    assert sorted(tuple(x) for x in mix.unmet().collect()) == sorted((m, s) for m, t, s, p, r in targets if r * have[s] < p * t * total)
    assert len(solved) == 3
    mix.draw().count()
    assert len(solved) == 3  # the same flow
