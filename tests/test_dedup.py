"""The planted corpus of several sources, end to end, and tampering."""

import random

import pytest
from pyspark.sql import functions as F

from gleanery.operators import allocate, dedup, graph, hamming, verify
from gleanery.operators.hamming import near_pairs

ROW = "image_id long, class_name string, source string, family string, source_path string, sha256 string, original_sha256 string, phash string, rank int, converted string, staged_name string"


def flip(h, *bits):
    x = int(h, 16)
    for b in bits:
        x ^= 1 << b
    return f"{x:064x}"


def corpus():
    rng = random.Random(7)
    rows, at = [], {}
    rank = {"alpha": 0, "beta": 1, "gamma": 2}
    family = {"alpha": "alpha", "beta": "alpha", "gamma": "gamma"}

    def add(source, label, name, sha=None, h=None):
        h = h or f"{rng.getrandbits(256):064x}"
        sha = sha or f"{rng.getrandbits(256):064x}"
        at[source, name] = (sha, h)
        k = len(rows)
        rows.append((k, label, source, family[source], f"{label}/{name}.jpg", sha, None, h, rank[source], None, f"{source}__{label}__{name}.jpg"))

    for k in range(40):
        add("alpha", "Healthy", f"h{k:03}")
        add("alpha", "Brown Rust", f"b{k:03}")
    for k in range(31):
        add("alpha", "Powdery Mildew", f"p{k:03}")
    add("alpha", "Healthy", "h_dup", *at["alpha", "h000"])
    triple = f"{rng.getrandbits(256):064x}"
    for k in range(3):
        add("alpha", "Healthy", f"t{k + 1}", h=flip(triple, 2 * k, 2 * k + 1))
    for k in range(4):
        add("beta", "Healthy", f"copy{k}", h=flip(at["alpha", f"h{k + 1:03}"][1], 5, 9 + k))
    add("beta", "Healthy", "exact", *at["alpha", "h010"])
    for k in range(8):
        add("beta", "Healthy", f"new{k}")
    for k in range(6):
        add("beta", "Brown Rust", f"bb{k}")
    for k in range(12):
        add("gamma", "Yellow Rust", f"y{k}")
    for k in range(10):
        add("gamma", "Healthy", f"gh{k}")
        add("gamma", "Brown Rust", f"gb{k}")
    add("gamma", "Healthy", "conflict")
    add("gamma", "Brown Rust", "conflict", *at["gamma", "conflict"])
    return rows


@pytest.fixture(scope="module")
def pipeline(spark):
    pool = spark.createDataFrame(corpus(), ROW).withColumn("uid", dedup.uid())
    kept, copies = dedup.keep_first(pool, ["class_name", "sha256"], ["rank", "source_path"], "uid")
    kept, conflicts = dedup.label_conflicts(kept, "sha256", "class_name")
    kept, family = dedup.drop_family_copies(kept, "image_id", "phash", "rank")
    return kept.cache(), copies.collect(), conflicts.collect(), family.collect()


def names(rows):
    return {r["source_path"].split("/")[1][:-4] for r in rows}


def test_removals(pipeline):
    kept, copies, conflicts, family = pipeline
    assert names(copies) == {"h_dup", "exact"} and all(r["kept_instead"].startswith("alpha/") for r in copies)
    assert names(conflicts) == {"conflict"} and len(conflicts) == 2
    assert names(family) == {f"copy{k}" for k in range(4)} and {r["reason"] for r in family} == {"near_duplicate_of_alpha"}
    assert {r["class_name"]: r["n"] for r in kept.groupBy("class_name").agg(F.count("*").alias("n")).collect()} == {"Healthy": 61, "Brown Rust": 56, "Powdery Mildew": 31, "Yellow Rust": 12}


def test_groups_split_and_checks(spark, pipeline):
    kept = pipeline[0]
    comp = graph.connected_components(near_pairs(kept, None, "image_id", "phash"), "a_id", "b_id")
    assert comp.count() == 3
    x = kept.join(comp.withColumnRenamed("node", "image_id"), "image_id", "left").withColumn("group_id", F.coalesce("component", "image_id"))
    assert tuple(graph.group_counts(x, "group_id", "class_name").first()) == (1, 3, 0)
    groups = x.groupBy("group_id").agg(F.count("*").alias("n"), F.min_by("class_name", "image_id").alias("k"))
    assigned = allocate.greedy_split(groups, ["k"], "group_id", "n", 0.125, 0.125).select("group_id", "split")
    done = x.join(assigned, "group_id").withColumn("in_balanced", F.lit(True)).cache()
    assert {r[0] for r in done.select("split").distinct().collect()} == {"train", "validation", "test"}
    none = spark.createDataFrame([], "file string, sha256 string, phash string")
    assert verify.verdict(verify.checks(done, none)).first()["passed"]
    moved = done.withColumn("split", F.when(F.col("source_path") == "Healthy/t1.jpg", F.when(F.col("split") == "train", "test").otherwise("train")).otherwise(F.col("split")))
    failed = {r["name"] for r in verify.checks(moved, none).collect() if not r["passed"]}
    assert failed == {"group_straddles_splits", "near_straddles_splits"}
    one = done.filter("source_path = 'Healthy/h005.jpg'").select(F.lit("ext.jpg").alias("file"), "sha256", "phash")
    failed = {r["name"] for r in verify.checks(done, one).collect() if not r["passed"]}
    assert failed == {"held_out_exact", "held_out_near"}
    rest, removed = dedup.drop_held_out(done, one, "image_id", ["sha256", "original_sha256"], "phash")
    assert [r["detail"] for r in removed.collect()] == ["exact ext.jpg"] and rest.count() == done.count() - 1


@pytest.mark.parametrize("hot", [2000, 2])
def test_banding_is_exact(spark, monkeypatch, hot):
    monkeypatch.setattr(hamming, "HOT_BAND", hot)  # 2: nearly every shared band is cut again
    rng = random.Random(5)
    hashes = [f"{rng.getrandbits(256):064x}" for _ in range(60)]
    hashes += [flip(rng.choice(hashes), *rng.sample(range(256), rng.randrange(0, 9))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(hashes)) + [(999, None), (1000, "ff")], "id long, h string")
    first = {}
    for k, h in enumerate(hashes):
        first.setdefault(h, k)
    reps = sorted(first.values())
    apart = lambda i, j: (int(hashes[i], 16) ^ int(hashes[j], 16)).bit_count()
    want = {(i, j, apart(i, j)) for i in reps for j in reps if i < j and apart(i, j) <= 5}
    got = [(r["a_id"], r["b_id"], r["distance"]) for r in near_pairs(df, None, "id", "h").collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert {r["id"]: r["representative"] for r in hamming.members(df, "id", "h").collect()} == {k: first[h] for k, h in enumerate(hashes)} | {1000: 1000}
    linked = {r["node"]: r["component"] for r in graph.connected_components(hamming.near_links(df, "id", "h"), "a_id", "b_id").collect()}
    for i in range(len(hashes)):
        for j in range(i):
            if apart(i, j) <= 5:
                assert linked[i] == linked[j]


def test_copies_make_no_pairs(spark):
    df = spark.createDataFrame([(k, "ab" * 32) for k in range(5000)], "id long, h string")
    assert near_pairs(df, None, "id", "h").count() == 0
    assert hamming.near_links(df, "id", "h").count() == 4999


def test_components_of_a_path(spark):
    rng = random.Random(6)
    nodes = list(range(200))
    rng.shuffle(nodes)
    df = spark.createDataFrame(list(zip(nodes, nodes[1:])), "a long, b long")
    got = graph.connected_components(df, "a", "b").collect()
    assert len(got) == 200 and {r["component"] for r in got} == {0}
    assert graph.connected_components(df.limit(0), "a", "b").collect() == []


def test_numbers(spark):
    df = spark.createDataFrame([(5, 30), (6, 10), (7, 30), (8, 20)], "id long, c long")
    assert {r["id"]: r["number"] for r in graph.number_groups(df, "c", "number").collect()} == {6: 0, 8: 1, 5: 2, 7: 2}


def test_difference(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "k string")
    b = spark.createDataFrame([("x",), ("z",), (None,)], "k string")
    assert sorted(tuple(r) for r in verify.difference(a, b, ["k"]).collect()) == [("x", "left", 1), ("y", "left", 1), ("z", "right", 1)]


def test_file_checks(spark):
    png, webp = bytes.fromhex("89504E470D0A1A0A00000000"), b"RIFF0000WEBP"
    good = [("train/a", "a.png", "train", "1", png), ("train/b", "aug__0__a.png", "train", "2", png), ("test/c", "c.png", "test", "3", png)]
    kind = "path string, staged_name string, split string, sha256 string, content binary"
    manifest = spark.createDataFrame([("train/a", "1", False), ("train/b", "2", True), ("test/c", "3", None)], "path string, sha256 string, augmented boolean")
    run = lambda rows: verify.file_checks(spark.createDataFrame(rows, kind), manifest, content="content")
    assert verify.verdict(run(good)).first()["passed"]
    bad = [good[0], ("train/b", "aug__0__a.png", "validation", "2", png), ("test/c", "aug__c.png", "test", "9", webp), ("test/d", "d.png", "test", None, png)]
    got = {r["name"]: r["violations"] for r in run(bad).collect()}
    assert got == {"augmented_outside_train": 2, "content_differs": 2, "reserved_prefix": 1, "webp_content": 1, "not_on_disk": 0, "not_in_manifest": 1}


def test_build_checks(spark):
    kind = "id long, staged_name string, sha256 string, split string, in_balanced boolean"
    rows = [(1, "a", "1", "train", True), (2, "b", "2", "test", False), (3, "c", "3", None, False), (4, "aug__d", "4", "test", False)]
    manifest = spark.createDataFrame(rows, kind)
    run = lambda p, f, b: {r["name"]: r["violations"] for r in verify.build_checks(manifest, *(spark.createDataFrame(x, kind) for x in (p, f, b)), "id").collect()}
    good = run(rows, [rows[0], rows[1], rows[3]], rows[:1])
    assert {k for k, n in good.items() if n} == {"augmented_outside_train", "reserved_prefix"}
    bad = run([(1, "a", "9", "train", True), rows[1], rows[3]], rows[:1], [(1, "a", "1", "test", True), rows[1]])
    assert bad["pool_differs"] == 1 and bad["full_differs"] == 2 and bad["balanced_differs"] == 1 and bad["balanced_not_in_full"] == 2 and bad["content_differs"] == 1


def test_hashes_of_every_length_and_dense_balls(spark, monkeypatch):
    from gleanery.operators import hamming

    monkeypatch.setattr(hamming, "HOT_BAND", 30)
    rng = random.Random(17)
    flip = lambda h, bits: f"{int(h, 16) ^ sum(1 << b for b in rng.sample(range(4 * len(h)), bits)):0{len(h)}x}"
    hashes = []
    for n in (3, 16, 64, 100):
        centre = f"{rng.getrandbits(4 * n):0{n}x}"
        hashes += [flip(centre, rng.randrange(0, 6)) for _ in range(60)] + [f"{rng.getrandbits(4 * n):0{n}x}" for _ in range(20)]
    df = spark.createDataFrame([(k, h) for k, h in enumerate([*hashes, None])], "id long, h string")
    first: dict = {}
    for k, h in enumerate(hashes):
        first.setdefault(h, k)
    own = sorted(first.items(), key=lambda x: x[1])
    want = {(a, b) for x, a in own for y, b in own if a < b and len(x) == len(y) and (int(x, 16) ^ int(y, 16)).bit_count() <= 5}
    assert {(r["a_id"], r["b_id"]) for r in near_pairs(df, None, "id", "h").collect()} == want
