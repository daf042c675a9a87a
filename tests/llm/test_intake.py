"""The check of batches against a loop over all rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gleanery.llm import intake
from gleanery.llm.intake import FingerprintIndex, check_batch, fingerprints

ROW = "id long, batch int, sha string, other string, phash string, key string, kind string"


def canonical(v):
    t = re.sub("^0x", "", re.sub(r"[\s:\-]+", "", (v or "").lower()))
    return t if re.fullmatch("[0-9a-f]+", t) else None


def prints(row):
    return {canonical(row[2]), canonical(row[3])} - {None}, canonical(row[4])


def match(a, b):
    (sa, pa), (sb, pb) = a, b
    if sa & sb:
        return True
    return bool(pa and pb and len(pa) == len(pb) and (int(pa, 16) ^ int(pb, 16)).bit_count() <= 5)


def expected(history, batch):
    known, cases = [prints(r) for r in history], set()
    for r in sorted(batch, key=lambda r: (r[1] is None, r[1] or 0, r[0])):
        p = prints(r)
        if any(match(p, k) for k in known):
            cases.add(r[0])
        else:
            known.append(p)
    return cases


def near(rng, h, bits):
    x = int(h, 16)
    for b in rng.sample(range(4 * len(h)), bits):
        x ^= 1 << b
    return f"{x:0{len(h)}x}"


def dirty(rng, h):
    return rng.choice([h, h.upper(), "0x" + h, "-".join(h[k : k + 8] for k in range(0, len(h), 8)), f" {h} ", h[:8] + ":" + h[8:]])


def rows(rng, n, start, earlier):
    out = []
    for k in range(n):
        h = f"{rng.getrandbits(256):064x}"
        kind = rng.random()
        sha = f"{rng.getrandbits(256):064x}"
        if earlier + out and kind < 0.55:
            o = rng.choice((earlier + out)[-80:])
            if canonical(o[4]):
                h = near(rng, canonical(o[4]), rng.randrange(0, 8))
            if kind < 0.1 and canonical(o[2]):
                sha, h = canonical(o[2]), h if kind < 0.05 else None
        elif kind < 0.63:
            h = f"{rng.getrandbits(64):016x}"
        elif kind < 0.65:
            h, sha = f"{rng.getrandbits(512):0128x}", f"{rng.getrandbits(512):0128x}"
        elif kind < 0.7:
            h, sha = None, rng.choice([None, "", "  "])
        elif kind < 0.72:
            h = "not hex"
        out.append((start + k, rng.randrange(1, 4), dirty(rng, sha) if sha else sha, None, dirty(rng, h) if h else h, "x", "y"))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("hot", [2000, 2])
def test_like_a_loop(spark, monkeypatch, hot):
    monkeypatch.setattr(intake, "HOT_KEY", hot)  # 2: nearly every shared band is cut and spread
    monkeypatch.setattr(intake, "RANGE_ROWS", 200_000 if hot > 2 else 20)
    monkeypatch.setattr(intake, "BUCKET_KEYS", 400_000 if hot > 2 else 500)  # appends build the index anew
    rng = random.Random(hot)
    history = rows(rng, 150, 0, [])
    batch = rows(rng, 250, 1000, history)
    batch += [(r[0] + 5000, *r[1:]) for r in batch[:20]] + [(7000, None, batch[0][2], None, None, "x", "y")]
    index = FingerprintIndex(spark).create(fingerprints(spark.createDataFrame(history, ROW), [], ["sha", "other"], "phash"))
    got = {r[0] for r in check_batch(index, spark.createDataFrame(batch, ROW), "id", ["batch", "id"], ["sha", "other"], "phash").collect()}
    assert got == expected(history, batch)
    # A later batch meets what was accepted before, also in the index as another session opens it.
    index = FingerprintIndex.open(spark, index.folder)
    later = rows(rng, 120, 20000, batch)
    accepted = [r for r in batch if r[0] not in got]
    got = {r[0] for r in check_batch(index, spark.createDataFrame(later, ROW), "id", ["batch", "id"], ["sha", "other"], "phash").collect()}
    assert got == expected(history + accepted, later)
    known = history + accepted + [r for r in later if r[0] not in got]
    for r in rows(rng, 6, 30000, later):  # a batch of one row reads few buckets
        one = spark.createDataFrame([r], ROW)
        assert [x[0] for x in check_batch(index, one, "id", ["batch", "id"], ["sha", "other"], "phash", accept=False).collect()] == list(expected(known, [r]))
    index.drop()


def test_chains_take_turns(spark):
    base = 0
    chain = []
    for k in range(12):  # each four bits from the one before, eight from the one before that
        chain.append((k, 1, None, None, f"{base:064x}", "x", "y"))
        base ^= 0b1111 << (4 * k)
    index = FingerprintIndex(spark).create(fingerprints(spark.createDataFrame([], ROW), [], ["sha"], "phash"))
    got = {r[0] for r in check_batch(index, spark.createDataFrame(chain, ROW), "id", ["batch", "id"], ["sha"], "phash").collect()}
    assert got == expected([], chain) == set(range(1, 12, 2))


def test_many_copies_and_empty_batch(spark):
    index = FingerprintIndex(spark).create(fingerprints(spark.createDataFrame([], ROW), [], ["sha"], "phash"))
    copies = [(k, 1, "ab" * 32, None, "0" * 64, "x", "y") for k in range(500)]
    got = {r[0] for r in check_batch(index, spark.createDataFrame(copies, ROW), "id", ["batch", "id"], ["sha"], "phash").collect()}
    assert got == set(range(1, 500))
    assert check_batch(index, spark.createDataFrame([], ROW), "id", ["batch", "id"], ["sha"], "phash").collect() == []


def test_lengths_new_to_the_index(spark):
    rng = random.Random(8)
    index = FingerprintIndex(spark).create(fingerprints(spark.createDataFrame(rows(rng, 20, 0, []), ROW), [], ["sha"], "phash"))
    lengths = [1, 5, 8, 32, 40, 63]
    first = {n: f"{rng.getrandbits(4 * n):0{n}x}" for n in lengths}
    row = lambda k, h: (k, 1, None, None, h, "x", "y")
    batch = [row(1000 + n, h) for n, h in first.items()] + [row(2000 + n, near(rng, h, min(n, 5))) for n, h in first.items()]
    batch += [row(3000, near(rng, first[32], 6))]
    got = {r[0] for r in check_batch(index, spark.createDataFrame(batch, ROW), "id", ["batch", "id"], ["sha"], "phash").collect()}
    assert got == expected([], batch) == {2000 + n for n in lengths}
    index = FingerprintIndex.open(spark, index.folder)  # what was accepted is known to later sessions
    later = [row(5000 + n, near(rng, h, 1)) for n, h in first.items()] + [row(6000, "ab" * 14)]
    got = {r[0] for r in check_batch(index, spark.createDataFrame(later, ROW), "id", ["batch", "id"], ["sha"], "phash", accept=False).collect()}
    assert got == {5000 + n for n in lengths}
    index.drop()


def batch_rows(hashes, start=0):
    return [(start + k, 1, None, None, h, "x", "y") for k, h in enumerate(hashes)]


@pytest.mark.parametrize("digits", [64, 16])
def test_no_key_stays_hot(spark, monkeypatch, digits):
    monkeypatch.setattr(intake, "HOT_KEY", 40)
    rng = random.Random(digits)
    centre = f"{rng.getrandbits(4 * digits):0{digits}x}"
    ball = {near(rng, centre, rng.randrange(0, 5)) for _ in range(900)}  # one dense ball of hashes
    index = FingerprintIndex(spark).create(fingerprints(spark.createDataFrame(batch_rows(sorted(ball)), ROW), [], ["sha"], "phash"))
    levels = {r["level"]: r["n"] for r in index.read().groupBy("level", "key").count().groupBy("level").agg(F.max("count").alias("n")).collect()}
    looked_up = index.keys(fingerprints(spark.createDataFrame(batch_rows(sorted(ball)), ROW), [], ["sha"], "phash").withColumn("batch", F.lit("")), False)
    assert looked_up.groupBy("key").count().agg(F.max("count")).first()[0] <= 2 * 40, levels
    assert max(levels) == intake.SPREAD
    probe = [near(rng, h, 1) for h in rng.sample(sorted(ball), 20)] + [f"{rng.getrandbits(4 * digits):0{digits}x}"]
    got = {r[0] for r in check_batch(index, spark.createDataFrame(batch_rows(probe, 5000), ROW), "id", ["id"], ["sha"], "phash", accept=False).collect()}
    assert got == expected(batch_rows(sorted(ball)), batch_rows(probe, 5000))
    index.drop()


def test_long_chains_take_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(intake, "RANGE_ROWS", 600)
    own = spark.createDataFrame([(k, k) for k in range(2000)], "turn long, number long")
    pairs = spark.createDataFrame([(k, k + 1) for k in range(1999)], "a long, b long")
    cases, rounds = intake.first_come(own, pairs, 6000)
    assert sorted(r[0] for r in cases.collect()) == list(range(1, 2000, 2)) and rounds < 20
    monkeypatch.setattr(intake, "RANGE_ROWS", 200_000)
    cases, rounds = intake.first_come(own, pairs, 6000)
    assert cases.count() == 1000 and rounds == 1


def test_a_batch_checked_again_doesnt_match_itself(spark):
    rng = random.Random(11)
    history, batch = rows(rng, 60, 0, []), rows(rng, 80, 1000, [])
    index = FingerprintIndex(spark).create(fingerprints(spark.createDataFrame(history, ROW), [], ["sha", "other"], "phash"))
    check = lambda name, b=batch: {r[0] for r in check_batch(index, spark.createDataFrame(b, ROW), "id", ["batch", "id"], ["sha", "other"], "phash", name=name).collect()}
    first = check("b1")
    size = index.read().count()
    assert first == expected(history, batch) == check("b1") and index.read().count() == size
    index.compact()
    assert check("b1") == first
    assert check("b2") == {r[0] for r in batch if prints(r) != (set(), None)}
    index = FingerprintIndex.open(spark, index.folder)
    assert check("b3", batch[:9]) == {r[0] for r in batch[:9] if prints(r) != (set(), None)}
    index.drop()


def test_long_hashes(spark):
    rng = random.Random(12)
    sha, hash_ = f"{rng.getrandbits(512):0128x}", f"{rng.getrandbits(1024):0256x}"
    first = [(1, 1, sha, None, hash_, "x", "y")]
    batch = [(2, 1, "0x" + sha.upper(), None, None, "x", "y"), (3, 1, None, None, near(rng, hash_, 5), "x", "y"), (4, 1, sha[:-1] + "0", None, near(rng, hash_, 6), "x", "y"), (5, 1, sha[:64], None, hash_[:64], "x", "y")]
    batch[2] = (*batch[2][:2], sha[:-1] + ("1" if sha[-1] != "1" else "2"), *batch[2][3:])
    index = FingerprintIndex(spark).create(fingerprints(spark.createDataFrame(first, ROW), [], ["sha"], "phash"))
    got = {r[0] for r in check_batch(index, spark.createDataFrame(batch, ROW), "id", ["id"], ["sha"], "phash").collect()}
    assert got == expected(first, batch)
    index.drop()


def test_batches_are_looked_up_one_after_the_other(spark, monkeypatch):
    probes, appends = [], []
    matched, append = FingerprintIndex.matched, FingerprintIndex.append
    monkeypatch.setattr(FingerprintIndex, "matched", lambda *a, **k: probes.append(a) or matched(*a, **k))
    monkeypatch.setattr(FingerprintIndex, "append", lambda *a, **k: appends.append(a) or append(*a, **k))
    rng = random.Random(13)
    history = rows(rng, 40, 0, [])
    batch = rows(rng, 120, 1000, history) + [(3000, None, None, None, history[0][4], "x", "y")]
    index = FingerprintIndex(spark).create(fingerprints(spark.createDataFrame(history, ROW), [], ["sha", "other"], "phash"))
    got = {r[0] for r in intake.check_batches(index, spark.createDataFrame(batch, ROW), "batch", "id", ["sha", "other"], "phash").collect()}
    assert got == expected(history, batch) and len(probes) == len(appends) == 4  # batches 1, 2, 3 and null
    index.drop()
