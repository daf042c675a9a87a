"""Checks new batches against everything accepted before, through a persisted index of fingerprints.

A record has up to two kinds of fingerprint: content hashes, which match if equal, and
perceptual hashes, which match if of equal length and at most `limit` bits apart.

A perceptual hash is cut into disjoint bands; two hashes `limit` bits apart share at least one
of `limit` + 1 bands exactly, so looking up bands finds every match. (Minwise keys would find
a pair only with some probability.) Short hashes, whose bands would be too common, are cut into
`limit` + 2 bands of which pairs are keys. A key that many hashes share is hot: it is replaced by
`limit` + 1 finer keys, each with another of as many disjoint parts of the hash, of which two
matching hashes again share one; finer keys that are hot are cut again, and what is hot after
`MAX_CUTS` cuts is spread: known hashes over numbered keys, new ones looked up in all of them.

The index keeps (key, fingerprint) rows in a table bucketed by key: a lookup shuffles the new
keys only and reads the index in place; accepted records are appended to it.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.names import hex_value
from gleanery.runtime import cut, remove, scratch

#: Digits that the words of a fingerprint hold; ``rest`` has the others.
DIGITS = 64
WORDS = ["w0", "w1", "w2", "w3"]
PRINT = ["kind", "digits", *WORDS, "rest"]
EXACT, NEAR = 0, 1
BUCKET_KEYS = 400_000
#: Fingerprints of a key above which it is cut, and how often it is cut before it is spread.
HOT_KEY, MAX_CUTS = 2_000, 3
#: Bits a single band must have to be a key by itself.
BAND_BITS = 32
#: Rows of an ordered pass that a task takes.
RANGE_ROWS = 200_000
#: An index is built anew when what was appended is this many times what it was built from.
REBUILD = 1.0
SPREAD = MAX_CUTS + 1


def _cuts(digits: int, parts: int) -> list[tuple[int, int]]:
    """(first digit, length) of `parts` bands of about equal length."""
    at = [digits * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def _word(text: str, at: int | str) -> str:
    """SQL: the 16 digits from the 0-based digit `at` on as a signed number."""
    return f"CAST(conv(rpad(substring({text}, {at} + 1, 16), 16, '0'), 16, -10) AS BIGINT)"


def _hashed(bands: list[tuple[int, int]], *more: object) -> str:
    """SQL: a key of parts of ``text``."""
    return f"xxhash64({', '.join([*map(str, more), *(f'substring(text, {a + 1}, {n})' for a, n in bands)])})"


def _is_long(limit: int, digits: int) -> bool:
    return digits * 4 // (limit + 1) >= BAND_BITS


def _bands(limit: int, digits: int) -> list[list[tuple[int, int]]]:
    """The bands that make each key of a perceptual hash of this many digits."""
    if _is_long(limit, digits):
        return [[b] for b in _cuts(digits, limit + 1)]
    if digits >= limit + 2:
        return [list(c) for c in combinations(_cuts(digits, limit + 2), 2)]
    return [[]]


def _parts(limit: int, digits: int, level: int) -> list[list[tuple[int, int]]]:
    """`limit` + 1 disjoint sets of parts that cover a hash, other sets for each level."""
    sets: list[list[tuple[int, int]]] = [[] for _ in range(limit + 1)]
    for j, part in enumerate(_cuts(digits, min(digits, 3 * (limit + 1)))):
        sets[(j + level * (j // (limit + 1))) % (limit + 1)].append(part)
    return sets


def fingerprints(df: DataFrame, row: list[Column], contents: list[str], perceptual: str) -> DataFrame:
    """`row` columns with each fingerprint: kind, digits, its words, and ``text``, its digits.

    Hex notations of one value are the same; null, blank and non-hex values are no fingerprints.
    A content hash of more than 64 digits is kept as its SHA-256 and its length; of a
    perceptual hash ``rest`` has the digits beyond.
    """
    values = [F.struct(F.lit(EXACT).cast("tinyint").alias("kind"), hex_value(F.col(c)).alias("text")) for c in contents]
    values.append(F.struct(F.lit(NEAR).cast("tinyint").alias("kind"), hex_value(F.col(perceptual)).alias("text")))
    each = df.select(*row, F.explode(F.array(*values)).alias("v")).select("*", "v.kind", "v.text").drop("v")
    each = each.filter(F.col("text").isNotNull()).withColumn("digits", F.length("text").cast("int"))
    each = each.withColumn("text", F.expr(f"CASE WHEN digits > {DIGITS} AND kind = {EXACT} THEN sha2(text, 256) ELSE text END"))
    words = {w: F.expr(f"CASE WHEN length(text) > {16 * k} THEN {_word('text', 16 * k)} ELSE 0L END") for k, w in enumerate(WORDS)}
    return each.withColumns(words | {"rest": F.expr(f"CASE WHEN digits > {DIGITS} AND kind = {NEAR} THEN substring(text, {DIGITS + 1}) END")})


#: SQL: the digits of a perceptual hash, from its words and the rest.
_TEXT = f"concat(substring(concat({', '.join(f'lpad(lower(hex({w})), 16, "0")' for w in WORDS)}), 1, least(digits, {DIGITS})), coalesce(rest, ''))"


def with_keys(prints: DataFrame, limit: int, lengths: list[int]) -> DataFrame:
    """Fingerprints once for each of their keys, at ``level`` 0; perceptual hashes of other lengths are an error."""
    near = "".join(f" WHEN digits = {n} THEN array({', '.join(_hashed(c, n, k) for k, c in enumerate(_bands(limit, n)))})" for n in lengths)
    keys = f"CASE WHEN kind = {EXACT} THEN array(xxhash64('exact', digits, {', '.join(WORDS)})){near} ELSE raise_error('a perceptual hash of a length that has no keys') END"
    return prints.withColumn("text", F.expr(_TEXT)).withColumn("key", F.explode(F.expr(keys))).drop("text").withColumn("level", F.lit(0).cast("tinyint"))


def may_be_hot(stats) -> bool:
    """Whether so many fingerprints, rows (kind, digits, n), can have a key of too many."""
    return sum(r["n"] for r in stats if r["kind"] == NEAR) > HOT_KEY


def hot_keys(keyed: DataFrame) -> DataFrame:
    """(key, level, salts): keys of too many fingerprints; `salts` 0 says to cut, else over how many keys to spread."""
    counts = keyed.filter((F.col("kind") == NEAR) & (F.col("level") < SPREAD)).groupBy("key", "level").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_KEY)
    return counts.select("key", "level", F.when(F.col("level") < MAX_CUTS, 0).otherwise(F.ceil(F.col("n") / HOT_KEY)).cast("int").alias("salts"))


def cut_keys(keyed: DataFrame, hot: DataFrame, level: int, limit: int, lengths: list[int], probing: bool) -> DataFrame:
    """Rows of hot keys of a level under finer keys instead; all other rows as they are.

    A spread key is one of its numbered keys by the fingerprint, or if `probing` all of them.
    """
    mine = hot.filter(F.col("level") == level).select("key", F.col("level").alias("__level"), F.col("salts").alias("__salts"))
    is_hot = f"(__salts IS NOT NULL AND level = __level AND kind = {NEAR})"
    x = keyed.join(mine, "key", "left").withColumn("text", F.expr(f"CASE WHEN {is_hot} THEN {_TEXT} END"))
    if level < MAX_CUTS:
        sets = {n: ", ".join(_hashed(parts, "key", level, g) for g, parts in enumerate(_parts(limit, n, level))) for n in lengths}
        finer = f"CASE {' '.join(f'WHEN digits = {n} THEN array({keys})' for n, keys in sets.items())} END"
    elif probing:
        finer = "transform(sequence(0, __salts - 1), i -> xxhash64(key, i))"
    else:
        finer = f"array(xxhash64(key, CAST(pmod(xxhash64({', '.join(WORDS)}, rest), __salts) AS INT)))"
    x = x.withColumn("key", F.explode(F.expr(f"CASE WHEN {is_hot} THEN {finer} ELSE array(key) END")))
    return x.withColumn("level", F.expr(f"CAST(CASE WHEN {is_hot} THEN {level + 1} ELSE level END AS TINYINT)")).drop("__level", "__salts", "text")


def _near(a: str, b: str, limit: int) -> Column:
    """Whether two fingerprints of one key match.

    Kind and length are compared as differences: as equalities they would become keys of the
    join, which the index's buckets, by key alone, don't serve; it would be shuffled.
    """
    apart = " + ".join(f"bit_count({a}.{w} ^ {b}.{w})" for w in WORDS)
    most = f"CASE WHEN {a}.kind = {NEAR} THEN {limit} ELSE 0 END"
    x, y = f"{a}.rest", f"{b}.rest"
    beyond = f"aggregate(sequence(0, length({x}) - 1, 16), 0, (s, i) -> s + bit_count({_word(x, 'i')} ^ {_word(y, 'i')}))"
    beyond = f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {beyond} ELSE 0 END"
    same = f"abs({a}.kind - {b}.kind) + abs({a}.digits - {b}.digits) = 0"
    return F.expr(f"{same} AND {apart} <= {most} AND ({a}.digits <= {DIGITS} OR {apart} + {beyond} <= {most})")


class FingerprintIndex:
    """The fingerprints of everything accepted so far, as a table bucketed by key.

    `create` fills a new folder, `open` takes up one that an earlier session filled. Rows keep the
    batch that brought them, so that a batch that is checked again doesn't match itself.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, limit: int = 5):
        self.spark, self.limit = spark, limit
        self.folder = folder or scratch(spark, "fingerprints")
        self.name = ""
        self.keys_folder = ""
        self.lengths = [DIGITS, 16]
        self.version = self.levels = self.built = self.added = 0
        self.hot: DataFrame | None = None

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> FingerprintIndex:
        """The index in a folder."""
        # A row for each time that something changed.
        saved = max((json.loads(r[0]) for r in spark.read.text(f"{folder}/about").collect()), key=lambda x: x["version"])
        index = cls(spark, folder, saved["limit"])
        for what in ("version", "lengths", "buckets", "keys_folder", "levels", "built", "added"):
            setattr(index, what, saved[what])
        index._read_hot()
        columns = spark.read.parquet(index.keys_folder).schema.simpleString()[len("struct<") : -1].replace(":", " ")
        index.name = f"fingerprints_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {index.name} ({columns}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {index.buckets} BUCKETS LOCATION '{index.keys_folder}'")
        return index

    def create(self, prints: DataFrame) -> FingerprintIndex:
        """Fills the index with fingerprints. Equal ones are kept once."""
        stats = prints.groupBy("digits", "kind").agg(F.count("*").alias("n")).collect()  # a row a length
        self.lengths = sorted({DIGITS, 16} | {r["digits"] for r in stats if r["kind"] == NEAR})
        self._fill(prints.select(*PRINT).distinct().withColumn("batch", F.lit("")), self._key_rows(stats))
        return self

    def _key_rows(self, stats) -> int:
        """Keys of so many fingerprints (kind, digits, n)."""
        return sum(r["n"] * (1 if r["kind"] == EXACT else len(_bands(self.limit, r["digits"]))) for r in stats)

    def _fill(self, prints: DataFrame, rows: int) -> None:
        old_name, old_folder = self.name, self.keys_folder
        self.name, self.keys_folder = f"fingerprints_{uuid.uuid4().hex}", f"{self.folder}/keys-{self.version}"
        self.buckets = max(12, ceil(rows / BUCKET_KEYS))
        self.built, self.added, self.levels, self.hot = rows, 0, 0, None
        self._write(with_keys(prints, self.limit, self.lengths))
        self._cool(self.read())
        self._save()
        if old_name:
            self.spark.sql(f"DROP TABLE {old_name}")
            remove(self.spark, old_folder)

    def _cool(self, fresh: DataFrame) -> None:
        """Cuts the keys that are hot among `fresh` rows of the table, until none is.

        Their rows are added under finer keys. The old ones stay, but nothing looks them up.
        """
        hot = cut(hot_keys(fresh))
        while not hot.isEmpty():
            hot.write.mode("append").parquet(f"{self.keys_folder}-hot")
            rows = self.read().join(hot.select("key", "level"), ["key", "level"], "left_semi")
            levels = sorted(r[0] for r in hot.select("level").distinct().collect())  # at most MAX_CUTS + 1
            rows = cut(reduce(lambda x, n: cut_keys(x, hot, n, self.limit, self.lengths, False), levels, rows))
            self.levels = max(self.levels, levels[-1] + 1)
            self._write(rows)
            hot = cut(hot_keys(rows))
        self._read_hot()

    def _read_hot(self) -> None:
        if self.levels:
            self.hot = self.spark.read.schema("key bigint, level tinyint, salts int").parquet(f"{self.keys_folder}-hot")

    def compact(self) -> None:
        """Builds the table anew: buckets to its size, one file each, hot keys cut, what isn't looked up gone.

        Done by `append` once more was added than was there, so that its cost stays in
        proportion to what is added. Other sessions must open the index again.
        """
        self.version += 1
        rows = self.read().filter("level = 0").groupBy(*PRINT).agg(F.min("batch").alias("batch"))
        self._fill(cut(rows), self.built + self.added)

    def _save(self) -> None:
        self.version += 1
        about = {what: getattr(self, what) for what in ("version", "limit", "lengths", "buckets", "keys_folder", "levels", "built", "added")}
        system, path = self._path(f"about/{self.version:09d}.json")
        with_text = system.create(path, True)
        with_text.write(bytearray(json.dumps(about).encode()))
        with_text.close()

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def admit(self, digits: set[int]) -> None:
        """Lets perceptual hashes of these lengths have keys, also those that are new to the index."""
        if not digits <= set(self.lengths):
            self.lengths = sorted({*self.lengths, *digits})
            self._save()

    def _write(self, keyed: DataFrame) -> None:
        rows = keyed.select("key", "level", *PRINT, "batch").repartition(self.buckets, "key")
        rows.write.mode("append").format("parquet").option("path", self.keys_folder).bucketBy(self.buckets, "key").sortBy("key").saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def keys(self, prints: DataFrame, probing: bool) -> DataFrame:
        """Fingerprints under the keys that the index has for them or, if `probing`, under those to look in."""
        keyed = with_keys(prints, self.limit, self.lengths)
        for level in range(self.levels):
            keyed = cut_keys(keyed, self.hot, level, self.limit, self.lengths, probing)
        return keyed

    def _buckets_of(self, probe: DataFrame) -> DataFrame:
        """The rows of the buckets that the keys, at most as many as there are buckets, are in."""
        wanted = {r[0] for r in probe.select(F.pmod(F.hash("key"), F.lit(self.buckets))).distinct().collect()}
        files = [f for f in self.read().inputFiles() if int(re.search(r"_(\d+)(?:\.c\d+)?\.[^/]*$", f)[1]) in wanted]
        return self.spark.read.parquet(*files) if files else self.read().limit(0)

    def append(self, prints: DataFrame, stats, batch: str = "") -> None:
        """Adds the distinct fingerprints of accepted records, of lengths that were admitted; a named batch once.

        `stats`: rows (kind, digits, n) of how many they are at most. A run that was lost
        between writing and noting it leaves rows that the next run writes again: they change no
        answer and go with the next `compact`.
        """
        if batch:
            system, path = self._path(f"batches/{hashlib.sha256(batch.encode()).hexdigest()}")
            if system.exists(path):
                return
        rows = self.keys(prints.select(*PRINT), False).withColumn("batch", F.lit(batch))
        if may_be_hot(stats):
            rows = cut(rows)
        self._write(rows)
        if may_be_hot(stats):
            self._cool(rows)
        self.added += self._key_rows(stats)
        if batch:
            system.mkdirs(path)
        if self.added > REBUILD * max(self.built, BUCKET_KEYS):
            self.compact()
        else:
            self._save()

    def drop(self) -> None:
        """Deletes the index."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.folder)

    def matched(self, values: DataFrame, row: str, keys: int, batch: str = "") -> DataFrame:
        """The `row` of those of distinct fingerprints that match one of the index, some repeatedly.

        `keys` is about how many they have. They are shuffled to the buckets of the index,
        which is read in place; of an index with more buckets only the files of their
        buckets are read. What the same named batch added before is passed over.
        """
        probe = self.keys(values, True)
        known = self._buckets_of(probe) if keys * (1 + self.levels) < self.buckets and not self.levels else self.read()
        if batch:
            known = known.filter(F.col("batch") != batch)
        on = (F.col("p.key") == F.col("k.key")) & _near("p", "k", self.limit)
        return probe.alias("p").join(known.alias("k"), on, "left_semi").select(row)


def near_values(values: DataFrame, limit: int, lengths: list[int], hot: bool = True) -> DataFrame:
    """(a, b): the numbers of matching perceptual hashes among distinct `values`, a < b, each once.

    `hot` False says that they are too few for hot keys.
    """
    a = b = with_keys(values.filter(F.col("kind") == NEAR).select("number", *PRINT), limit, lengths)
    if hot:
        a = b = cut(a)
    for level in range(SPREAD if hot else 0):
        many = cut(hot_keys(a))
        if many.isEmpty():
            break
        a, b = (cut_keys(x, many, level, limit, lengths, probing) for x, probing in ((a, False), (b, True)))
        a = cut(a)
        b = a if level < MAX_CUTS else cut(b)
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.number") != F.col("b.number")) & _near("a", "b", limit)
    pairs = a.alias("a").join(b.alias("b"), on).select(F.least("a.number", "b.number").alias("a"), F.greatest("a.number", "b.number").alias("b"))
    return pairs.distinct()


OPEN, ACCEPTED, CASE = 0, 1, 2


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(turn, state) of rows that come as (turn, number, own, accepted, waiting) in the order of turns.

    A row that hears a number accepted before it is a case. One that hears a number which an
    open row before this range, or an open one of the range, has stays open.
    """
    turn, start = None, None
    heard: list[tuple[int, bool, int | None, int | None]] = []
    taken: set[int] = set()
    unsure: set[int] = set()

    def settle() -> int:
        if any((accepted is not None and accepted < turn) or n in taken for n, _, accepted, _ in heard):
            return CASE
        own = [n for n, mine, _, _ in heard if mine]
        if any((waiting is not None and waiting < start) or n in unsure for n, _, _, waiting in heard):
            unsure.update(own)
            return OPEN
        taken.update(own)
        return ACCEPTED

    for batch in batches:
        turns, states = [], []
        for t, n, mine, accepted, waiting in zip(*(c.to_pylist() for c in batch.columns)):
            if t != turn:
                if turn is None:
                    start = t
                else:
                    turns.append(turn)
                    states.append(settle())
                turn, heard = t, []
            heard.append((n, mine, accepted, waiting))
        yield pa.RecordBatch.from_arrays([pa.array(turns, pa.int64()), pa.array(states, pa.int8())], names=["turn", "state"])
    if turn is not None:
        yield pa.RecordBatch.from_arrays([pa.array([turn], pa.int64()), pa.array([settle()], pa.int8())], names=["turn", "state"])


def first_come(own: DataFrame, pairs: DataFrame, most: int) -> tuple[DataFrame, int]:
    """(turn) of rows that match an earlier row that is itself no case, and the rounds that took.

    `own`: (turn, number), the numbers of each row's values; `pairs`: (a, b), numbers that
    match; `most`: about how many rows these make. Turns are cut into ranges of at most about `RANGE_ROWS` rows, each of which one task
    goes through in order. What hangs on an earlier range waits for the next round; the first
    range is always settled, so there are at most as many rounds as ranges, however long
    the chains of matches are. Values stand for all rows that have them, so copies make no pairs.
    """
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    hears = own.select("turn", "number", F.lit(True).alias("own"))
    hears = hears.union(own.join(both, own["number"] == both["a"]).select("turn", F.col("b").alias("number"), F.lit(False)))
    accepted: DataFrame | None = None
    cases, rounds = [], 0
    while True:
        rounds += 1
        waiting = hears.filter("own").groupBy("number").agg(F.min("turn").alias("waiting"))
        x = hears.join(waiting, "number", "left")
        x = x.join(accepted, "number", "left") if accepted is not None else x.withColumn("accepted", F.lit(None).cast("bigint"))
        ranges = x.select("turn", "number", "own", "accepted", "waiting").repartitionByRange(max(1, ceil(most / RANGE_ROWS)), "turn").sortWithinPartitions("turn")
        states = cut(ranges.mapInArrow(_in_order, "turn bigint, state tinyint"))
        cases.append(states.filter(F.col("state") == CASE).select("turn"))
        still = states.filter(F.col("state") == OPEN).select("turn")
        if still.isEmpty():
            return reduce(DataFrame.union, cases), rounds
        won = hears.filter("own").join(states.filter(F.col("state") == ACCEPTED), "turn", "left_semi").select("number", F.col("turn").alias("accepted"))
        won = won if accepted is None else won.union(accepted)
        accepted = cut(won.groupBy("number").agg(F.min("accepted").alias("accepted")))
        hears = cut(hears.join(still, "turn", "left_semi"))
        most = hears.count()


def ordered_prints(df: DataFrame, record: str, order: list[str], contents: list[str], perceptual: str, batch: str | None = None) -> DataFrame:
    """(turn, record, batch) and fingerprints of `df`: ``turn`` numbers rows in the order of `order`, nulls last."""
    by = [F.col(c).asc_nulls_last() for c in order]
    named = df.select(F.col(record).alias("__record"), (F.col(batch) if batch else F.lit(None)).alias("__batch"), *(F.col(c).alias(f"__o{k}") for k, c in enumerate(order)), *(F.col(c).alias(f"__c{k}") for k, c in enumerate([*contents, perceptual])))
    by = [F.col(f"__o{k}").asc_nulls_last() for k in range(len(order))]
    turns = named.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("turn", F.monotonically_increasing_id())
    row = [F.col("turn"), F.col("__record").alias("record"), F.col("__batch").alias("batch")]
    return cut(fingerprints(turns, row, [f"__c{k}" for k in range(len(contents))], f"__c{len(contents)}").drop("text"))


def _stats(prints: DataFrame, *by: str) -> list:
    """Rows (`by`, kind, digits, n): a row a length."""
    return prints.groupBy(*by, "kind", "digits").agg(F.count("*").alias("n")).collect()


def check_prints(index: FingerprintIndex, prints: DataFrame, stats, accept: bool = True, batch: str = "") -> DataFrame:
    """(record): as `check_batch`, for rows of `ordered_prints` and their `_stats`."""
    if not stats:
        return prints.select("record").limit(0)
    index.admit({r["digits"] for r in stats if r["kind"] == NEAR})
    # Values stand for all rows that have them: copies are looked up once.
    values = cut(prints.groupBy(*PRINT).agg(F.count_distinct("turn").alias("n"))).withColumn("number", F.monotonically_increasing_id())
    hits = index.matched(values, "number", index._key_rows(stats), batch).distinct().withColumn("hit", F.lit(True))
    values = cut(values.join(hits, "number", "left").withColumn("hit", F.coalesce("hit", F.lit(False))))
    p, v = prints.select("turn", *PRINT).distinct().alias("p"), values.alias("v")
    same = reduce(lambda x, y: x & y, [F.col(f"p.{c}") == F.col(f"v.{c}") for c in PRINT if c != "rest"]) & F.col("p.rest").eqNullSafe(F.col("v.rest"))
    rows = cut(p.join(v, same).select("turn", "number", "hit", "n"))
    known_turns = rows.filter("hit").select("turn").distinct()
    pairs = cut(near_values(values.filter("not hit"), index.limit, index.lengths, may_be_hot(stats)))
    fresh = rows.join(known_turns, "turn", "left_anti")
    paired = pairs.select(F.explode(F.array("a", "b")).alias("number")).distinct()
    shared = fresh.filter("n > 1").select("number").union(paired).distinct()
    later, _ = first_come(fresh.join(shared, "number", "left_semi").select("turn", "number"), pairs, sum(r["n"] for r in stats))
    cases = cut(known_turns.union(later).distinct())
    if accept:
        new = rows.join(cases, "turn", "left_anti").select("number").distinct()
        index.append(values.join(new, "number", "left_semi"), stats, batch)
    return prints.select("turn", "record").join(cases, "turn", "left_semi").distinct().select("record")


def check_batch(index: FingerprintIndex, batch: DataFrame, record: str, order: list[str], contents: list[str], perceptual: str, accept: bool = True, name: str = "") -> DataFrame:
    """(record): the rows of a batch that match the index or an earlier row that is no case.

    Rows count in the order of `order` (nulls last), which must tell rows apart. Rows without
    fingerprints match nothing. With `accept` the other rows' fingerprints are appended to
    the index; a batch with a `name` can be checked again, after a lost run or later: what it
    brought itself is passed over and isn't appended twice. A batch without rows gives none.
    """
    prints = ordered_prints(batch, record, order, contents, perceptual)
    found = check_prints(index, prints, _stats(prints), accept, name)
    return found.select(F.col("record").alias(record))


def check_batches(index: FingerprintIndex, df: DataFrame, batch: str, record: str, contents: list[str], perceptual: str, most: int = 10_000) -> DataFrame:
    """(record): the cases of each batch of `df`, checked one after the other in the order of
    (`batch`, `record`), nulls last; what a batch brings is appended before the next is looked up.

    More than `most` batches are an error. Batches are not named in the index: `df` is checked once.
    """
    prints = ordered_prints(df, record, [batch, record], contents, perceptual, batch)
    stats: dict = {}
    for r in _stats(prints, "batch"):
        stats.setdefault(r["batch"], []).append(r)
    if len(stats) > most:
        raise ValueError(f"more than {most} batches")
    found = []
    for name in sorted(stats, key=lambda b: (b is None, b if b is not None else 0)):
        mine = prints.filter(F.col("batch").eqNullSafe(F.lit(name))).drop("batch")
        found.append(check_prints(index, mine, stats[name]))
    return reduce(DataFrame.union, found, prints.select("record").limit(0)).select(F.col("record").alias(record))
