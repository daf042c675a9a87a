"""Text that was decoded with the wrong encoding: found and restored as by a noisy channel.

The words of the whole corpus are the source model, wrong decodings (UTF-8 shown as another
encoding any number of times, one single-byte encoding as another, escaped or case-changed after
that, bytes lost) the channels. Each piece of text beyond ASCII has a lattice of what it may
have been, of all bytes its characters may stand for, with wildcards for lost ones; Viterbi
search over the pieces of a document picks, for each, a reading or none, by the frequency of the
words on either side, with a price for each change of channel.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.channels import CASED, DROPPED, GONE, LOST, UNIT, candidates, fits, model_words, other_script, pattern_of, told_by_look, usual
from gleanery.runtime import cut, written_bytes

#: Log odds for each level of valid UTF-8 sequences, which clean text hardly holds by chance.
SEQUENCE = 2.5
#: Log odds for what text doesn't hold: controls of the upper range; lost bytes or a shown byte-order mark.
CONTROL, MISSING = 2.0, 6.0
#: A channel of single bytes is told only by words of SHORT letters that gain at least CLEAR.
SHORT, CLEAR = 3, 2.0
#: Price of a reading that takes changes of case where another doesn't.
RECASED = 3.0
#: Prices: clean to damaged, damaged to clean, channel to channel, a piece the channel can't have made.
ENTER, LEAVE, CHANGE, MISFIT = 4.0, 1.0, 5.0, 2.0

#: Suspect units of at most so many bytes are sent to the tasks, more are joined.
SENT_BYTES = 16 << 20
#: Text that can hold units.
HAS_UNITS = "[^\\x00-\\x7f]|&"
_GONE = re.compile(GONE)


WORD_ROW, UNIT_ROW = 0, 1


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, token, n): words and units beyond ASCII with the texts of the batch that hold them."""
    words_of = lru_cache(1 << 16)(model_words)
    for batch in batches:
        words, units = Counter(), Counter()
        for text in batch.column(0).to_pylist():
            found = set(UNIT.findall(text))
            units.update(found)
            words.update({w for u in found for w in (words_of(u) if len(u) <= 200 else model_words(u))})
        kinds = [WORD_ROW] * len(words) + [UNIT_ROW] * len(units)
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array([*words, *units], pa.string()), pa.array([*words.values(), *units.values()], pa.int64())], names=["kind", "token", "n"])


def _no_evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n), n below 0: the words of units (unit, n) that are damage by their look, which are
    no evidence for their own words."""
    for batch in batches:
        words = Counter()
        for unit, n in zip(*(c.to_pylist() for c in batch.columns)):
            if told_by_look(unit):
                for w in set(model_words(unit)):
                    words[w] -= n
        yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])


CANDIDATE = "unit string, channel string, level int, restored string, words array<string>"


def _lattices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each unit may have been, and the unit itself as channel ''."""
    for batch in batches:
        rows = []
        for unit in batch.column(0).to_pylist():
            if found := candidates(unit):
                for channel, level, restored in [("", 0, unit), *found]:
                    rows.append((unit, channel, level, restored, list(dict.fromkeys(model_words(html.unescape(restored) if channel == "" else restored)))))
        columns = list(zip(*rows)) or [[]] * 5
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["unit", "channel", "level", "restored", "words"])


def _occurrences(suspects):
    """A function to (key, start, unit) of every unit, or of those among the broadcast `suspects`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if suspects is None else suspects.value
        for batch in batches:
            at, starts, units = [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                for m in UNIT.finditer(text):
                    if wanted is None or m.group() in wanted:
                        at.append(k)
                        starts.append(m.start())
                        units.append(m.group())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(starts, pa.int32()), pa.array(units, pa.string())], names=["key", "start", "unit"])

    return run


def best_path(pieces: list[list[tuple[str, float]]]) -> list[int]:
    """For each piece the index of its candidate on the best path, or -1 for none.

    `pieces`: the (channel, log odds) of each piece's candidates. Clean has the odds 0.
    """
    clean, back = 0.0, []
    state: dict[str, float] = {}
    for options in pieces:
        odds: dict[str, tuple[float, int]] = {}
        for k, (channel, e) in enumerate(options):
            if channel not in odds or e > odds[channel][0]:
                odds[channel] = (e, k)
        top = max(state, key=state.get, default=None)
        ways, now = {}, {}
        for channel in sorted(odds.keys() | state.keys()):
            e, k = odds.get(channel, (-MISFIT, -1))
            come = [(clean - ENTER, "")]
            if channel in state:
                come.append((state[channel], channel))
            if top is not None and top != channel:
                come.append((state[top] - CHANGE, top))
            score, origin = max(come)
            now[channel] = score + e
            ways[channel] = (origin, k)
        from_damage = (state[top] - LEAVE, top) if top is not None else (float("-inf"), "")
        ways[""] = ("", -1) if clean >= from_damage[0] else (from_damage[1], -1)
        clean = max(clean, from_damage[0])
        back.append(ways)
        state = now
    at = max(state, key=state.get, default="")
    if not state or state[at] <= clean:
        at = ""
    path = []
    for ways in reversed(back):
        at, k = ways[at]
        path.append(k)
    return path[::-1]


FIXES = "key {kind}, fixes array<struct<start:int, unit:string, restored:string, channel:string>>"


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("unit", pa.string()), ("restored", pa.string()), ("channel", pa.string())]))
    for batch in batches:
        at, fixes = [], []
        for k, pieces in enumerate(batch.column(1).to_pylist()):
            path = best_path([[(c["channel"], c["odds"] - 1e-6 * usual(c["channel"])) for c in p["found"]] for p in pieces])
            chosen = [{"start": p["start"], "unit": p["unit"], **{x: p["found"][c][x] for x in ("restored", "channel")}} for p, c in zip(pieces, path) if c >= 0]
            if chosen:
                at.append(k)
                fixes.append(chosen)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(fixes, kind)], names=["key", "fixes"])


def _gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _with_keys(batch, batch.column(3).to_pylist())


def _with_keys(batch: pa.RecordBatch, words: list[str]) -> pa.RecordBatch:
    keys = list(zip(*map(_keys_of, words))) or [[]] * 4
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(list(k), kind) for k, kind in zip(keys, kinds))], names=[*batch.schema.names, "gaps", "length", "head", "tail"])


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (word, damaged, n) those where the word can have become the damaged one."""
    for batch in batches:
        words, damaged = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        yield batch.filter(pa.array([fits(w, d) and _sound(w) for w, d in zip(words, damaged)], pa.bool_()))


def _cased(word: str, like: str) -> str:
    return word.upper() if like == like.upper() and like != like.lower() else word[:1].upper() + word[1:] if like[:1].isupper() else word


class Repair:
    """Damage in the texts of `df` (`key` and `text`).

    Null, empty and ASCII texts without entities are clean. Rows with a null key are read for
    the model but can't come out. Rows with equal keys count as one document. The model counts
    each distinct text once, so that copies of a damaged one don't vote for its spelling.
    """

    def __init__(self, df: DataFrame, key: str = "doc_id", text: str = "text"):
        self.key = key
        self.kind = df.schema[key].dataType.simpleString()
        self.documents = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
        self.documents = self.documents.filter(F.col("text").rlike(HAS_UNITS))
        counted = self.documents.select("text").distinct().mapInArrow(_scan, "kind int, token string, n bigint")
        tokens = cut(counted.groupBy("kind", "token").agg(F.sum("n").alias("n")))
        self.units = tokens.filter(f"kind = {UNIT_ROW}").select(F.col("token").alias("unit"), "n")
        words = tokens.filter(f"kind = {WORD_ROW}").select(F.col("token").alias("word"), "n")
        less = self._spread(self.units).mapInArrow(_no_evidence, "word string, n bigint")
        self.words = cut(words.union(less).groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0"))
        self._known: DataFrame | None = None

    def _spread(self, units: DataFrame) -> DataFrame:
        """Few bytes but much work: not to be merged into a task."""
        spread = max(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), units.sparkSession.sparkContext.defaultParallelism)
        return units.repartition(spread, units.columns[0])

    def known(self) -> DataFrame:
        """(word, n, gaps, length, head, tail): words without lost characters, by what they are looked up by."""
        if self._known is None:
            self._known = cut(self.words.mapInArrow(_patterns, f"word string, n bigint, {KEYS}"))
        return self._known

    def suspects(self) -> DataFrame:
        """(unit, found): units with a reading that is likelier than the unit, and these readings."""
        units = self._spread(self.units.select("unit"))
        lattices = cut(units.mapInArrow(_lattices, CANDIDATE))
        dropped = F.col("channel").endswith(DROPPED)
        whole = lattices.filter(~dropped).unionByName(self._refilled(lattices.filter(dropped)))
        looked = whole.select("unit", "channel", "level", "restored", F.explode_outer("words").alias("word")).join(self.words, "word", "left")
        log = F.log1p(F.coalesce("n", F.lit(0)))
        letters = F.sum(F.length(F.regexp_replace("word", r"\P{L}", "")))
        scored = looked.groupBy("unit", "channel", "level", "restored").agg(F.min(log).alias("likely"), letters.alias("letters"))
        own = scored.filter("channel = ''").select("unit", F.col("likely").alias("as_is"))
        x = scored.filter("channel <> ''").join(own, "unit")
        gain = F.col("likely") - F.col("as_is")
        vague = (F.col("level") == 0) & ((F.coalesce("letters", F.lit(0)) < SHORT) | (gain < CLEAR))
        odds = F.when(F.col("restored").rlike(GONE), F.lit(MISSING)).otherwise(F.when(vague, F.least(gain, F.lit(0.0))).otherwise(gain))
        odds = odds + SEQUENCE * F.col("level") + F.when(F.col("unit").rlike("[\u0080-\u0084\u0086-\u009f]"), CONTROL).otherwise(0.0)
        odds = odds + F.when(F.col("restored").contains("\ufeff") & (F.col("level") > 0), MISSING).otherwise(0.0)
        odds = odds - F.when(F.col("channel").endswith(CASED), RECASED).otherwise(0.0)
        x = x.withColumn("odds", odds).filter("odds >= 0")
        return x.groupBy("unit").agg(F.collect_list(F.struct("channel", "restored", "odds")).alias("found"))

    def _refilled(self, dropped: DataFrame) -> DataFrame:
        """Units of one word that lost bytes, with the most frequent other word that fits.

        A unit meets the words of its gaps, length and ASCII letters at both ends.
        """
        gaps = dropped.select("unit", "channel", "level", F.col("restored").alias("damaged")).mapInArrow(_gaps, f"unit string, channel string, level int, damaged string, {KEYS}")
        pairs = gaps.join(self.known(), ["gaps", "length", "head", "tail"])
        kept = pairs.filter("word <> lower(unit)").select("word", "damaged", "n", "unit", "channel", "level").mapInArrow(_fill, "word string, damaged string, n bigint, unit string, channel string, level int")
        best = kept.groupBy("unit", "channel", "level").agg(F.max_by("word", F.struct("n", "word")).alias("restored"))
        return best.select("unit", "channel", "level", "restored", F.array("restored").alias("words"))

    def fixes(self) -> DataFrame:
        """(key, fixes): the damaged documents, and what to put where."""
        suspects = cut(self.suspects())
        sent = None
        if written_bytes(suspects) <= SENT_BYTES:
            sent = suspects.sparkSession.sparkContext.broadcast({r[0] for r in suspects.select("unit").collect()})
        places = self.documents.filter("key is not null").mapInArrow(_occurrences(sent), f"key {self.kind}, start int, unit string")
        hits = places.join(suspects, "unit").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "unit", "found"))).alias("pieces"))
        return hits.mapInArrow(_decide, FIXES.format(kind=self.kind))

    def found(self) -> DataFrame:
        return self.fixes().select(F.col("key").alias(self.key))

    def restored(self) -> DataFrame:
        """(key, text, channels, open): damaged documents with the text as far as it can be had.

        Lost characters are taken from the most frequent word (of ideographs, run) that fits;
        ``open`` says whether some stay lost.
        """
        fixes = cut(self.fixes())
        damaged = fixes.select(F.explode("fixes.restored").alias("restored")).filter(F.col("restored").rlike(GONE)).distinct()
        lost = cut(damaged.mapInArrow(_lost_words, f"damaged string, reading string, size int, {KEYS}, place int, left string").distinct())
        runs = self.units.mapInArrow(_ideographs, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
        known = self.known().unionByName(runs.mapInArrow(_patterns, f"word string, n bigint, {KEYS}"))
        chosen = ["word", "reading", "size", "damaged", "n"]
        ends = ["gaps", "head", "tail"]
        pairs = lost.filter("place is null").drop("length").join(known.drop("length"), ends).select(chosen)
        placed = known.filter("gaps = '*'").join(lost.filter("place is not null").select("length", "place").distinct(), "length")
        placed = placed.withColumn("left", F.expr("substring(word, place + 1, 1)")).drop(*ends)
        pairs = pairs.unionByName(placed.join(lost.drop(*ends), ["length", "place", "left"]).select(chosen))
        best = pairs.mapInArrow(_fill_lost, "word string, reading string, size int, damaged string, n bigint").groupBy("damaged").agg(F.max_by("word", F.struct("n", "word")).alias("word"))
        wanted = fixes.select("key", F.explode("fixes.restored").alias("restored")).filter(F.col("restored").rlike(GONE)).distinct()
        wanted = wanted.mapInArrow(_lost_by_key, f"key {self.kind}, damaged string").join(best, "damaged").groupBy("key").agg(F.collect_set(F.struct("damaged", "word")).alias("fill"))
        rows = self.documents.join(fixes, "key").join(wanted, "key", "left").select("key", "text", "fixes", "fill")
        out = rows.mapInArrow(_apply, f"key {self.kind}, text string, channels array<string>, open boolean")
        return out.select(F.col("key").alias(self.key), "text", "channels", "open")


#: SQL: what a word with gaps is looked up by: its ASCII letters, length, and letters at both ends.
KEYS = "gaps string, length int, head string, tail string"


def _keys_of(word: str) -> tuple[str, int, str, str]:
    gaps = pattern_of(word)
    return gaps, len(word), gaps.partition("*")[0][:3], gaps.rpartition("*")[2][-3:]


def _lost_in(text: str) -> list[str]:
    return [w for w in _LOST_WORD.findall(text) if _GONE.search(w)]


_LOST_WORD = re.compile(rf"(?:[^\W\d_]|{GONE})+")


def _lost_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(damaged, reading, size, gaps, length, place, left): words with lost characters.

    A word without ASCII letters is read with one U+FFFD for each lost character, or for each
    of its `size` bytes, and is known by its length and the first character that is left. One
    of which none is left could be any word and doesn't come out.
    """
    kinds = {"damaged": pa.string(), "reading": pa.string(), "size": pa.int32(), "gaps": pa.string(), "length": pa.int32(), "head": pa.string(), "tail": pa.string(), "place": pa.int32(), "left": pa.string()}
    for batch in batches:
        rows = []
        for w in dict.fromkeys(w.lower() for t in batch.column(0).to_pylist() for w in _lost_in(t)):
            if _ASCII_LETTER.search(w):
                rows.append((w, w, 1, *_keys_of(w), None, None))
                continue
            for size in (1, 2, 3):
                if all(len(run) % size == 0 for run in _LOST_RUN.findall(w)):
                    reading = _LOST_RUN.sub(lambda m: LOST * (len(m[0]) // size), w)  # noqa: B023
                    place = next((k for k, c in enumerate(reading) if not _GONE.match(c)), None)
                    if place is not None:
                        rows.append((w, reading, size, "*", len(reading), "", "", place, reading[place]))
        columns = list(zip(*rows)) or [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds.values())], names=list(kinds))


_ASCII_LETTER = re.compile("[a-z]")
_LOST_RUN = re.compile(f"{LOST}+")
_IDEOGRAPHS = re.compile(rf"(?<![぀-ヿ㐀-鿿{LOST}])[぀-ヿ㐀-鿿]{{2,}}(?![぀-ヿ㐀-鿿{LOST}])")


def _ideographs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole runs of ideographs, which are many words to the model, as one."""
    for batch in batches:
        rows = [(w, n) for t, n in zip(*(c.to_pylist() for c in batch.columns)) for w in set(_IDEOGRAPHS.findall(t))]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["word", "n"])


def _fill_lost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (word, reading, size, damaged, n) those where the word can have become the damaged one."""
    for batch in batches:
        words, readings, sizes = (batch.column(k).to_pylist() for k in range(3))
        fit = [fits(w, r) and _sound(w) and (s == 1 or all(len(a.encode()) == s for a, b in zip(w, r) if b == LOST)) for w, r, s in zip(words, readings, sizes)]
        yield batch.filter(pa.array(fit, pa.bool_()))


def _lost_by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [(k, w.lower()) for k, t in enumerate(batch.column(1).to_pylist()) for w in _lost_in(t)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k for k, _ in pairs], pa.int64())), pa.array([w for _, w in pairs], pa.string())], names=["key", "damaged"])


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(0).to_pylist()
        slim = batch.filter(pa.array([LOST not in w for w in words], pa.bool_()))
        yield _with_keys(slim, slim.column(0).to_pylist())


@lru_cache(1 << 14)
def _sound(word: str) -> bool:
    """Whether a word holds no UTF-8 sequences itself."""
    return other_script(word) or not any(level and not channel.endswith(DROPPED) for channel, level, _ in candidates(word))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, channels, still = [], [], []
        for row in batch.to_pylist():
            text, at, parts = row["text"], 0, []
            fill = {f["damaged"]: f["word"] for f in row["fill"] or []}
            for f in sorted(row["fixes"], key=lambda f: f["start"]):
                new = _cased(f["restored"], f["unit"]) if f["channel"].endswith(DROPPED) else f["restored"]
                for w in _lost_in(new):
                    if w.lower() in fill:
                        new = new.replace(w, _cased(fill[w.lower()], w), 1)
                parts += [text[at : f["start"]], new]
                at = f["start"] + len(f["unit"])
            out.append(_GONE.sub(LOST, "".join([*parts, text[at:]])))
            channels.append(sorted({f["channel"] for f in row["fixes"]}))
            still.append(LOST in out[-1])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(channels, pa.list_(pa.string())), pa.array(still, pa.bool_())], names=["key", "text", "channels", "open"])
