"""Mixes of sources in target shares of tokens, with capped repetition."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Collection
from math import ceil
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.llm.seeded import priority, weight_before
from gleanery.runtime import cut

#: The k-th use of a text costs k up to this, then one more each time the uses double.
LINEAR_LEVELS = 64


class _Flow:
    """Min-cost flow by successive cheapest paths; costs are small integers."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.left: list[int] = []
        self.cost: list[int] = []

    def edge(self, a: int, b: int, room: int, cost: int = 0) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.left.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> None:
        """Sends all it can. The paths of one cost are used up together, by a blocking flow over
        the edges that lie on cheapest paths."""
        while True:
            far = 1 << 60
            dist, queued, queue = [far] * len(self.out), [False] * len(self.out), [source]
            dist[source] = 0
            for a in queue:
                queued[a] = False
                for e in self.out[a]:
                    b = self.to[e]
                    if self.left[e] > 0 and dist[a] + self.cost[e] < dist[b]:
                        dist[b] = dist[a] + self.cost[e]
                        if not queued[b]:
                            queued[b] = True
                            queue.append(b)
            if dist[sink] == far:
                return
            self._block(source, sink, dist)

    def _block(self, source: int, sink: int, dist: list[int]) -> None:
        """Maximal flow over the edges of cheapest paths: those with the fewest edges first, each
        edge tried once for a number of edges."""
        while True:
            steps, queue = {source: 0}, [source]
            for a in queue:
                for e in self.out[a]:
                    b = self.to[e]
                    if self.left[e] > 0 and b not in steps and dist[b] == dist[a] + self.cost[e]:
                        steps[b] = steps[a] + 1
                        queue.append(b)
            if sink not in steps:
                return
            tried, path, at = [0] * len(self.out), [], source
            while True:
                if at == sink:
                    much = min(self.left[e] for e in path)
                    for e in path:
                        self.left[e] -= much
                        self.left[e ^ 1] += much
                    path, at = [], source
                edges = self.out[at]
                while tried[at] < len(edges):
                    e = edges[tried[at]]
                    b = self.to[e]
                    if self.left[e] > 0 and steps.get(b) == steps[at] + 1 and dist[b] == dist[at] + self.cost[e]:
                        path.append(e)
                        at = b
                        break
                    tried[at] += 1
                else:
                    if at == source:
                        break
                    at = self.to[path.pop() ^ 1]
                    tried[at] += 1


def route(texts: dict[Collection, int], rows: dict[tuple[Collection, str], int], quotas: dict[str, int], repeats: dict[str, int]) -> dict[tuple[Collection, str], int]:
    """Tokens that each (pattern, source) gives to the source's quota.

    `texts`: tokens of the distinct texts of a pattern (the set of sources that hold them),
    `rows`: tokens of a source's documents in a pattern. A source gives each document at most
    repeats[source] times; the k-th use of a text, by whatever source, costs k (beyond
    `LINEAR_LEVELS` one more for each doubling, so that the network stays small however often
    a text may be used).
    """
    patterns, sources = list(texts), list(quotas)
    flow = _Flow(len(patterns) + len(sources) + 2)
    sink = len(patterns) + len(sources) + 1
    place = {s: 1 + len(patterns) + k for k, s in enumerate(sources)}
    used = {}
    for k, p in enumerate(patterns, 1):
        possible = sum(repeats[s] * rows.get((p, s), 0) for s in p if s in place)
        level, step = 1, max(1, texts[p])
        while possible > 0:
            room = min(step, possible)
            flow.edge(0, k, room, level)
            possible -= room
            level += 1
            if level > LINEAR_LEVELS:
                step *= 2 if level > LINEAR_LEVELS + 1 else LINEAR_LEVELS
        for s in p:
            if s in place and rows.get((p, s)):
                used[p, s] = flow.edge(k, place[s], repeats[s] * rows[p, s])
    for s in sources:
        flow.edge(place[s], sink, quotas[s])
    flow.run(0, sink)
    return {key: flow.left[e ^ 1] for key, e in used.items() if flow.left[e ^ 1]}


class Flows(NamedTuple):
    """(mix_id, pattern, source, kin, capacity, flow) of what is used; the pattern of each
    (text_key, source); (mix_id, source, quota, unfilled) of every target."""

    used: DataFrame
    held: DataFrame
    targets: DataFrame


class SourceMix:
    """Documents of several sources in target shares.

    `documents`: ``doc``, ``source``, ``text_key`` (equal for equal texts) and ``tokens``; rows
    with null source or without tokens can't be drawn, but their tokens count in the total.
    `targets`: mix_id, total_share, source, target_share, max_repeats; rows with nulls are no
    targets. Targets and what sources a mix's patterns have of them are solved on the driver;
    documents stay distributed.
    """

    def __init__(self, spark: SparkSession, documents: DataFrame, targets: DataFrame, seed: int = 42):
        self.spark, self.seed = spark, seed
        self.documents = cut(documents.select("doc", "source", "text_key", "tokens"))
        self.targets = targets.select("mix_id", "total_share", "source", "target_share", "max_repeats").dropna()
        sizes = self.documents.groupBy("source").agg(F.sum("tokens").alias("tokens"))
        self.total = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
        self.sizes = sizes.filter("source is not null")
        self._flows: Flows | None = None

    def demands(self) -> DataFrame:
        """Each target with the tokens it asks for (``quota``) and those it may use (``capacity``)."""
        quota = F.col("target_share") * F.col("total_share") * F.lit(self.total)
        capacity = F.col("max_repeats") * F.coalesce("tokens", F.lit(0))
        return self.targets.join(self.sizes, "source", "left").select("mix_id", "source", "target_share", "max_repeats", quota.alias("quota"), capacity.alias("capacity"))

    def unmet(self) -> DataFrame:
        """The targets whose edge to the sink keeps room once the flow has sent all it can."""
        return self.flows().targets.filter("unfilled > 0").select("mix_id", "source")

    def _patterns(self) -> DataFrame:
        """(text_key, source) rows with the pattern of the text."""
        held = self.documents.filter("source is not null and tokens > 0").groupBy("text_key", "source").agg(F.sum("tokens").alias("tokens"), F.max("tokens").alias("once"))
        texts = held.groupBy("text_key").agg(F.sort_array(F.collect_set("source")).alias("pattern"), F.max("once").alias("once"))
        return held.select("text_key", "source", "tokens").join(texts, "text_key")

    def flows(self) -> Flows:
        """The solved network of every mix; solved once.

        To a mix, patterns differ only in the sources it has targets for: they are narrowed to
        those (``kin``) and added up before the driver takes them. Quotas are rounded up to
        whole tokens.
        """
        if self._flows is None:
            self._flows = self._solved()
        return self._flows

    def _solved(self) -> Flows:
        held = self._patterns()
        sums = held.groupBy("pattern", "source").agg(F.sum("tokens").alias("tokens"), F.sum("once").alias("once"))
        kin = F.to_json(F.sort_array(F.collect_set("source").over(W.partitionBy("mix_id", "pattern"))))
        narrow = cut(sums.join(self.targets.select("mix_id", "source").distinct(), "source").withColumn("kin", kin))
        merged = narrow.groupBy("mix_id", "kin", "source").agg(F.sum("tokens").alias("tokens"), F.sum("once").alias("once")).collect()
        texts: dict = defaultdict(dict)
        rows: dict = defaultdict(dict)
        for r in sorted(merged):
            p = tuple(json.loads(r["kin"]))
            texts[r["mix_id"]][p] = r["once"]  # the same for each of its sources
            rows[r["mix_id"]][p, r["source"]] = r["tokens"]
        mixes = defaultdict(list)
        for t in self.demands().collect():
            mixes[t["mix_id"]].append(t)
        names = {(r["mix_id"], tuple(json.loads(r["kin"]))): r["kin"] for r in merged}
        out, reached = [], []
        for mix, targets in mixes.items():
            quotas: dict[str, int] = defaultdict(int)
            for t in targets:
                quotas[t["source"]] = max(quotas[t["source"]], ceil(t["quota"]))
            flow = route(texts[mix], rows[mix], quotas, {t["source"]: t["max_repeats"] for t in targets})
            out += [(mix, names[mix, p], s, rows[mix][p, s], got) for (p, s), got in flow.items()]
            sent: dict[str, int] = defaultdict(int)
            for (_, s), got in flow.items():
                sent[s] += got
            reached += [(mix, s, q, q - sent[s]) for s, q in quotas.items()]
        kind = self.targets.schema["mix_id"].dataType.simpleString()
        solved = self.spark.createDataFrame(out, f"mix_id {kind}, kin string, source string, capacity bigint, flow bigint")
        ends = self.spark.createDataFrame(reached, f"mix_id {kind}, source string, quota bigint, unfilled bigint")
        return Flows(narrow.select("mix_id", "kin", "source", "pattern").join(solved, ["mix_id", "kin", "source"]), held, ends)

    def draw(self) -> DataFrame:
        """(mix_id, source, doc, tokens, repeats): the documents of each mix and how often each is used.

        Each document is used as often as all of its (pattern, source) can be; those that come
        first in a seeded order once more, up to the flow. What rounding to whole documents left
        over or under in a source is made good by one use more or less of further documents in
        another order, to within half a document where any of that size is left.
        """
        flows, held, _ = self.flows()
        docs = self.documents.filter("source is not null and tokens > 0").join(held.select("text_key", "source", "pattern"), ["text_key", "source"])
        rows = docs.join(flows, ["pattern", "source"]).withColumn("__order", priority(self.seed, "doc"))
        rows = weight_before(rows, ["mix_id", "source", "kin"], "__order", "doc", F.col("tokens"))
        extra = F.col("before") + F.col("tokens") / 2 <= F.col("flow") % F.col("capacity")
        rows = cut(rows.select("mix_id", "source", "doc", "tokens", (F.expr("flow div capacity") + extra.cast("bigint")).alias("repeats")))
        key = ["mix_id", "source"]
        aim = flows.select(*key, "kin", "flow").distinct().groupBy(*key).agg(F.sum("flow").alias("__aim"))
        off = rows.groupBy(*key).agg(F.sum(F.col("tokens") * F.col("repeats")).alias("__got")).join(aim, key).select(*key, (F.col("__aim") - F.col("__got")).alias("__off"))
        rows = rows.join(off.join(self.targets.groupBy(*key).agg(F.max("max_repeats").alias("__most")), key), key)
        may = F.when(F.col("__off") > 0, F.col("repeats") < F.col("__most")).otherwise(F.col("repeats") > 0) & (F.col("tokens") <= 2 * F.abs("__off"))
        rows = rows.withColumn("__may", may).withColumn("__order", priority(self.seed + 1, "doc"))
        rows = weight_before(rows, key, "__order", "doc", F.when(F.col("__may"), F.col("tokens")).otherwise(F.lit(0)))
        change = F.when(F.col("__may") & (F.col("before") + F.col("tokens") / 2 <= F.abs("__off")), F.signum("__off").cast("bigint")).otherwise(F.lit(0))
        return rows.withColumn("repeats", F.col("repeats") + change).filter("repeats > 0").select("mix_id", "source", "doc", "tokens", "repeats")

    def shares(self) -> DataFrame:
        """Tokens and share of the mix that each target asked for and got."""
        got = self.draw().groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("reached"))
        x = self.demands().join(got, ["mix_id", "source"], "left").withColumn("reached", F.coalesce("reached", F.lit(0)))
        share = F.col("reached") / F.sum("reached").over(W.partitionBy("mix_id"))
        return x.select("mix_id", "source", "target_share", "max_repeats", "quota", "capacity", "reached", share.alias("reached_share"))
