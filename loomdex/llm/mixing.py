"""Mixing sources to target weights: a min-cost flow from membership patterns to source quotas."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomdex.common import written
from loomdex.llm import tokens

#: Ranges of the seeded order over which running sums are taken in parallel: at least so many, and so many texts in each of a
#: pattern that holds all.
BUCKETS, BUCKET_TEXTS = 1 << 12, 20_000
#: Most membership patterns the driver routes; k sources have fewer than 2**k.
MOST_PATTERNS = 100_000


class Flow:
    """Maximum flow over integer capacities (level graphs and blocking flows)."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.left: list[int] = []
        self.out: dict[object, list[int]] = {}
        self.tail: list[object] = []

    def arc(self, a: object, b: object, most: int) -> int:
        for x, y, c in ((a, b, most), (b, a, 0)):
            self.out.setdefault(x, []).append(len(self.to))
            self.to.append(y)
            self.left.append(c)
        return len(self.to) - 2

    def run(self, s: object, t: object) -> int:
        total = 0
        while True:
            level, queue = {s: 0}, deque([s])
            while queue:
                for e in self.out[x := queue.popleft()]:
                    if self.left[e] and self.to[e] not in level:
                        level[self.to[e]] = level[x] + 1
                        queue.append(self.to[e])
            if t not in level:
                self.reached = set(level)
                return total
            at = dict.fromkeys(level, 0)
            while True:
                path, x = [], s
                while x != t:
                    arcs = self.out[x]
                    while at[x] < len(arcs) and not (self.left[arcs[at[x]]] and level.get(self.to[arcs[at[x]]]) == level[x] + 1):
                        at[x] += 1
                    if at[x] == len(arcs):
                        if x == s:
                            break
                        x = self.to[path.pop() ^ 1]
                        at[x] += 1
                    else:
                        path.append(arcs[at[x]])
                        x = self.to[path[-1]]
                if x == s:
                    break
                push = min(self.left[e] for e in path)
                total += push
                for e in path:
                    self.left[e] -= push
                    self.left[e ^ 1] += push


def route(capacity: dict[tuple[str, ...], int], weights: dict[str, float], repeats: dict[str, int], total: int | None = None) -> tuple[dict[tuple[tuple[str, ...], str], int], dict[str, int]]:
    """Tokens each pattern gives each source, and each source's quota.

    capacity: tokens of each pattern (a sorted tuple of sources that hold the same texts). A text is used at most
    repeats[s] times for source s and max(repeats of its sources) times in all; using it for the (r+1)-th time costs r.
    The sources with texts share the total by their weights. Without ``total`` it is the largest at which every
    quota is filled, found by following minimum cuts. The costs stand only on the arcs that leave the start, one
    for each repetition, so filling these levels in rising order of cost gives the cheapest of all maximum flows."""
    have = sorted({s for p in capacity for s in p if weights.get(s, 0) > 0 and repeats.get(s, 0) > 0})
    share = sum(weights[s] for s in have)

    def solve(quota: dict[str, int]) -> tuple[Flow, dict, int]:
        g, arcs, got = Flow(), {}, 0
        g.out["start"], g.out["end"] = [], []
        for s in have:
            g.arc(("s", s), "end", quota[s])
        for p, c in capacity.items():
            for s in set(p) & set(have):
                arcs[p, s] = g.arc(("p", p), ("s", s), c * repeats[s])
        for level in range(1, max((repeats[s] for s in have), default=0) + 1):
            for p, c in capacity.items():
                if max((repeats[s] for s in p if s in have), default=0) >= level:
                    g.arc("start", ("p", p), c)
            got += g.run("start", "end")
        return g, arcs, got

    def quotas(t: int) -> dict[str, int]:
        return {s: int(t * weights[s] / share) for s in have}

    if total is None:
        total = min((int(sum(c for p, c in capacity.items() if s in p) * repeats[s] * share / weights[s]) for s in have), default=0)
        while True:
            quota = quotas(total)
            g, arcs, got = solve(quota)
            if got == sum(quota.values()):
                break
            starved = [s for s in have if ("s", s) not in g.reached]  # beyond the cut: all that can reach them does
            supply = got - sum(quota[s] for s in have if s not in starved)
            total = max(0, min(total - 1, int(supply * share / sum(weights[s] for s in starved))))
    quota = quotas(total)
    g, arcs, _ = solve(quota)
    return {k: g.left[e ^ 1] for k, e in arcs.items() if g.left[e ^ 1]}, quota


def sized_texts(documents: DataFrame, targets: DataFrame, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """(digest, source, doc_id, tokens): each distinct text of each target source, by its least doc_id, written once.

    Null and empty texts and rows of other or null sources are left out."""
    names = targets.select("source").filter("source IS NOT NULL").distinct()
    rows = documents.filter(F.length("text") > 0).join(names, "source", "left_semi")
    rows = rows.select(F.struct(F.md5(F.encode("text", "utf-8")).alias("digest"), "source", "doc_id").alias("key"), "text")
    sized = tokens.encode(rows, "key", "text", vocabulary, counts=True).select("key.*", "tokens")
    return written(sized.groupBy("digest", "source").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens")), "sized")


class Mix:
    """A mix of the sources of ``documents`` to the weights of ``targets`` (source, weight, max_repeats).

    The unit is the distinct text; texts that several sources hold may serve any of them. Repeated rows of targets count
    once; of two rows with one source the greater weight holds. Null weights or repeats count as 0. Without usable
    texts nothing is used and shares are null."""

    def __init__(self, documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 1, vocabulary: str = tokens.VOCABULARY) -> None:
        self.spark, self.seed = documents.sparkSession, seed
        self.targets = targets.filter("source IS NOT NULL").groupBy("source").agg(F.max_by(F.struct(F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats")), F.struct("weight", "max_repeats")).alias("x")).select("source", "x.*")
        self.rows = sized_texts(documents, targets, vocabulary)
        self.texts = self.rows.groupBy("digest").agg(F.max("tokens").alias("tokens"), F.array_sort(F.collect_set("source")).alias("pattern"))  # as many as there are targets, at most
        stats = self.texts.groupBy("pattern").agg(F.sum("tokens").alias("n")).limit(MOST_PATTERNS + 1).collect()
        if len(stats) > MOST_PATTERNS:
            raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
        want = self.targets.collect()  # one row for each source of the mix
        self.flow, self.quota = route({tuple(x.pattern): x.n for x in stats if x.n}, {x.source: x.weight for x in want}, {x.source: x.max_repeats for x in want}, total)

    def selection(self) -> DataFrame:
        """doc_id, source, tokens, uses: the texts used for each source and how often.

        A pattern's texts lie on a ring in seeded order, each as long as its tokens; its sources take consecutive
        stretches of it, round after round, and a text is used as often as a stretch covers its beginning. So the uses of
        any two texts differ by one at most, and a source's sum differs from its flow by less than one text for each
        pattern. Running sums are taken in ranges of the order at once, whose number grows with the texts."""
        rows, begin = [], {}
        for (p, s), n in sorted(self.flow.items()):
            rows.append((list(p), s, begin.get(p, 0), n))
            begin[p] = begin.get(p, 0) + n
        plan = F.broadcast(self.spark.createDataFrame(rows, "pattern array<string>, source string, lo long, n long"))  # one row for each arc of the flow
        order = F.xxhash64(F.lit(self.seed), F.col("digest"))
        bits = max(BUCKETS.bit_length() - 1, (self.rows.count() // BUCKET_TEXTS).bit_length())
        t = self.texts.filter("tokens > 0").withColumn("order", order).withColumn("bucket", F.shiftrightunsigned("order", 64 - bits))
        ahead = t.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("n"))
        w = Window.partitionBy("pattern").orderBy("bucket")
        ahead = ahead.withColumn("ahead", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).withColumn("ring", F.sum("n").over(Window.partitionBy("pattern"))).drop("n")
        w = Window.partitionBy("pattern", "bucket").orderBy("order", "digest").rowsBetween(Window.unboundedPreceding, 0)
        t = t.withColumn("at", F.sum("tokens").over(w) - F.col("tokens")).join(ahead, ["pattern", "bucket"]).withColumn("at", F.col("at") + F.col("ahead"))
        upto = lambda x: F.floor((x - F.col("at") + F.col("ring") - 1) / F.col("ring")).cast("long")  # noqa: E731  beginnings before x
        t = t.join(plan, "pattern").withColumn("uses", upto(F.col("lo") + F.col("n")) - upto(F.col("lo"))).filter("uses > 0")
        return t.select("digest", "source", "uses").join(self.rows, ["digest", "source"]).select("doc_id", "source", "tokens", "uses")

    def report(self) -> DataFrame:
        """Per source of the mix: weight, max_repeats, its documents (distinct texts) and their tokens, quota, documents and
        tokens used (each use counted), most uses of a text, uses in all, and the actual share of the tokens used."""
        have = self.rows.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))
        used = self.selection().groupBy("source").agg(F.count("*").alias("used_documents"), F.sum("uses").alias("uses"), F.max("uses").alias("most_uses"), F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"))
        quota = self.spark.createDataFrame(list(self.quota.items()), "source string, quota long")
        out = self.targets.join(have, "source", "left").join(F.broadcast(quota), "source", "left").join(used, "source", "left")
        out = out.fillna(0, ["documents", "tokens", "quota", "used_documents", "uses", "most_uses", "used_tokens"])
        return out.withColumn("share", F.col("used_tokens") / F.nullif(F.sum("used_tokens").over(Window.partitionBy(F.lit(1))), F.lit(0)))  # one row for each source
