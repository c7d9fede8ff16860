"""Mixing sources to target weights by min-cost flow over membership patterns."""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, fresh, table, without

#: Membership patterns (and sources) that the driver plans for; more raise an error, none is dropped.
MAX_PATTERNS = 50_000
#: Bits of a document's seeded hash that the first cut of a pattern looks at.
CUT_BITS = 12


def source_order(names: list[str | None]) -> list[str | None]:
    """By code point, null last."""
    return sorted((n for n in names if n is not None)) + [None] * (None in names)


def targets(sizes: dict, weights: dict, share: float = 1.5, cap: float = 2.0) -> dict:
    """Tokens wanted of each source: share of all tokens by weight, at most cap times a source's tokens.

    What is above a cap is shared again by weight among the others until none is above.
    """
    left, open_, out = share * sum(sizes.values()), set(sizes), {}
    while open_:
        total = sum(weights[s] for s in open_)
        wish = {s: left * weights[s] / total for s in open_}
        over = {s for s in open_ if wish[s] > cap * sizes[s]}
        if not over:
            return out | wish
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over
    return out


@dataclass
class Arc:
    to: int
    room: int
    cost: int
    back: int


class Network:
    """Min-cost flow by successive shortest paths with potentials; integer capacities and costs."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[Arc]] = [[] for _ in range(nodes)]

    def arc(self, a: int, b: int, room: int, cost: int) -> Arc:
        there = Arc(b, room, cost, len(self.out[b]))
        self.out[a].append(there)
        self.out[b].append(Arc(a, 0, -cost, len(self.out[a]) - 1))
        return there

    def run(self, start: int, end: int) -> None:
        height = [0] * len(self.out)
        while True:
            far: list[float] = [float("inf")] * len(self.out)
            by: list[tuple[int, Arc] | None] = [None] * len(self.out)
            far[start] = 0
            queue = [(0, start)]
            while queue:
                d, a = heapq.heappop(queue)
                if d > far[a]:
                    continue
                for x in self.out[a]:
                    if x.room and (new := d + x.cost + height[a] - height[x.to]) < far[x.to]:
                        far[x.to], by[x.to] = new, (a, x)
                        heapq.heappush(queue, (new, x.to))
            if by[end] is None:
                return
            height = [h + d if d < float("inf") else h for h, d in zip(height, far, strict=True)]
            room, at = float("inf"), end
            while at != start:
                at, x = by[at]
                room = min(room, x.room)
            at = end
            while at != start:
                at, x = by[at]
                x.room -= int(room)
                self.out[x.to][x.back].room += int(room)


def route(patterns: dict[str, int], members: dict[str, list], quota: dict, epochs: int) -> dict[str, dict]:
    """Tokens of each pattern for each of its sources. The k-th pass over a pattern's tokens costs k*k a token, so passes are spread evenly and repeats come last."""
    names, sources = list(patterns), list(quota)
    at = {s: 1 + len(names) + i for i, s in enumerate(sources)}
    net, end = Network(len(names) + len(sources) + 2), len(names) + len(sources) + 1
    flows: dict[str, dict] = {p: {} for p in names}
    for i, p in enumerate(names, 1):
        for k in range(1, epochs + 1):
            net.arc(0, i, patterns[p], k * k)
        for s in members[p]:
            flows[p][s] = net.arc(i, at[s], epochs * patterns[p], 0)
    for s in sources:
        net.arc(at[s], end, round(quota[s]), 0)
    net.run(0, end)
    return {p: {s: epochs * patterns[p] - x.room for s, x in flows[p].items()} for p in names}


def mix(docs: DataFrame, members: Column, size: Column, weights: dict | None = None, cycle: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(docs with size long and copies int, plan).

    members: array of the sources that a document belongs to (null or empty: the null source; null is a
    source like others); size: tokens of a document, null as 0. weights: by source, or else cycle over
    the sources by code point, null last. A document of several sources serves any of them: the flow
    routes each pattern's tokens to quotas at the least cost of repeats, at most cap passes over any.
    plan has a row for each pattern: pattern string (JSON), pattern_size, flow map of source to tokens,
    whole long (passes taken by all its documents), limit long (a document whose seeded hash of doc_id
    is at most this is taken once more; -1: none).

    Rows of one doc_id are taken alike. Documents without tokens get the copies of their hash, too, at most
    cap; they change no sum. An empty table gives no rows. Columns named size, copies, pattern, pattern_size,
    flow, whole or limit are replaced. Same seed, same result.
    """
    spark = docs.sparkSession
    docs = without(docs, "size", "copies", "pattern", "pattern_size", "flow", "whole", "limit")
    (h,) = fresh(docs, "_hash")
    null = F.array(F.lit(None).cast("string"))
    norm = F.array_sort(F.array_distinct(F.when(F.size(members) > 0, members).otherwise(null)))
    sized = docs.withColumns({"pattern": F.to_json(norm), "size": F.coalesce(size, F.lit(0)).cast("long"), h: F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 1)})
    light = cut(sized.select("pattern", "size", h))
    cells = cut(light.groupBy("pattern", F.shiftright(h, 63 - CUT_BITS).alias("cell")).agg(F.sum("size").alias("size")))
    rows = cells.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    capacity = {r["pattern"]: r["size"] for r in sorted(rows, key=lambda r: r["pattern"])}
    of = {p: json.loads(p) for p in capacity}
    names = source_order(list({s for x in of.values() for s in x}))
    sizes = {s: sum(capacity[p] for p in of if s in of[p]) for s in names}
    goal = targets(sizes, weights or {s: cycle[i % len(cycle)] for i, s in enumerate(names)}, share, cap)
    flow = route(capacity, of, goal, cap)
    plan, part = [], []
    for p, n in capacity.items():
        whole, rest = divmod(sum(flow[p].values()), n) if n else (0, 0)
        part.append((p, rest))
        plan.append((p, n, [(json.dumps(s), f) for s, f in flow[p].items()], whole))
    planned = spark.createDataFrame([(p, n, dict(f), w) for p, n, f, w in plan], "pattern string, pattern_size long, flow map<string,long>, whole long")
    wanted = spark.createDataFrame(part, "pattern string, rest long")
    # the hash up to which a pattern's documents make up rest: first the cell in which it lies, then inside that cell
    w = Window.partitionBy("pattern").orderBy("cell")
    cell = (
        cells.join(F.broadcast(wanted), "pattern")
        .withColumn("upto", F.sum("size").over(w))
        .filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("size") <= F.col("rest")))
        .select("pattern", "cell", (F.col("rest") - F.col("upto") + F.col("size")).alias("rest"))
    )
    wh = Window.partitionBy("pattern").orderBy(h)
    inside = (
        light.withColumn("cell", F.shiftright(h, 63 - CUT_BITS))
        .join(F.broadcast(cell), ["pattern", "cell"])
        .groupBy("pattern", "cell", "rest", h)
        .agg(F.sum("size").alias("size"))
        .withColumn("off", F.abs(F.sum("size").over(wh) - F.col("rest")))
    )
    first = F.shiftleft(F.col("cell"), 63 - CUT_BITS) - 1
    limits = inside.groupBy("pattern", "cell", "rest").agg(F.min(F.struct("off", h)).alias("m")).select("pattern", F.when(F.col("m.off") < F.col("rest"), F.col(f"m.{h}")).otherwise(first).alias("limit"))
    full = wanted.filter("rest = 0").select("pattern", F.lit(True).alias("full"))  # no document is taken once more, those without tokens included
    limit = F.when(F.col("full"), F.lit(-1)).otherwise(F.coalesce("limit", F.lit(-1))).alias("limit")
    plan_df = cut(planned.join(limits, "pattern", "left").join(full, "pattern", "left").select(*planned.columns, limit))
    taken = sized.join(F.broadcast(plan_df), "pattern")
    out = taken.withColumn("copies", (F.col("whole") + F.when(F.col(h) <= F.col("limit"), 1).otherwise(0)).cast("int"))
    quota = spark.createDataFrame([(s, sizes[s], float(goal[s])) for s in names], "source string, source_size long, target double")
    # as Spark writes patterns: Python would escape other characters
    quota = quota.select(F.to_json(F.array("source")).alias("source_json"), "source_size", "target")
    return out.drop(h, "whole", "limit", "flow", "pattern_size"), quota


def words(text: Column) -> Column:
    """Runs of anything but white space in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def mix_documents(docs: DataFrame) -> DataFrame:
    """docs as they are mixed: a document taken twice comes twice, one that isn't taken goes."""
    mixed, _ = mix(docs, F.array("source"), words(F.col("text")))
    (n,) = fresh(docs, "_n")
    return mixed.filter("copies > 0").withColumn(n, F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document, sources weighing 5, 2, 1 in turn; in the manner of mix."""
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", words(F.col("text")).alias("n_words"))
    mixed, quota = mix(sized, F.array("source"), F.col("n_words"))
    return mixed.join(F.broadcast(quota), mixed["pattern"] == quota["source_json"]).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
