"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). A pattern can
supply its words up to `max_repeats` times, each further pass at a higher cost, and each source asks
for its target. Min-cost flow routes pattern words to source quotas. Per pattern the flow is a
number of whole passes and a rest; the rest is filled with documents in the order of a seeded hash.

Texts are read once, for their sizes. Only patterns reach the driver, a short row each, and never
documents; the plan goes back to the documents by a join, broadcast up to BROADCAST_PATTERNS rows. The
cut in the seeded order is found from sums over hash buckets, so no task ever holds a whole source.

Defined cases: a null or empty text, of any length of blanks, has size 0 and takes no words; such a
document is kept as often as its pattern is taken whole. A null source is a source of its own, last in
order. A document without any source is never taken. An empty table gives an empty mix. Rows repeated
under one doc_id are chosen together, as are all rows with a null one. Ties in the seeded order go by
doc_id. Very long texts are one document like others, so a source can miss its
target by half of its longest document. Extra columns are kept by the mix, whatever their names.
"""

from __future__ import annotations

import heapq
import json
from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_RE, free_name, materialise

BUCKET_BITS = 12
BROADCAST_PATTERNS = 100_000


def size_of(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def targets_for(sizes: dict[str | None, int], weights: tuple[float, ...] = (1, 2, 3), cap: float = 3) -> dict[str | None, float]:
    """Shares all words among the sources by weight; none gets more than `cap` times its size."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    rest, free = float(sum(sizes.values())), order
    while free:
        each = rest / sum(weight[s] for s in free)
        over = [s for s in free if each * weight[s] > cap * sizes[s]]
        if not over:
            return out | {s: each * weight[s] for s in free}
        for s in over:
            out[s] = float(cap * sizes[s])
            rest -= out[s]
        free = [s for s in free if s not in out]
    return out


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each arc (from, to, capacity, cost >= 0) of a cheapest maximum flow.

    Primal and dual in turn: node prices from shortest paths, then a blocking flow over all arcs without
    reduced cost. The number of turns is that of distinct path costs, which is small for a few passes,
    whatever the number of patterns.
    """
    graph: list[list[int]] = [[] for _ in range(n)]
    to, room, cost = [], [], []
    for a, b, c, w in arcs:
        for x, y, cap, price in ((a, b, c, w), (b, a, 0, -w)):
            graph[x].append(len(to))
            to.append(y)
            room.append(cap)
            cost.append(price)
    high = [0] * n
    while True:
        dist: list[float] = [float("inf")] * n
        dist[source], heap = 0, [(0, source)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > dist[x]:
                continue
            for e in graph[x]:
                if room[e] > 0 and (new := d + cost[e] + high[x] - high[to[e]]) < dist[to[e]]:
                    dist[to[e]] = new
                    heapq.heappush(heap, (new, to[e]))
        if dist[sink] == float("inf"):
            return [room[2 * i + 1] for i in range(len(arcs))]
        far = dist[sink]
        high = [h + min(d, far) for h, d in zip(high, dist, strict=True)]
        while _blocking_flow(graph, to, room, cost, high, source, sink):
            pass


def _blocking_flow(graph: list[list[int]], to: list[int], room: list[int], cost: list[int], high: list[int], source: int, sink: int) -> bool:
    """Fills all shortest ways over arcs without reduced cost; false if there is none."""
    level = [-1] * len(graph)
    level[source], queue = 0, deque([source])
    while queue:
        x = queue.popleft()
        for e in graph[x]:
            y = to[e]
            if level[y] < 0 and room[e] > 0 and cost[e] + high[x] == high[y]:
                level[y] = level[x] + 1
                queue.append(y)
    if level[sink] < 0:
        return False
    at, way, x = [0] * len(graph), [], source
    while True:
        if x == sink:
            push = min(room[e] for e in way)
            for e in way:
                room[e] -= push
                room[e ^ 1] += push
            first = next(i for i, e in enumerate(way) if not room[e])
            x = to[way[first] ^ 1]
            del way[first:]
            continue
        own = graph[x]
        while at[x] < len(own):
            e = own[at[x]]
            if room[e] > 0 and level[to[e]] == level[x] + 1 and cost[e] + high[x] == high[to[e]]:
                break
            at[x] += 1
        if at[x] < len(own):
            way.append(own[at[x]])
            x = to[way[-1]]
        elif way:
            x = to[way.pop() ^ 1]
            at[x] += 1
        else:
            return True


def route(sizes: dict[tuple, int], targets: dict[str | None, float], max_repeats: int = 3) -> tuple[dict[tuple, int], dict[tuple, int]]:
    """Words taken of each pattern, and of each (pattern, source). The k-th pass over a pattern costs 2k-1 a word."""
    patterns, sources = list(sizes), list(targets)
    node = {s: 2 + len(patterns) + i for i, s in enumerate(sources)}
    arcs = [(0, 2 + i, sizes[p], 2 * k + 1) for i, p in enumerate(patterns) for k in range(max_repeats)]
    links = [(i, p, s) for i, p in enumerate(patterns) for s in dict.fromkeys(p) if s in node]
    arcs += [(2 + i, node[s], max_repeats * sizes[p], 0) for i, p, s in links]
    arcs += [(node[s], 1, round(targets[s]), 0) for s in sources]
    flow = min_cost_flow(2 + len(patterns) + len(sources), arcs, 0, 1)
    taken = {p: sum(flow[i * max_repeats : (i + 1) * max_repeats]) for i, p in enumerate(patterns)}
    at = len(patterns) * max_repeats
    return taken, {(p, s): flow[at + j] for j, (_, p, s) in enumerate(links)}


@dataclass
class Plan:
    """A row per pattern: whole passes and the cut in the seeded order. `sized` has id, pattern and size of each document."""

    rows: list[tuple]
    seed: int
    source_sizes: dict[str | None, int]
    targets: dict[str | None, float]
    flow: dict[tuple, int]
    sized: DataFrame


def pattern_of(members: Column) -> Column:
    """A document's sources as text: distinct, in order."""
    return F.to_json(F.array_sort(F.array_distinct(members)), {"ignoreNullFields": "false"})


def _seeded(doc_id: Column, seed: int) -> Column:
    return F.xxhash64(doc_id, F.lit(seed)).bitwiseAND(F.lit((1 << 63) - 1))


def short_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of the plan, broadcast if it is short."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_PATTERNS else df


def plan(docs: DataFrame, members: Column, targets=targets_for, seed: int = 17, max_repeats: int = 3) -> Plan:
    """Aggregates, solves the flow and finds each pattern's cut. `members`: array of a document's sources."""
    sized = materialise(docs.select(F.col("doc_id").alias("id"), pattern_of(members).alias("pattern"), size_of(F.col("text")).alias("size")), "mix")
    seeded = sized.withColumn("u", _seeded(F.col("id"), seed))
    # in order, so that of equally cheap flows reruns choose the same
    found = sorted(sized.groupBy("pattern").agg(F.sum("size").alias("size")).collect(), key=lambda r: r["pattern"] or "")
    sizes = {tuple(json.loads(r["pattern"] or "[]")): int(r["size"]) for r in found}
    keys = {tuple(json.loads(r["pattern"] or "[]")): r["pattern"] for r in found}
    of_source: dict[str | None, int] = {}
    for p, n in sizes.items():
        for s in dict.fromkeys(p):
            of_source[s] = of_source.get(s, 0) + n
    wanted = targets(of_source)
    taken, flow = route(sizes, wanted, max_repeats)
    whole = {p: min(max_repeats, taken[p] // sizes[p]) if sizes[p] else 0 for p in sizes}
    rest = {p: taken[p] - whole[p] * sizes[p] for p in sizes}
    spark = docs.sparkSession
    rests = [(keys[p], int(r)) for p, r in rest.items() if r > 0]
    cuts: dict[str, tuple[int, int]] = {}
    if rests:
        part = seeded.join(short_table(spark, rests, "pattern string, rest bigint"), "pattern").withColumn("bucket", F.shiftright("u", 63 - BUCKET_BITS))
        sums = part.groupBy("pattern", "bucket", "rest").agg(F.sum("size").alias("size"))
        before = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        edge = sums.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).where("before < rest and before + size >= rest")
        edges = [tuple(r) for r in edge.select("pattern", "bucket", "before", "rest").collect()]
        inside = Window.partitionBy("pattern", "bucket").orderBy("u", "id").rowsBetween(Window.unboundedPreceding, -1)
        near = part.drop("rest").join(short_table(spark, edges, "pattern string, bucket bigint, before bigint, rest bigint"), ["pattern", "bucket"])
        near = near.withColumn("done", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        # a document is taken while at least half of it is still wanted; else the order ends before it
        first_out = near.where(F.col("done") + F.col("size") / 2 > F.col("rest"))
        out = {r["pattern"]: (r["at"]["u"], r["at"]["id"]) for r in first_out.groupBy("pattern").agg(F.min(F.struct("u", "id")).alias("at")).collect()}
        for pattern, bucket, _, _ in edges:
            cuts[pattern] = out.get(pattern, (min((bucket + 1) << (63 - BUCKET_BITS), (1 << 63) - 1), None))
    rows = [(k, whole[p], *cuts.get(k, (0, None))) for p, k in keys.items()]
    return Plan(rows, seed, of_source, wanted, flow, sized)


def times(df: DataFrame, p: Plan, doc_id: str, pattern: str | Column, into: str) -> DataFrame:
    """Adds the number of times that each document is taken; no shuffle while the plan is short."""
    key, mine, whole, cut, cut_id = (free_name(df, x) for x in ("_key", "_pattern", "_whole", "_cut", "_cut_id"))
    table = short_table(df.sparkSession, p.rows, f"{mine} string, {whole} bigint, {cut} bigint, {cut_id} bigint")
    u = _seeded(F.col(doc_id), p.seed)
    more = (u < F.col(cut)) | ((u == F.col(cut)) & (F.col(doc_id) < F.col(cut_id)))
    joined = df.withColumn(key, F.col(pattern) if isinstance(pattern, str) else pattern).join(table, F.col(key) == F.col(mine), "left")
    return joined.withColumn(into, F.coalesce(F.col(whole) + F.coalesce(more, F.lit(False)).cast("long"), F.lit(0))).drop(key, mine, whole, cut, cut_id)


def repeats(docs: DataFrame, p: Plan, members: Column, into: str) -> DataFrame:
    """`times` for a table with the documents' own columns."""
    return times(docs, p, "doc_id", pattern_of(members), into)


def mix(docs: DataFrame, members: Column, **options) -> DataFrame:
    """The mix: each document as often as it is taken, with its columns."""
    n, copy = free_name(docs, "_times"), free_name(docs, "_copy")
    taken = repeats(docs, plan(docs, members, **options), members, n).where(F.col(n) > 0)
    return taken.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(n).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
