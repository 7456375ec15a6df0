import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from formweave.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, sources array<string>, _times int, _copy int, _key string, n int"


def plain_cost(sizes, targets, repeats=3):
    """The most words that can be routed and the least cost of that, by trying all numbers of words of each pattern."""
    patterns, sources = list(sizes), list(targets)
    best = (-1, 0)
    for taken in itertools.product(*(range(repeats * sizes[p] + 1) for p in patterns)):
        # words fit the targets if every set of patterns finds room in the sources it touches
        ok = all(
            sum(taken[i] for i in group) <= sum(targets[s] for s in sources if any(s in patterns[i] for i in group))
            for r in range(1, len(patterns) + 1)
            for group in itertools.combinations(range(len(patterns)), r)
        )
        if ok:
            cost = sum(2 * (w // sizes[p]) + 1 if sizes[p] else 0 for p, t in zip(patterns, taken, strict=True) for w in range(t))
            best = max(best, (sum(taken), -cost))
    return best


def test_flow_is_the_cheapest_of_the_greatest():
    rng = random.Random(2)
    for _ in range(25):
        sources = ["a", "b", None][: rng.randint(1, 3)]
        sizes = {}
        for _ in range(rng.randint(1, 3)):
            sizes[tuple(s for s in sources if rng.random() < 0.6) or (sources[0],)] = rng.randint(0, 3)
        targets = {s: rng.randint(0, 8) for s in sources}
        taken, flow = mixing.route(sizes, targets)
        for p, n in taken.items():
            assert 0 <= n <= 3 * sizes[p] and n == sum(v for (q, _), v in flow.items() if q == p)
        for s in sources:
            assert sum(v for (_, t), v in flow.items() if t == s) <= targets[s]
        cost = sum(2 * (w // sizes[p]) + 1 for p, t in taken.items() for w in range(t))
        assert (sum(taken.values()), -cost) == plain_cost(sizes, targets)


def test_many_patterns_are_routed_in_time():
    rng = random.Random(3)
    sources = [f"s{i}" for i in range(20)]
    sizes = {tuple(sorted(rng.sample(sources, rng.randint(1, 6)))): rng.randint(1, 10_000) for _ in range(12_000)}
    total = sum(sizes.values())
    targets = {s: total // 20 for s in sources}
    began = time.time()
    taken, _ = mixing.route(sizes, targets)
    assert time.time() - began < 60 and sum(taken.values()) == sum(targets.values())


def test_overlapping_sources_end_to_end(spark):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        own = [["a"], ["a", "b"], ["b"], ["c", None], ["c"], [], None, ["b", "a", "b"]][i % 8]
        rows.append((i, " ".join(["w"] * rng.randint(0, 30)) if i % 50 else None, "s", own, 7, 7, "k", 7))
    rows += [(None, "one two", "s", ["a"], 7, 7, "k", 7)] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    wanted = {"a": 3000, "b": 2000, "c": 9000, None: 500}
    p = mixing.plan(df, F.col("sources"), targets=lambda sizes: wanted)
    size = {}
    for _, t, _, own, *_ in rows:
        key = tuple(sorted({s for s in own or [] if s is not None})) + ((None,) if own and None in own else ())
        size[key] = size.get(key, 0) + len((t or "").split())
    got = {}
    for r in mixing.repeats(df.withColumn("size", mixing.size_of(F.col("text"))), p, F.col("sources"), "many").collect():
        own = r["sources"] or []
        key = tuple(sorted({s for s in own if s is not None})) + ((None,) if None in own else ())
        got[key] = got.get(key, 0) + r["size"] * r["many"]
        assert r["many"] <= 3 and (own or r["many"] == 0)
    best, _ = mixing.route(size, wanted)
    routed = {key: sum(v for (q, _), v in p.flow.items() if q == key) for key in size}
    cost = lambda taken: sum(2 * (w // size[k]) + 1 for k, t in taken.items() for w in range(t))
    assert sum(best.values()) == sum(routed.values()) and cost(best) == cost(routed)
    for key, words in routed.items():
        assert abs(got[key] - words) <= 30
    assert mixing.plan(df.repartition(7), F.col("sources"), targets=lambda sizes: wanted).rows == p.rows
    # quotas: each source's share of the flow
    for s, v in wanted.items():
        assert sum(f for (_, t), f in p.flow.items() if t == s) <= v
    mixed = mixing.mix(df, F.col("sources"), targets=lambda sizes: wanted)
    assert mixed.columns == df.columns and mixed.agg(F.sum("_times"), F.count("*")).head()[0] == 7 * mixed.count()


def test_targets_stop_at_three_times_the_size():
    t = mixing.targets_for({"a": 10, "b": 1000, "c": 1, None: 50})
    # weights 1, 2, 3, 1 by code point with null last; c stops at 3, a's share stays below 30
    assert t["c"] == 3 and sum(t.values()) == pytest.approx(1061)
    assert all(t[s] <= 3 * n + 1e-9 for s, n in {"a": 10, "b": 1000, "c": 1, None: 50}.items())
    assert mixing.targets_for({}) == {}
