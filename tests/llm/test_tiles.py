import time

import numpy as np
import pytest

from formweave.llm import decontaminate

SCHEMA = "doc_id bigint, text string, lang string, tag string, item_ids int, coverage int, _id int, _tag int, f_id int"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", "t", 1, 2, 3, 4, 5) for d, t in rows], SCHEMA)


def plain_tiles(a, b, least=5):
    """The longest common unmarked run each time, the first in a, then in b."""
    used, taken, out = [False] * len(a), [False] * len(b), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not used[i + k] and not taken[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return out
        out.append((i, j, k))
        used[i : i + k], taken[j : j + k] = [True] * k, [True] * k


def test_tiles_match_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(150):
        words = rng.integers(1, 1 << 62, int(rng.integers(1, 6)), dtype=np.uint64)
        a, b = (words[rng.integers(0, len(words), int(rng.integers(0, 40)))] for _ in range(2))
        assert decontaminate.tile(a, b) == plain_tiles(a.tolist(), b.tolist())


def test_repetitive_tokens_cost_no_more_than_their_length():
    same = np.full(20_000, 77, np.uint64)
    began = time.time()
    assert decontaminate.tile(same[:300], same) == [(0, 0, 300)]
    two = np.tile(np.array([5, 6, 7], np.uint64), 5_000)
    two[::101] = 9
    decontaminate.tile(two[:600], two)
    assert time.time() - began < 20


def tokens(text):
    return [w for w in ("".join(c for c in x if c.isalnum()) for x in (text or "").lower().split()) if w]


def test_blocks_find_what_one_block_finds(spark):
    rng = np.random.default_rng(3)
    prose = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 400, n))
    items = [(k, prose(30)) for k in range(12)] + [(None, prose(25)), (3, prose(20)), (50, "w1"), (51, None), (52, "")]
    rows = [(0, None), (1, ""), (2, items[2][1]), (2, items[2][1]), (2, prose(50)), (None, items[5][1] + " x"), (9, items[12][1]), (10, "chant " * 3000 + items[7][1])]
    rows += [(20 + k, prose(200) + " " + items[k][1][: 60 + 10 * k]) for k in range(10)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    df = docs(spark, rows)
    one = sorted(map(str, decontaminate.report(df, bench).collect()))
    assert one == sorted(map(str, decontaminate.report(df, bench, block_bytes=300).collect()))
    found = {}
    for d, t in rows:
        w = tokens(t)
        share = {}
        for k, (i, item) in enumerate(items):
            own = tokens(item)
            if own and len(own) < 5:
                share[k] = float(any(w[x : x + len(own)] == own for x in range(len(w))))
            elif own and d != 10:
                share[k] = sum(x[2] for x in plain_tiles(own, w)) / len(own)
        found[(d, t)] = sorted((items[k][0] for k, x in share.items() if x >= 0.5), key=lambda i: (i is None, i or 0))
    text = dict(((d, i), t) for i, (d, t) in enumerate(rows))
    got = decontaminate.report(df, bench).collect()
    for (d, i), t in text.items():
        if d != 10:
            assert any(r["doc_id"] == d and r["item_ids"] == found[(d, t)] and r["contaminated"] == bool(found[(d, t)]) for r in got)
    assert next(r for r in got if r["doc_id"] == 9)["item_ids"] == found[(9, items[12][1])] and None in found[(9, items[12][1])]
    clean = [(d, t) for d, t in rows if d != 10 and not found[(d, t)]]
    for bytes_ in (1 << 20, 300):
        kept = decontaminate.drop_contaminated(df, bench, block_bytes=bytes_)
        assert kept.columns == df.columns
        assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == sorted((str(d), str(t)) for d, t in clean)


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_empty_benchmark(spark, rows):
    none = spark.createDataFrame([], "item_id bigint, text string")
    got = decontaminate.report(docs(spark, rows), none).collect()
    assert [(r["doc_id"], r["item_ids"], r["coverage"], r["contaminated"]) for r in got] == [(d, [], 0.0, False) for d, _ in rows]
