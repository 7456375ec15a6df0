import re

import numpy as np
import pytest

from formweave.llm import components, minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _nd_id int, g int, rep int, kept string"


def docs(spark, rows):
    """Documents with extra columns whose names the operator uses as well."""
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), 1, 2, 3, "x") for d, t in rows], SCHEMA)


def shingles(t):
    w = WORD.findall((t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def roots(rows, percent=85):
    """The least reachable doc_id of each doc_id, by comparing all texts."""
    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and 100 * len(x & y) >= percent * len(x | y) and find(a) != find(b):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {d: find(d) for d in root}


def words(rng, n, tag):
    return [f"{tag}{k}" for k in rng.integers(0, 10**6, n)]


def family(seed, n, changes):
    """Texts that each change up to `changes` words of one text of 60 words."""
    rng = np.random.default_rng(seed)
    base = words(rng, 60, "b")
    out = []
    for _ in range(n):
        w = list(base)
        for i in rng.integers(0, 60, int(rng.integers(0, changes + 1))):
            w[i] = f"c{rng.integers(0, 10**6)}"
        out.append(" ".join(w))
    return out


def boilerplate(seed, n, own):
    """Texts of one passage of 50 words and some words of their own; every sixth is almost the one before."""
    rng = np.random.default_rng(seed)
    passage, out = words(rng, 50, "p"), []
    for i in range(n):
        out.append(out[-1] + " tail" if i % 6 == 5 else " ".join(passage + words(rng, own, "o")))
    return out


@pytest.mark.parametrize("texts", [family(1, 150, 2), family(2, 150, 4), boilerplate(3, 150, 20), boilerplate(4, 150, 8), family(5, 70, 3) + boilerplate(6, 70, 10) + family(5, 30, 1)])
def test_large_groups_match_brute_force(spark, texts):
    rows = [(3 * i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(spark, rows), block=12).collect()}
    assert got == roots(rows)


def test_repeated_ids_are_one_document(spark):
    a, b, c = family(7, 1, 0)[0], boilerplate(8, 1, 10)[0], family(9, 1, 0)[0]
    rows = [(5, a), (9, a + " end"), (9, b), (9, b), (12, b + " end"), (13, c), (4, None), (4, c), (4, c)]
    got = minhash.near_duplicates(docs(spark, rows)).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == sorted((d, roots(rows)[d] if d != 9 and d != 12 else 5, d in (5, 4)) for d, _ in rows)
    assert sorted(r["doc_id"] for r in minhash.drop_near_duplicates(docs(spark, rows)).collect()) == [4, 4, 4, 5]


def test_large_component_tables_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(components, "BROADCAST_EDGES", 5)
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(500, i) for i in range(501, 540)] + [(7, 7), (None, 3)], "u bigint, v bigint")
    got = {r["node"]: r["component"] for r in components.connected_components(e).collect()}
    assert got == {**{i: 0 for i in range(1, 21)}, **{i: 500 for i in range(501, 540)}}
