import re

import numpy as np
import pytest

from formweave.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shingles(t):
    w = WORD.findall((t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def roots(sets, percent):
    root = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    return root


def similar_pairs():
    """Pairs of documents with similarities from 0.74 to 0.90, and rows without words."""
    rng = np.random.default_rng(11)
    rows = [(0, None), (1, ""), (2, "a b")]
    for k in range(60):
        w = [f"w{k}x{i}" for i in range(304)]
        n = 300
        target = 0.74 + 0.16 * k / 59
        other = list(w)
        at = rng.permutation(np.arange(4, 300, 5))
        for i in at[: round(n * (1 - target) / (1 + target) / 5)]:
            other[i] = f"new{k}x{i}"
        rows += [(10 + 2 * k, " ".join(w)), (11 + 2 * k, " ".join(other))]
    return rows


def test_stage_matches_brute_force_from_0_80(spark):
    import corpus_pipeline as p

    rows = similar_pairs()
    sets = {d: shingles(t) for d, t in rows}
    s = [len(sets[d] & sets[d + 1]) / len(sets[d] | sets[d + 1]) for d in range(10, 130, 2)]
    assert sum(0.80 <= x < 0.85 for x in s) >= 10 and sum(x < 0.80 for x in s) >= 10
    want = sorted(d for d, r in roots(sets, 80).items() if d == r)
    got = p.drop_near_duplicates(spark, spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], SCHEMA), "")
    assert sorted(r["doc_id"] for r in got.collect()) == want


def test_losses_at_the_threshold_are_bounded():
    rng = np.random.default_rng(5)
    for percent in (80, 85):
        t = percent / 100
        assert (1 - t**minhash.ROWS) ** minhash.bands_for(percent) <= minhash.LOSS
        match = rng.binomial(minhash.MINIMA, 0.25 + 0.75 * t, 2_000_000)
        assert (((match / minhash.MINIMA - 0.25) / 0.75) < minhash.floor_for(percent)).sum() <= 5
    with pytest.raises(ValueError):
        minhash.bands_for(60)
