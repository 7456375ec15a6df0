import math
import re
from collections import Counter

import numpy as np

from formweave.llm import toxicity
from formweave.llm.common import PUNCT, words

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", f"s{d % 3}", len(t or "")) for d, t in rows], SCHEMA)


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return ["".join(chr(97 + c) for c in rng.integers(0, 26, int(k))) for k in rng.integers(4, 9, n)]


def kept(df):
    return sorted(r["doc_id"] for r in df.collect())


def toxic_score(model, text):
    """Noisy-or over sentences, word by word."""
    none = 1.0
    for sentence in re.split(r"[.!?\n]", text or ""):
        found = re.findall(r"[a-z0-9]+", sentence.lower())
        z = model.bias
        for x in found:
            w = words(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x)]), True, PUNCT)
            z += sum(float(model.weigh(h)[0]) for h in (w.hash, w.prefixes(4), w.prefixes(5)))
        none *= 1 - 1 / (1 + math.exp(-max(-30, min(30, z)))) if found else 1
    return 1 - none


def test_toxicity_stage(spark, monkeypatch):
    import corpus_pipeline as p

    rows = [(i, ". ".join(" ".join(prose(100 * i + k, 8)) + (" vilest" if i % 4 == 0 and k == 2 else "") for k in range(4)) + "!") for i in range(160)]
    rows += [(500, None), (501, ""), (502, "A VILEST thing?\nother"), (503, "plain words")]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)], "doc_id bigint, toxic int")
    monkeypatch.setattr(p, "table", lambda *a: labels)
    model = toxicity.train(docs(spark, rows), labels)
    want = [d for d, t in rows if toxic_score(model, t) < 0.3]
    assert 0 < len(want) < len(rows) and 502 not in want and {500, 501, 503} <= set(want)
    assert kept(p.drop_toxic(spark, docs(spark, rows), "")) == want


def tokens(text):
    return [w for w in ("".join(c for c in x if c.isalnum()) for x in (text or "").lower().split()) if w]


def covered(item, doc):
    """Share of the item's tokens under tiles, by trying all pairs of places each time."""
    if len(item) < 5:
        return float(any(doc[i : i + len(item)] == item for i in range(len(doc) - len(item) + 1)))
    used, taken = [False] * len(item), [False] * len(doc)
    while True:
        best = (4, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and not used[i + k] and not taken[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < 5:
            return sum(used) / len(item)
        used[i : i + k], taken[j : j + k] = [True] * k, [True] * k


def test_decontamination_stage(spark, monkeypatch):
    import corpus_pipeline as p

    items = [(1, prose(5, 40)), (2, prose(6, 30)), (3, ["three", "short", "words"])]
    rows, d = [(0, None), (1, ""), (2, "has three Short, words in it"), (3, "three words short")], 10
    for _, w in items[:2]:
        for share in (0.2, 0.4, 0.48, 0.5, 0.55, 0.7, 1.0):
            n = round(len(w) * share)
            half = n // 2
            rows.append((d, " ".join([*prose(d, 6), *w[:n], *prose(d + 50, 6)])))
            rows.append((d + 1, " ".join([*w[half:n], *prose(d + 90, 4), *w[:half]]).upper() + "!"))
            d += 2
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")
    monkeypatch.setattr(p, "table", lambda *a: bench)
    want = [d for d, t in rows if all(covered(w, tokens(t)) < 0.5 for _, w in items)]
    assert 6 < len(want) < len(rows) - 6
    assert kept(p.drop_benchmark(spark, docs(spark, rows), "")) == want


def test_shard_stage_keeps_every_row(spark):
    import corpus_pipeline as p

    rows = [(i % 70, " ".join(prose(i % 70, 20))) for i in range(100)] + [(200, None)]
    got = p.shard(spark, docs(spark, rows), "").collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in rows)
    assert len({r["version"] for r in got}) == 1
    sizes = {}
    for r in got:
        assert sizes.setdefault(r["shard"], r["shard_bytes"]) == r["shard_bytes"] > 0


def test_mixing_stage(spark):
    import corpus_pipeline as p
    from formweave.llm import mixing

    rows = [(i, " ".join(prose(i, 3 + i % 25)) if i % 40 else None) for i in range(500)]
    df = docs(spark, rows)
    again = [Counter(r["doc_id"] for r in p.mix_sources(spark, df.repartition(3 + k), "").collect()) for k in range(2)]
    assert again[0] == again[1] and p.mix_sources(spark, df, "").columns == df.columns
    words = {d: len((t or "").split()) for d, t in rows}
    sizes = Counter()
    for d, n in words.items():
        sizes[f"s{d % 3}"] += n
    for source, target in mixing.targets_for(dict(sizes)).items():
        own = [d for d in words if f"s{d % 3}" == source]
        # all documents of a source are taken equally often, or once more up to a cut in the seeded order
        counts = {again[0][d] for d in own}
        assert max(counts) - min(counts) <= 1 and max(counts) <= 3
        assert abs(sum(again[0][d] * words[d] for d in own) - target) <= max(words[d] for d in own) / 2 + 1


def test_stages_pass_empty_tables_nulls_and_other_columns(spark, monkeypatch):
    import corpus_pipeline as p

    tables = {
        "labels": spark.createDataFrame([(i, 0) for i in range(4)], "doc_id bigint, toxic int"),
        "benchmark": spark.createDataFrame([(1, " ".join(prose(1, 20)))], "item_id bigint, text string"),
    }
    monkeypatch.setattr(p, "table", lambda spark, sf, name: tables[name])
    clashing = SCHEMA + ", _nd_id int, kept int, _times int, _key string, _id int, _tag int, score double, tag bigint"
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (2, None, "en", "a", 0), (3, "word", "en", "a", 4), (3, "word", "en", "a", 4), (4, " ".join(prose(2, 30_000)), "en", "b", 1)]
    for data in ([], [(*r, 1, 2, 3, "k", 4, 5, 0.5, 6) for r in rows]):
        df = spark.createDataFrame(data, clashing)
        for _, stage in p.STAGES[:-1]:
            df = stage(spark, df, "")
            assert df.columns == [c.split()[0] for c in clashing.split(", ")]
        left = df.collect()
        assert bool(left) == bool(data) and {r["_key"] for r in left} <= {"k"}
        assert p.shard(spark, df, "").count() == len(left)
