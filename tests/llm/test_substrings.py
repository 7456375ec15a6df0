import hashlib

import numpy as np
import pytest

from formweave.llm import suffix_dedup

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, tag bigint, h bigint, again bigint"


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, int(k))) for k in rng.integers(3, 9, n))


def docs(spark, rows):
    """Documents with extra columns whose names the operator uses as well."""
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), 5, 1, d) for d, t in rows], SCHEMA)


def brute(spark, rows, length=100):
    """Results of rows, each distinct (doc_id, text) a document, ordered by doc_id and then by the hash of the text if the id is repeated."""
    hashes = {(r["doc_id"], r["text"]): r["t"] for r in docs(spark, rows).selectExpr("doc_id", "text", "xxhash64(text) t").collect()}
    seen, out = set(), {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, hashes[r])):
        b = (t or "").encode()
        gone, own = np.zeros(len(b), bool), set()
        for i in range(len(b) - length + 1) if d is not None else ():
            w = b[i : i + length]
            if w in seen or w in own:
                gone[i : i + length] = True
            own.add(w)
        seen |= own
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[(d, t)] = (d, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return sorted((out[r] for r in rows), key=str)


def result(spark, rows, **options):
    return sorted(map(tuple, suffix_dedup.dedup(docs(spark, rows), **options).collect()), key=str)


P, Q = prose(9, 40), prose(10, 60)
CASES = [(1, "a" * 350), (2, P + " é " + Q), (3, Q + P), (4, Q[:150] + "X" + Q[151:]), (5, None), (6, "short"), (8, P + " é " + Q), (9, "zz" + "a" * 120), (12, Q[40:240]), (13, ""), (None, Q)]


def test_substrings_match_brute_force(spark):
    assert result(spark, CASES) == brute(spark, CASES)


def test_repeated_ids_with_other_texts(spark):
    other, short = prose(30, 90), prose(31, 4)
    rows = [(3, P), (7, Q + P), (7, other), (7, short), (7, None), (8, other[100:400] + Q), (8, Q), (9, Q), (9, Q), (9, other[:200])]
    assert result(spark, rows) == brute(spark, rows)


def least_gram(length, k):
    """A gram of random letters with a hash so low that most windows around it pick it, followed by what followed it."""
    best = (1 << 64, "")
    for seed in range(300):
        t = prose(50_000 + seed, 60).encode()
        data = np.frombuffer(t, np.uint8)
        _, h, _, start, _ = suffix_dedup.segments(data, np.array([0, len(t)]), length, k)
        i = int(h.argmin())
        # the last window that picks a gram begins with it, unless the text ends before
        if int(h.min()) < best[0] and i + 1 < len(start):
            s = int(start[i + 1]) - 1
            best = int(h.min()), t[s : s + length].decode()
    return best[1]


@pytest.mark.parametrize("boiler", [24, 80, 130])
def test_hot_grams_are_split_exactly(spark, monkeypatch, boiler):
    core = least_gram(100, 24)[:boiler].ljust(boiler, "k")
    rows = []
    for i in range(150):
        text = prose(2 * i, 25) + core + prose(2 * i + 1, 25)
        rows.append((i, text))
        if i % 3 == 0:
            rows.append((1000 + i, text[60:]))
        if i % 5 == 0:
            rows.append((2000 + i, "x" + text[:200] + "y"))
    want = brute(spark, rows)
    split = []
    again = suffix_dedup._folded_again
    monkeypatch.setattr(suffix_dedup, "_folded_again", lambda *a: split.append(a[2]) or again(*a))
    for hot, least in ((4, 1), (40, 1), (2048, 0)):
        del split[:]
        assert result(spark, rows, hot=hot) == want
        assert len(split) >= least


def test_fold_over_any_cut_of_batches():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    n = 400
    cols = [rng.integers(0, 30, n), rng.integers(0, 3, n), rng.integers(0, 4, n), rng.integers(0, 2, n), rng.integers(0, 3, n)]
    order = np.lexsort(cols[::-1])
    table = pa.table({c: pa.array(x[order]) for c, x in zip(("h", "g", "doc", "tag", "sn"), cols, strict=True)})

    def run(size):
        out = [r for b in suffix_dedup._fold(False)(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        return sorted(map(str, out))

    rows = list(zip(*(x[order].tolist() for x in cols), strict=True))
    firsts, copies, seen = {}, [], set()
    for h, g, *rest in rows:
        if (h, g, *rest) in seen:
            continue
        seen.add((h, g, *rest))
        if g in firsts.setdefault(h, {}):
            copies.append(rest)
        else:
            firsts[h][g] = rest
    want = [{"h": None, "doc": d, "tag": t, "sn": s, "nth": 0} for d, t, s in copies]
    want += [{"h": h, "doc": d, "tag": t, "sn": s, "nth": k} for h, f in firsts.items() if len(f) > 1 for k, (d, t, s) in enumerate(f.values())]
    for size in (1, 2, 3, 7, 50, 400):
        assert run(size) == sorted(map(str, want))
