"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are token sequences (lower case, ASCII punctuation dropped). Pairs
that share a seed, a run of five tokens, are tiled: the longest common runs not yet covered are
marked again and again, found by running Karp-Rabin hashes of shrinking length. The share of an
item's tokens that tiles cover does not depend on the order of the passages, so reordered items
are caught. An item counts as leaked if its coverage reaches `threshold`.

The benchmark is taken in blocks of at most `block_bytes` of text, each shipped to all tasks; all
documents are read against each block, so nothing depends on the benchmark being small. With several
blocks only what a block finds is written, and a shuffle of these findings by doc_id and text hash
brings them together; texts are read once a block and never written.

Defined cases: null and empty texts leak nothing. Items with fewer than five tokens are one seed
and leak where their whole sequence occurs. Null and empty items are ignored, repeated items are
all named, and an item without an id is named by null. Of tiles of equal length the one that begins
first in the item goes first, then the one that begins first in the document. Very long texts are tiled
whole. Repeated rows are judged each. An empty benchmark leaks nowhere, an empty table gives an empty
result. Extra columns are ignored by the report and kept by the filter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PUNCT, free_name, map_arrow, materialise, powers, word_slices

SEED = 5


def tile(a: np.ndarray, b: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiles (start in a, start in b, length) of two hash sequences, longest first, then by place.

    Running Karp-Rabin hashes of all unmarked runs tell the greatest length that both sequences share, by
    bisection; the runs of that length that do not overlap are marked, and the next length is shorter. Each
    length costs a few sorts of the hashes, also where a token repeats throughout.
    """
    sides = [_Side(a), _Side(b)]
    tiles: list[tuple[int, int, int]] = []
    most = min(len(a), len(b))
    while most >= least:
        low, high = least - 1, most
        while low < high:
            k = (low + high + 1) // 2
            if np.isin(sides[0].runs(k)[0], sides[1].runs(k)[0]).any():
                low = k
            else:
                high = k - 1
        if low < least:
            break
        (ha, ia), (hb, ib) = (s.runs(low) for s in sides)
        order = np.argsort(hb, kind="stable")
        hb, ib = hb[order], ib[order]
        hit = np.isin(ha, hb)
        end_a, used_b, at = -1, np.zeros(len(b), bool), {}
        for h, i in zip(ha[hit], ia[hit], strict=True):
            if i < end_a:
                continue
            stop = int(np.searchsorted(hb, h, "right"))
            k = at.get(h, int(np.searchsorted(hb, h, "left")))
            # runs marked at this length are as long as this one, so an overlap covers one of its ends
            while k < stop and (used_b[ib[k]] or used_b[ib[k] + low - 1]):
                k += 1
            at[h] = k
            if k < stop and (a[i : i + low] == b[ib[k] : ib[k] + low]).all():
                tiles.append((int(i), int(ib[k]), low))
                end_a = i + low
                used_b[ib[k] : ib[k] + low] = True
                sides[0].marked[i : i + low] = sides[1].marked[ib[k] : ib[k] + low] = True
        most = low - 1
    return tiles


class _Side:
    """A sequence of hashes, which of them are marked, and the sums from which the hash of any run follows."""

    def __init__(self, x: np.ndarray) -> None:
        n = len(x)
        fwd, self.inverse = powers(n + 1)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(x * fwd[:n], out=self.total[1:])
        self.marked = np.zeros(n, bool)

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and starts of all unmarked runs of length k."""
        blocked = np.concatenate([[0], np.cumsum(self.marked)])
        start = np.flatnonzero(blocked[k:] == blocked[: len(blocked) - k])
        return (self.total[start + k] - self.total[start]) * self.inverse[start], start


@dataclass
class Block:
    """Some benchmark items: seed hashes in ascending order with the item and position of each."""

    ids: list[int | None]
    tokens: list[np.ndarray]
    seeds: np.ndarray
    item: np.ndarray
    at: np.ndarray


def index(items: list[tuple[int | None, str]]) -> Block:
    ids, tokens, seeds, item, at = [], [], [], [], []
    for i, _, w in word_slices(pa.array([t for _, t in items], pa.string()), sep=PUNCT):
        h, off = w.shingles(SEED)
        for k in range(len(off) - 1):
            ids.append(items[i + k][0])
            tokens.append(w.hash[w.rows[k] : w.rows[k + 1]])
            own = h[off[k] : off[k + 1]]
            seeds.append(own)
            item.append(np.full(len(own), len(ids) - 1))
            at.append(np.arange(len(own)))
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    seeds, item, at = cat(seeds, np.uint64), cat(item, np.int64), cat(at, np.int64)
    order = np.argsort(seeds, kind="stable")
    return Block(ids, tokens, seeds[order], item[order], at[order])


def _short_hits(block: Block, tokens: np.ndarray) -> set[int]:
    """Items of fewer tokens than a seed that occur as a whole."""
    out = set()
    for k, own in enumerate(block.tokens):
        n = len(own)
        if 0 < n < SEED and len(tokens) >= n:
            hit = np.ones(len(tokens) - n + 1, bool)
            for j in range(n):
                hit &= tokens[j : len(tokens) - n + 1 + j] == own[j]
            if hit.any():
                out.add(k)
    return out


def coverage(block: Block, tokens: np.ndarray, hashes: np.ndarray) -> dict[int, float]:
    """Share of each item's tokens that tiles on this document cover; items without a common seed are absent."""
    out = {k: 1.0 for k in _short_hits(block, tokens)} if any(len(t) < SEED for t in block.tokens) else {}
    if len(tokens) < SEED or not len(block.seeds):
        return out
    lo = np.searchsorted(block.seeds, hashes, "left")
    hit = np.flatnonzero((lo < len(block.seeds)) & (block.seeds[np.minimum(lo, len(block.seeds) - 1)] == hashes))
    places: dict[int, set[int]] = {}
    for p in hit:
        k = lo[p]
        while k < len(block.seeds) and block.seeds[k] == hashes[p]:
            places.setdefault(int(block.item[k]), set()).add(int(p))
            k += 1
    for k, at in places.items():
        own = block.tokens[k]
        # every common run of five tokens or more consists of seeds, so only tokens under seeds can be tiled
        under = np.unique(np.concatenate([np.arange(p, p + SEED) for p in at]))
        gaps = np.flatnonzero(np.diff(under) > 1) + 1
        parts, barrier = [], np.array([0xFFFFFFFFFFFFFFFF], np.uint64)
        # identical stretches tile alike: once an item's tokens have been offered often enough, more copies add nothing
        seen: dict[bytes, int] = {}
        for part in np.split(under, gaps):
            stretch = tokens[part]
            key = stretch.tobytes()
            seen[key] = seen.get(key, 0) + 1
            if seen[key] <= max(1, len(own) // SEED):
                parts += [stretch, barrier]
        out[k] = sum(t[2] for t in tile(own, np.concatenate(parts))) / len(own)
    return out


def blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, str]]]:
    """Benchmark items in blocks of at most `block_bytes`, or of one longer item, read one block at a time."""
    items = benchmark.where(F.col("text").isNotNull() & (F.col("text") != "")).select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n = -(-2 * int(total) // block_bytes) if total > block_bytes else 1
    for k in range(n if total else 0):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).collect() if n > 1 else items.collect()
        yield sorted(((r["id"], r["text"]) for r in rows), key=lambda x: (x[0] is None, x))


def _leaks(block: Block, threshold: float, column: pa.Array) -> tuple[list[list[int | None]], np.ndarray]:
    leaked: list[list[int | None]] = []
    most = np.zeros(len(column))
    short = any(len(t) < SEED for t in block.tokens)
    for i, j, w in word_slices(column, sep=PUNCT):
        h, off = w.shingles(SEED)
        near = np.full(j - i, short)
        if len(block.seeds):
            lo = np.minimum(np.searchsorted(block.seeds, h), len(block.seeds) - 1)
            near[np.searchsorted(off, np.flatnonzero(block.seeds[lo] == h), "right") - 1] = True
        for k in range(j - i):
            ids: list[int | None] = []
            if near[k]:
                cover = coverage(block, w.hash[w.rows[k] : w.rows[k + 1]], h[off[k] : off[k + 1]])
                most[i + k] = max([0.0, *cover.values()])
                ids = sorted((block.ids[x] for x, c in cover.items() if c >= threshold), key=lambda i: (i is None, i))
            leaked.append(ids)
    return leaked, most


def _judge(block: Block, threshold: float, all_rows: bool):
    """doc_id, text hash, leaked items and coverage of all rows, or of those that some item covers in part."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaked, most = _leaks(block, threshold, batch.column(2))
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaked, pa.list_(pa.int64())), pa.array(most)], ["doc_id", "tag", "item_ids", "coverage"])
            yield out if all_rows else out.filter(pa.array(most > 0))

    return rows


_FINDINGS = "doc_id bigint, tag bigint, item_ids array<bigint>, coverage double"


def _tagged(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tag"), F.col("text").cast("string").alias("text"))


def _findings(docs: DataFrame, listed: list[list[tuple[int | None, str]]] | Iterator, threshold: float) -> DataFrame:
    """What all blocks find, a row for each distinct doc_id and text that some item covers in part."""
    texts, every = _tagged(docs), None
    for items in listed:
        part = materialise(map_arrow(texts, _judge(index(items), threshold, False), _FINDINGS).distinct(), "tiled")
        every = part if every is None else every.unionByName(part)
    return every.groupBy("doc_id", "tag").agg(F.array_sort(F.flatten(F.collect_list("item_ids"))).alias("item_ids"), F.max("coverage").alias("coverage"))


def report(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, block_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, leaked item ids, the highest coverage of any item, and contaminated, for every document."""
    listed = blocks(benchmark, block_bytes)
    first = next(listed, [])
    second = next(listed, None)
    if second is None:
        out = map_arrow(_tagged(docs), _judge(index(first), threshold, True), _FINDINGS)
    else:
        found = _findings(docs, chain([first, second], listed), threshold).withColumnsRenamed({"doc_id": "f_id", "tag": "f_tag"})
        out = _tagged(docs).drop("text").join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("tag") == F.col("f_tag")), "left")
    ids = F.coalesce("item_ids", F.array().cast("array<bigint>"))
    return out.select("doc_id", F.array_sort(ids).alias("item_ids"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), (F.size(ids) > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, block_bytes: int = 16 << 20) -> DataFrame:
    """The documents without leaked items, with all their columns."""

    def keep(block: Block):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaked, _ = _leaks(block, threshold, batch.column(batch.schema.get_field_index("text")))
                yield batch.filter(pa.array([not x for x in leaked], pa.bool_()))

        return rows

    listed = blocks(benchmark, block_bytes)
    first = next(listed, [])
    second = next(listed, None)
    if second is None:
        return map_arrow(docs, keep(index(first)), docs.schema)
    f_id, f_tag = free_name(docs, "_id"), free_name(docs, "_tag")
    found = _findings(docs, chain([first, second], listed), threshold).where(F.size("item_ids") > 0).select(F.col("doc_id").alias(f_id), F.col("tag").alias(f_tag))
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(f_id)) & (F.xxhash64(F.col("text").cast("string")) == F.col(f_tag)), "left_anti")
