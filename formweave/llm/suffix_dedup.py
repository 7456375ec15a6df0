"""Exact substring deduplication by merging shard Burrows-Wheeler transforms.

A byte goes if some string of `length` bytes over it also starts earlier in the corpus. Strings that
can match are brought together first: each window of `length` bytes picks its least-hashed `K`-gram,
so equal windows pick equal grams. Neighbouring windows with one pick form a segment. Segments that
are equal as a whole are folded where they are found; of a gram that one distinct segment holds
nothing else is asked.

The distinct segments of each shared gram form a text collection. It is cut into shards, each shard's
suffixes are sorted once into a Burrows-Wheeler transform, and the transforms are merged by iterative
interleave refinement: the interleave of suffixes by their first d bytes, read through the transforms
and distributed stably by the preceding bytes, is the interleave by d + step bytes. Only the shard
number of each suffix is moved; suffixes are not sorted again. Where neighbours part at a step their
common prefix ends there, and neighbours that never part within `length` bytes are the repeated
intervals. In each, the window with the smallest (doc_id, start) stays.

A gram with more than `hot` distinct segments is split by more of its context: its windows pick again,
by their least-hashed gram of DEEPER bytes, and their segments are folded and merged like the first
ones. What is hot even then is split into single windows, of which equal ones fold. So a task merges
at most `hot` segments of one gram, and nothing is left out.

Defined cases: null and empty texts have no bytes, nothing removed and the digest of nothing. Texts
shorter than `length` lose nothing. Rows with equal doc_id and text are one document and do not match
each other. Rows of one doc_id with different texts are documents of their own, ordered by the 64-bit
hash of their text. Rows with a null doc_id match nothing and stay whole. An empty table gives an
empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, discard, map_arrow, materialise, mix, powers, slices, utf8

LENGTH, K, DEEPER = 100, 24, 72
#: Distinct segments of one gram that a task merges at most.
HOT = 2048
#: Repeated ids are broadcast up to this number, 8 bytes each.
BROADCAST_IDS = 1_000_000
STEP = 16
SHARD_BYTES = 1 << 15
COLLECTION_BYTES = 1 << 17
_POS_BITS = 24
_PIECE = 1 << 22


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def segments(data: np.ndarray, off: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """Row, gram hash, segment hash, first window start and number of windows of all segments of some rows."""
    out: list[tuple[np.ndarray, ...]] = []
    n, width = len(data), length - k + 1
    for a in range(0, max(0, n - length + 1), _PIECE):
        piece = data[a : a + _PIECE + length - 1]
        m = len(piece)
        fwd, inv = powers(m + 1)
        total = np.zeros(m + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * fwd[:m], out=total[1:])
        h = mix((total[k:] - total[:-k]) * inv[: m - k + 1])
        place = np.arange(len(h), dtype=np.uint64)
        pick = (_sliding_min((h >> np.uint64(_POS_BITS) << np.uint64(_POS_BITS)) | place, width) & np.uint64((1 << _POS_BITS) - 1)).astype(np.int64)
        at = np.arange(len(pick)) + a
        row = np.searchsorted(off, at, "right") - 1
        valid = off[row + 1] - at >= length
        first = valid.copy()
        first[1:] &= ~valid[:-1] | (pick[1:] != pick[:-1]) | (row[1:] != row[:-1])
        start = np.flatnonzero(first)
        if not len(start):
            continue
        count = np.add.reduceat(valid.astype(np.int64), start)
        end = start + count + length - 1
        g = mix((total[end] - total[start]) * inv[start] + count.astype(np.uint64))
        out.append((row[start], h[pick[start]], g, start + a - off[row[start]], count))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z.astype(np.uint64), z, z
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _dense(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Ranks, from 1 and without gaps, of pairs of small non-negative numbers."""
    n = len(high)
    width, bits = int(low.max(initial=0)).bit_length(), max(1, (n - 1).bit_length())
    pair = (high.astype(np.uint64) << np.uint64(width)) | low.astype(np.uint64)
    if int(high.max(initial=0)).bit_length() + width + bits > 64:
        return np.unique(pair, return_inverse=True)[1].astype(np.int64) + 1
    # the position rides in the low bits, so a plain sort gives the order as well
    s = np.sort((pair << np.uint64(bits)) | np.arange(n, dtype=np.uint64))
    at = (s & np.uint64((1 << bits) - 1)).astype(np.int64)
    s >>= np.uint64(bits)
    new = np.empty(n, bool)
    new[:1] = True
    np.not_equal(s[1:], s[:-1], out=new[1:])
    out = np.empty(n, np.int64)
    out[at] = np.cumsum(new)
    return out


class Grams:
    """Ranks of the first k bytes of all suffixes of segments; bytes after a segment's end rank lowest."""

    def __init__(self, text: np.ndarray, left: np.ndarray) -> None:
        self.left = left
        self.known = {1: text.astype(np.int64) + 1}

    def rank(self, k: int) -> np.ndarray:
        if k not in self.known:
            half = 1 << ((k - 1).bit_length() - 1)
            self.known[k] = _dense(self.rank(half), self.after(self.rank(k - half), half))
        return self.known[k]

    def after(self, rank: np.ndarray, k: int) -> np.ndarray:
        """The rank that stands k bytes on in the same segment, 0 past its end."""
        out = np.zeros(len(rank), np.int64)
        out[: max(0, len(rank) - k)] = rank[k:]
        out[self.left <= k] = 0
        return out


def shard_transform(rank: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Suffix order of a shard's segments, from ranks of the first `depth` bytes of its suffixes.

    Suffixes stop at their segment's end. Of equal ones the earlier segment's goes first, which makes
    the order one of a collection with a terminator per segment.
    """
    most = int(left.max(initial=0))
    while depth < most:
        after = np.zeros(len(rank), np.int64)
        after[: max(0, len(rank) - depth)] = rank[depth:]
        after[left <= depth] = 0
        rank = _dense(rank, after)
        depth *= 2
    return _order(rank)


def _order(rank: np.ndarray) -> np.ndarray:
    """Stable order of small non-negative numbers, by a plain sort with the position in the low bits."""
    bits = max(1, (len(rank) - 1).bit_length())
    s = np.sort((rank.astype(np.uint64) << np.uint64(bits)) | np.arange(len(rank), dtype=np.uint64))
    return (s & np.uint64((1 << bits) - 1)).astype(np.int64)


def merge_transforms(text: np.ndarray, ends: np.ndarray, shards: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges the transforms of shards (their ends in `shards`, at segment ends) by interleave refinement.

    A transform's symbol is the STEP bytes before a suffix, so each refinement adds STEP bytes to the
    depth. Returns all suffix positions in merged order, the block of each (equal first `length`
    bytes), and the depth by which each was parted from its predecessor (-1: not parted).
    """
    n = len(text)
    starts = np.append(0, ends[:-1])
    left = np.repeat(ends, ends - starts) - np.arange(n)
    head = np.arange(n) - np.repeat(starts, ends - starts)
    grams = Grams(text, left)
    base = grams.rank(STEP)
    cuts = np.append(0, shards)
    suffix = np.concatenate([shard_transform(base[a:b], left[a:b], STEP) + a for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    kind = np.uint8 if len(shards) <= 256 else np.uint16 if len(shards) <= 65536 else np.int64
    z = np.repeat(np.arange(len(shards), dtype=kind), np.diff(cuts))
    block, parted, depth = np.zeros(n, np.int64), np.full(n, -1, np.int64), 0
    first_step = length % STEP or STEP
    plan = None
    for step in [first_step] + [STEP] * ((length - first_step) // STEP):
        if plan is None or plan[0] != step:
            # a suffix that ends with the step goes before the longer ones that begin like it
            key = (grams.rank(step) * 2 + (left > step)).astype(np.uint64)
            short = np.flatnonzero(left <= step)
            short = short[np.argsort(key[short], kind="stable")]  # then in shard and segment order
            # none comes before a segment's head: such suffixes hand nothing back
            has = head[suffix] >= step
            plan = step, key, short, key[np.maximum(suffix - step, 0)], has, np.searchsorted(shards, short, "right").astype(kind), left[short] == step
        _, key, short, symbol, has, short_z, exact = plan
        sym, moves = np.empty(n, np.uint64), np.empty(n, bool)
        at = _by_shard(z, len(shards))
        sym[at], moves[at] = symbol, has
        go = np.flatnonzero(moves)
        m = len(short)
        source = np.concatenate([np.arange(-m - 1, -1), block[go]])
        symbols = np.concatenate([key[short], sym[go]])
        order = np.sort((symbols << np.uint64(32)) | np.arange(n, dtype=np.uint64))
        order = (order & np.uint64(0xFFFFFFFF)).astype(np.int64)
        if not depth:
            # at the first step, suffixes of just its length still agree with longer ones
            source[:m][exact] = 0
            symbols[:m][exact] |= np.uint64(1)
        symbols, source, z = symbols[order], source[order], np.concatenate([short_z, z[go]])[order]
        new = np.append(True, (symbols[1:] != symbols[:-1]) | (source[1:] != source[:-1]))
        block = np.cumsum(new)
        depth += step
        parted[new & (parted < 0)] = depth
    merged = np.empty(n, np.int64)
    merged[_by_shard(z, len(shards))] = suffix
    return merged, block, parted


def _by_shard(z: np.ndarray, shards: int) -> np.ndarray:
    """Places of the interleave, shard by shard."""
    return np.concatenate([np.flatnonzero(z == k) for k in range(shards)]) if shards <= 8 else np.argsort(z, kind="stable")


def repeated_windows(parts: list[bytes], rank: np.ndarray, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each segment, which of its windows also stand in a segment of lower rank at the same gram."""
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(size)
    text = np.frombuffer(b"".join(parts), np.uint8)
    cut = np.searchsorted(ends, np.arange(shard_bytes, ends[-1] + shard_bytes, shard_bytes))
    shards = np.unique(ends[np.minimum(cut, len(ends) - 1)])
    merged, _, parted = merge_transforms(text, ends, shards, length)
    block = np.cumsum(parted >= 0)
    seg = np.repeat(np.arange(len(size)), size)
    full = np.repeat(ends, size) - np.arange(len(text)) >= length
    window = full[merged]
    merged, block = merged[window], block[window]
    seg = seg[merged]
    low = np.full(int(block.max(initial=0)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, block, rank[seg])
    again = np.zeros(len(text), bool)
    again[merged] = rank[seg] > low[block]
    return [again[e - n : e - length + 1] for e, n in zip(ends, size, strict=True)]


_SEGMENT = ["key", "h", "g", "doc", "tag", "sn"]
_FOUND = "key bigint, h bigint, g bigint, doc bigint, tag bigint, sn bigint"


def _dealt(h: np.ndarray, g: np.ndarray, doc: np.ndarray, tag: np.ndarray, sn: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Places of distinct segments, and their columns: what is there twice is folded (gram null), with a key of its own for the exchange."""
    order = np.lexsort((sn, tag, doc, g, h))
    doc, tag, h, g, sn = doc[order], tag[order], h[order], g[order], sn[order]
    same, twice = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
    same[1:] = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
    twice[1:] = same[1:] & (doc[1:] == doc[:-1]) & (tag[1:] == tag[:-1]) & (sn[1:] == sn[:-1])
    use = ~twice
    key = np.where(same, mix(doc.astype(np.uint64) * np.uint64(31) + sn.astype(np.uint64)), h)
    gram = pa.array(h[use].view(np.int64), mask=same[use])
    return order[use], [pa.array(key[use].view(np.int64)), gram, pa.array(g[use].view(np.int64)), *(pa.array(x[use].astype(np.int64)) for x in (doc, tag, sn))]


def _found(length: int):
    """Segments of each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(2))
            ids, tags = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            parts = []
            for i, j in slices(off):
                row, h, g, start, count = segments(data[off[i] : off[j]], off[i : j + 1] - off[i], length)
                parts.append((h, g, ids[row + i], tags[row + i], (start << 8) | count))
            if parts:
                yield pa.RecordBatch.from_arrays(_dealt(*(np.concatenate(c) for c in zip(*parts, strict=True)))[1], _SEGMENT)

    return rows


def _deeper(length: int, k: int):
    """The segments that the windows of segments form when they pick a k-gram, with their bytes; the first gram stays part of the key."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = binary(batch.column(4))
            first, doc, tag, sn = (batch.column(c).to_numpy() for c in range(4))
            for i, j in slices(off, 1 << 18):
                row, h, g, start, count = segments(data[off[i] : off[j]], off[i : j + 1] - off[i], length, k)
                row = row + i
                begin, own = off[row] + start, mix(h ^ (first[row].view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
                at, columns = _dealt(own, g, doc[row], tag[row], (((sn[row] >> 8) + start) << 8) | count)
                wanted = columns[1].is_valid().to_numpy(zero_copy_only=False)
                bits = [data[x:y].tobytes() if w else b"" for x, y, w in zip(begin[at], begin[at] + count[at] + length - 1, wanted, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(bits, pa.binary())], [*_SEGMENT, "bytes"])

    return rows


def _fold(carry: bool, hot: int = HOT):
    """Of rows ordered by (h, g, doc, tag, sn): copies of a segment (h null), and first segments of grams that several segments hold.

    `nth` counts the distinct segments of a gram from 0. The state that passes from batch to batch is two rows.
    With `carry` the rows have bytes, and `busy` tells which grams are known to be hot: their segments are dealt
    to several tasks, and all first ones come out, with `hot` for `nth`.
    """
    more = ["bytes"] if carry else []

    def out(batch: pa.RecordBatch, at: np.ndarray, nth: np.ndarray | None) -> pa.RecordBatch:
        got = batch.take(pa.array(at))
        h = got["h"] if nth is not None else pa.nulls(len(at), pa.int64())
        count = pa.array(nth if nth is not None else np.zeros(len(at)), pa.int32())
        return pa.RecordBatch.from_arrays([h, got["doc"], got["tag"], got["sn"], count, *(got[c] for c in more)], ["h", "doc", "tag", "sn", "nth", *more])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = held = None  # the last row, and a first segment whose gram has no second one so far
        nth = 0  # the place of the last row's segment in its gram
        for batch in batches:
            if batch["h"].null_count:
                yield out(batch, np.flatnonzero(batch["h"].is_null().to_numpy(zero_copy_only=False)), None)
                batch = batch.filter(batch["h"].is_valid())
            if not batch.num_rows:
                continue
            if last is not None:
                batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            h, g, doc, tag, sn = (batch[c].to_numpy() for c in ("h", "g", "doc", "tag", "sn"))
            same_h, same, twice = (np.zeros(len(h), bool) for _ in range(3))
            same_h[1:] = h[1:] == h[:-1]
            same[1:] = same_h[1:] & (g[1:] == g[:-1])
            twice[1:] = same[1:] & (doc[1:] == doc[:-1]) & (tag[1:] == tag[:-1]) & (sn[1:] == sn[:-1])
            new = ~same
            new[:1] = last is None
            total = np.cumsum(new)
            start = np.maximum.accumulate(np.where(same_h, 0, np.arange(len(h))))
            place = total - total[start]
            if last is not None:
                place[start == 0] += nth
            first = np.flatnonzero(new)
            if len(first):
                order = place[first]
                shared = order > 0
                shared[:-1] |= order[1:] > 0
                if carry:
                    busy = batch["busy"].to_numpy(zero_copy_only=False)[first]
                    shared, order = shared | busy, np.where(busy, hot, order)
                if held is not None and place[first[0]] > 0:
                    yield out(held, np.zeros(1, np.int64), np.zeros(1))
                held = None if shared[-1] else batch.slice(int(first[-1]), 1)
                if shared.any():
                    yield out(batch, first[shared], order[shared])
            nth = int(place[-1])
            copies = np.flatnonzero(same & ~twice)
            if len(copies):
                yield out(batch, copies, None)
            last = batch.slice(len(h) - 1, 1)

    return rows


def _cut(length: int):
    """Bytes of the wanted segments of each document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(2))
            n = np.diff(batch.column(3).offsets.to_numpy())
            flat = batch.column(3).flatten()
            sn, h = flat.field("sn").to_numpy(), flat.field("h").to_numpy()
            doc, tag = (np.repeat(batch.column(k).to_numpy(), n) for k in (0, 1))
            begin = np.repeat(off[:-1], n) + (sn >> 8)
            end = begin + (sn & 255) + length - 1
            for a in range(0, len(sn), 20_000):
                b = slice(a, a + 20_000)
                bits = [data[x:y].tobytes() for x, y in zip(begin[b], end[b], strict=True)]
                yield pa.RecordBatch.from_arrays([*(pa.array(x[b]) for x in (h, doc, tag, sn)), pa.array(bits, pa.binary())], ["h", "doc", "tag", "sn", "bytes"])

    return rows


def _merge(length: int):
    """Runs of repeated windows of segments, from collections of whole grams."""

    def solve(h: list[int], doc: list[int], tag: list[int], sn: list[int], parts: list[bytes]) -> pa.RecordBatch:
        # segments arrive ordered by gram, then by (doc, tag, start): their place is their rank
        out = []
        for d, t, s, again in zip(doc, tag, sn, repeated_windows(parts, np.arange(len(parts)), length), strict=True):
            if again.any():
                edge = np.diff(np.concatenate([[0], again.view(np.int8), [0]]))
                for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
                    out.append((d, t, (((s >> 8) + int(a)) << 8) | int(b - a)))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], ["doc", "tag", "sn"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, ...] = ([], [], [], [], [])
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if size >= COLLECTION_BYTES and row[0] != held[0][-1]:
                    yield solve(*held)
                    held, size = ([], [], [], [], []), 0
                for x, y in zip(held, row, strict=True):
                    x.append(y)
                size += len(row[4])
        if held[0]:
            yield solve(*held)

    return rows


def _remove(length: int):
    """Applies the runs of repeated windows to each document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            marks = batch.column(2)
            removed, spans, digests = [], [], []
            for k in range(batch.num_rows):
                own = data[off[k] : off[k + 1]]
                sn = marks[k].values.to_numpy() if marks[k].is_valid else np.zeros(0, np.int64)
                if not len(sn):
                    removed.append(0)
                    spans.append(0)
                    digests.append(hashlib.sha256(own).hexdigest())
                    continue
                edge = np.zeros(len(own) + 1, np.int64)
                np.add.at(edge, sn >> 8, 1)
                np.add.at(edge, np.minimum((sn >> 8) + (sn & 255) + length - 1, len(own)), -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
                digests.append(hashlib.sha256(own[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return rows


def tagged(docs: DataFrame) -> DataFrame:
    """doc_id, tag and text: the tag tells the texts of a repeated doc_id apart, and is 0 where a doc_id is not repeated."""
    texts = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    again = texts.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again"))
    again = materialise(again, "again")
    n = again.count()
    if not n:
        return texts.select("doc_id", F.lit(0).cast("bigint").alias("tag"), "text")
    marked = texts.join(F.broadcast(again) if n <= BROADCAST_IDS else again, F.col("doc_id") == F.col("again"), "left")
    return marked.select("doc_id", F.when(F.col("again").isNotNull(), F.xxhash64("text")).otherwise(F.lit(0)).cast("bigint").alias("tag"), "text")


_FOLDED = "h bigint, doc bigint, tag bigint, sn bigint, nth int"


def _folded(found: DataFrame) -> DataFrame:
    """Copies and shared first segments of found segments, written to the shared folder."""
    dealt = found.repartition("key").drop("key").sortWithinPartitions("h", "g", "doc", "tag", "sn")
    return materialise(map_arrow(dealt, _fold(False), _FOLDED), "segments")


def _folded_again(split: DataFrame, length: int, k: int, hot: int) -> DataFrame:
    """The same for segments of hot grams, split by k-grams. Of these the hot ones are counted first, and dealt by segment and not by gram."""
    found = materialise(map_arrow(split, _deeper(length, k), _FOUND + ", bytes binary"), "found")
    busy = found.where("h is not null").groupBy("h").count().where(F.col("count") > hot).select(F.col("h").alias("bh"))
    busy = F.broadcast(busy) if busy.count() <= BROADCAST_IDS else busy
    dealt = found.join(busy, F.col("h") == F.col("bh"), "left").withColumn("busy", F.col("bh").isNotNull())
    dealt = dealt.withColumn("key", F.when(F.col("busy"), F.xxhash64("h", "g")).otherwise(F.col("key")))
    dealt = dealt.select("key", "h", "g", "doc", "tag", "sn", "busy", "bytes").repartition("key").drop("key").sortWithinPartitions("h", "g", "doc", "tag", "sn")
    folded = materialise(map_arrow(dealt, _fold(True, hot), _FOLDED + ", bytes binary"), "segments")
    discard(found)
    return folded


def _merged(cut: DataFrame, length: int) -> DataFrame:
    rows = cut.select("h", "doc", "tag", "sn", "bytes").repartition("h").sortWithinPartitions("h", "doc", "tag", "sn")
    return materialise(map_arrow(rows, _merge(length), "doc bigint, tag bigint, sn bigint"), "runs")


def repeated_runs(texts: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc, tag and sn (start * 256 + number) of all runs of windows that also start earlier; runs may touch or repeat."""
    texts = texts.where("doc_id is not null")
    folded = _folded(map_arrow(texts.select("doc_id", "tag", "text"), _found(length), _FOUND))
    out = folded.where("h is null").select("doc", "tag", "sn")
    wanted = folded.where("h is not null").groupBy("doc", F.col("tag").alias("doc_tag")).agg(F.collect_list(F.struct("sn", "h")).alias("wanted"))
    joined = texts.join(wanted, (F.col("doc_id") == F.col("doc")) & (F.col("tag") == F.col("doc_tag"))).select("doc_id", "tag", "text", "wanted")
    cut = first_cut = materialise(map_arrow(joined, _cut(length), "h bigint, doc bigint, tag bigint, sn bigint, bytes binary"), "cut")
    for k in (DEEPER, length):
        grams = folded.where(F.col("nth") == hot).select(F.col("h").alias("hot")).distinct()
        n = grams.count()
        if not n:
            break
        grams = F.broadcast(grams) if n <= BROADCAST_IDS else grams
        out = out.unionByName(_merged(cut.join(grams, F.col("h") == F.col("hot"), "left_anti"), length))
        split = cut.join(grams, F.col("h") == F.col("hot"), "left_semi").select("h", "doc", "tag", "sn", "bytes")
        folded = _folded_again(split, length, k, hot)
        out = out.unionByName(folded.where("h is null").select("doc", "tag", "sn"))
        cut = folded.where("h is not null")
    else:
        # single windows of one gram are all equal, so none is left to merge
        discard(first_cut)
        return out
    out = out.unionByName(_merged(cut, length))
    discard(first_cut)
    return out


def dedup(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    texts = tagged(docs)
    marks = repeated_runs(texts, length, hot).groupBy("doc", F.col("tag").alias("doc_tag")).agg(F.collect_list("sn").alias("marks"))
    joined = texts.join(marks, (F.col("doc_id") == F.col("doc")) & (F.col("tag") == F.col("doc_tag")), "left").select("doc_id", "text", "marks")
    return map_arrow(joined, _remove(length), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
