"""Near-duplicates by b-bit MinHash.

A document's set holds the hashes of its distinct 5-word shingles. Documents with equal sets are
folded into one node first, so copies never meet in a join. Of 128 minima per node, 96 form 24 bands
of four (all 128 form 32 bands where the threshold is 0.80), and the two low bits of all 128 are packed into a 256-bit signature. Nodes that share a band
are candidates; the signatures' matching bits, corrected for chance collisions, estimate their
similarity. Candidates at `floor` or above hang together in candidate groups. In these the estimate
again picks the pairs to compare, and full sets decide; pairs already connected need no test.

Losses: bands and floor follow from the threshold. A pair at 0.85 shares no band with a chance of
(1 - 0.85^4)^24 = 2e-8, one at 0.80 with (1 - 0.80^4)^32 = 5e-8. The floor is the highest that an
estimate at the threshold misses with at most 1e-7, by the binomial of matching minima: 0.625 for 0.85,
0.552 for 0.80. More similar pairs are lost less often still. Below 0.80 the minima do not suffice and
the threshold is refused. Everything else is exact up to 64-bit hash collisions.

A group of bounded size is one task, which holds its sets. A larger group is not compared pair by pair.
All its nodes are first compared with LEADERS of them; what these links tie together most is its main
cluster, and pairs inside that need no test. Of the other nodes, one can link at all only if some of its
rarest shingles, as many as the threshold allows to differ and one more, stand in another set of the
group (prefix filter). The nodes left over are compared with all of the group, in tasks of a block of them
and a chunk of the group. So sets are moved in proportion to the group where it hangs together, or where
its members share no more than a common passage; in a group of many clusters they are moved once for each
block of nodes outside the main one. Tasks emit a star per local component and never pairs.

Defined cases: null and empty texts, and texts without words, have no shingles, link with nothing
and are kept. Fewer words than five are one shingle. Very long texts are one set like others. Repeated
rows under one doc_id are one document: what one of its texts links to, the others do. Of equal texts the
smallest doc_id stays. A null doc_id stands for no component of its own: such rows are kept unless they copy another row.
An empty table gives an empty result. Extra columns are ignored by the report and kept by the filter,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, map_arrow, materialise, mix, word_slices
from .components import connected_components

SHINGLE, MINIMA, ROWS, LOSS = 5, 128, 4, 1e-7
BLOCK_NODES, BLOCK_SHINGLES = 2048, 1 << 20
LEADERS = 16
BROADCAST_NODES = 200_000
_MULTIPLIERS = np.random.default_rng(20_240_601).integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SIG = ["s0", "s1", "s2", "s3"]


def bands_for(percent: int) -> int:
    """Bands such that a pair at the threshold shares none with a chance of LOSS at most; 24 at least."""
    bands = max(24, math.ceil(math.log(LOSS) / math.log1p(-((percent / 100) ** ROWS)))) if percent < 100 else 24
    bands = -(-bands // 8) * 8
    if bands * ROWS > MINIMA:
        raise ValueError(f"{MINIMA} minima do not find pairs at {percent} percent")
    return bands


def floor_for(percent: int) -> float:
    """The highest estimate that a pair at the threshold falls below with a chance of LOSS at most."""
    match, below, k = 0.25 + 0.75 * percent / 100, 0.0, 0
    while k < MINIMA and (below := below + math.comb(MINIMA, k) * match**k * (1 - match) ** (MINIMA - k)) <= LOSS:
        k += 1
    return (k / MINIMA - 0.25) / 0.75


BANDS, FLOOR = bands_for(85), floor_for(85)


def distinct_shingles(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, distinct shingle hashes in ascending order per row, and row offsets."""
    for i, j, w in word_slices(column):
        h, off = w.shingles(SHINGLE)
        parts = [np.unique(h[off[k] : off[k + 1]]) for k in range(j - i)]
        sizes = np.fromiter(map(len, parts), np.int64, j - i)
        yield i, j, (np.concatenate(parts) if parts else h), np.concatenate([[0], np.cumsum(sizes)])


def signatures(h: np.ndarray, off: np.ndarray, bands: int = BANDS) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (rows, bands) and packed low bits (rows, 4) of rows that have shingles."""
    minima = np.empty((len(off) - 1, MINIMA), np.uint64)
    for k in range(MINIMA):
        minima[:, k] = np.minimum.reduceat(h * _MULTIPLIERS[k], off[:-1])
    keys = np.empty((len(minima), bands), np.uint64)
    for b in range(bands):
        x = np.full(len(minima), b + 1, np.uint64)
        for r in range(ROWS):
            x = mix(x * np.uint64(0x9DDFEA08EB382D69) + minima[:, b * ROWS + r])
        keys[:, b] = x
    low = mix(minima)
    planes = [np.packbits(((low >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8), axis=1) for bit in (0, 1)]
    return keys, np.concatenate(planes, axis=1).view(np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of signatures (..., 4): matching minima by bit counts, less chance matches of two bits."""
    differ = np.bitwise_count((a[..., 0] ^ b[..., 0]) | (a[..., 2] ^ b[..., 2])).astype(np.int16)
    differ += np.bitwise_count((a[..., 1] ^ b[..., 1]) | (a[..., 3] ^ b[..., 3]))
    return ((MINIMA - differ) / MINIMA - 0.25) / 0.75


def sketch(docs: DataFrame, bands: int = BANDS) -> DataFrame:
    """doc_id, n, 128-bit set fingerprint f0 and f1, signature and band keys of every document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, off in distinct_shingles(batch.column(1)):
                n = np.diff(off)
                full = n > 0
                f = np.zeros((2, j - i), np.uint64)
                sig = np.zeros((j - i, 4), np.uint64)
                keys = np.zeros((j - i, bands), np.uint64)
                if full.any():
                    starts = np.append(off[:-1][full], off[-1])
                    for k in range(2):
                        f[k, full] = np.add.reduceat(mix(h + np.uint64(k), 0xD6E8FEB86659FD93 + 2 * k), starts[:-1])
                    keys[full], sig[full] = signatures(h, starts, bands)
                lists = np.where(full, bands, 0)
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lists)]), pa.int32()), pa.array(keys[full].ravel().view(np.int64)))
                fixed = [pa.array(x.view(np.int64)) for x in (f[0], f[1], *np.ascontiguousarray(sig.T))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), *fixed, listed], ["doc_id", "n", "f0", "f1", *_SIG, "bands"])

    schema = "doc_id bigint, n bigint, f0 bigint, f1 bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint, bands array<bigint>"
    return map_arrow(docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text"), rows, schema)


class _Union:
    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, i: int, others: np.ndarray) -> None:
        """Joins i with others; roots are kept flat, so that one comparison tells whether two are connected."""
        roots = np.unique(np.append(self.root[others], self.root[i]))
        self.root[np.isin(self.root, roots)] = roots[0]


def _stars(ids: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each id to the least id of its local component."""
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, root, ids)
    low = least[root]
    use = ids != low
    return ids[use], low[use]


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    """Neighbouring rows that agree in the first `keys` columns, as lists of batches; runs of one row are left out."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if key != last:
                if sum(x.num_rows for x in held) > 1:
                    yield held
                held, last = [], key
            held.append(batch.slice(a, b - a))
    if sum(x.num_rows for x in held) > 1:
        yield held


def candidate_edges(nodes: DataFrame, floor: float = FLOOR) -> DataFrame:
    """Edges u, v that tie the nodes of each candidate group together.

    Buckets of up to BLOCK_NODES nodes are compared by signature. A larger bucket is tied into one
    group as it is: that only widens the group whose pairs are compared later on.
    """
    rows = nodes.select(F.explode("bands").alias("key"), "rep", *_SIG).repartition("key").sortWithinPartitions("key", "rep")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u, v in _bucket_edges(batches, floor):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return map_arrow(rows, kernel, "u bigint, v bigint").distinct()


def _bucket_edges(batches: Iterator[pa.RecordBatch], floor: float = FLOOR) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    key0, first, window = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, ids, *sig = (batch.column(k).to_numpy() for k in range(6))
        sig = np.stack(sig, axis=1).view(np.uint64)
        if window is not None:
            key, ids, sig = (np.concatenate([x, y]) for x, y in zip(window, (key, ids, sig), strict=True))
        if key0 is not None and key[0] == key0:
            # the large bucket goes on
            m = int(np.searchsorted(key, key0, "right"))
            yield ids[:m][ids[:m] != first], np.full(int((ids[:m] != first).sum()), first)
            if m == len(key):
                window = key[:1], ids[:1], sig[:1]
                continue
            key, ids, sig, key0 = key[m:], ids[m:], sig[m:], None
        # the last key may go on in the next batch
        tail = int(np.searchsorted(key, key[-1], "left"))
        if len(key) - tail > BLOCK_NODES:
            # too large to compare: all are tied to the bucket's first node, and only that stays
            key0, first = key[-1], ids[tail]
            lead = first
            yield ids[tail:][ids[tail:] != lead], np.full(int((ids[tail:] != lead).sum()), lead)
            rest = slice(tail, tail + 1)
        else:
            rest = slice(tail, None)
        yield from _compare(key[:tail], ids[:tail], sig[:tail], floor)
        window = key[rest], ids[rest], sig[rest]
    if window is not None:
        yield from _compare(*window, floor)


def _compare(key: np.ndarray, ids: np.ndarray, sig: np.ndarray, floor: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if len(key) < 2:
        return
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(start, len(key)))
    two = start[size == 2]
    near = similarity(sig[two], sig[two + 1]) >= floor
    yield ids[two + 1][near], ids[two][near]
    for a, n in zip(start[size > 2], size[size > 2], strict=True):
        own, s = ids[a : a + n], sig[a : a + n]
        groups = _Union(n)
        for i in range(n - 1):
            other = np.flatnonzero(groups.root[i + 1 :] != groups.root[i]) + i + 1
            hit = other[similarity(s[other], s[i]) >= floor] if len(other) else other
            if len(hit):
                groups.join(i, hit)
        yield _stars(own, groups.root)


def linked(ids: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], percent: int, held: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the components that links make between all rows, or between the first `held` rows and the others.

    Rows of one id are connected already.
    """
    n = len(ids)
    size = np.fromiter(map(len, sets), np.int64, n)
    groups = _Union(n)
    groups.root = np.unique(ids, return_index=True)[1][np.unique(ids, return_inverse=True)[1]]
    floor = floor_for(percent)
    for i in range(held or n):
        pick = groups.root != groups.root[i]
        pick[: held or i + 1] = False
        other = np.flatnonzero(pick)
        if not len(other):
            continue
        small, large = np.minimum(size[other], size[i]), np.maximum(size[other], size[i])
        other = other[(100 * small >= percent * large)]
        other = other[similarity(sig[other], sig[i]) >= floor]
        if not len(other):
            continue
        own = sets[i]
        flat = np.concatenate([sets[k] for k in other])
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        both = np.add.reduceat((own[at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(size[other])[:-1]]))
        hit = other[100 * both >= percent * (size[i] + size[other] - both)]
        if len(hit):
            groups.join(i, hit)
    return _stars(ids, groups.root)


def _sets(column: pa.Array) -> list[np.ndarray]:
    off, flat = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
    return [flat[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]


def verified_edges(docs: DataFrame, nodes: DataFrame, groups: DataFrame, percent: int, block: int = BLOCK_NODES, again: bool = False) -> DataFrame:
    """Edges u, v between nodes whose full sets link, found inside candidate groups; `groups` has node and component.

    `again`: some doc_id is repeated, so that a node's id may bring several texts, each of which counts once.
    """
    roots = groups.select(F.col("component").alias("node"), "component").distinct()
    member = groups.unionByName(roots).join(nodes.select("rep", "n", *_SIG), F.col("node") == F.col("rep"))
    member = materialise(member.select(F.col("component").alias("g"), "rep", "n", *_SIG), "members")
    sums = member.groupBy("g").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    # single documents beyond the bound of shingles are no reason to split a group of few
    big = sums.where((F.col("c") > block) | ((F.col("w") > BLOCK_SHINGLES) & (F.col("c") > 2 * LEADERS)))
    big = materialise(big.select(F.col("g").alias("big"), F.greatest(F.ceil(F.col("c") / block), F.ceil(F.col("w") / BLOCK_SHINGLES)).cast("int").alias("chunks")), "big")
    n_big, n_member = big.count(), member.count()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("d"), F.col("text").cast("string").alias("text"))

    def with_text(rows: DataFrame) -> DataFrame:
        # beyond the checked size the texts are shuffled instead
        found = texts.join(F.broadcast(rows) if n_member <= BROADCAST_NODES else rows, F.col("d") == F.col("rep"))
        if not again:
            return found
        return found.groupBy(*rows.columns, F.xxhash64("text").alias("copy")).agg(F.first("text").alias("text"))

    few = F.broadcast(big) if n_big <= BROADCAST_NODES else big
    rows = with_text(member.join(few, F.col("g") == F.col("big"), "left_anti")).select("g", "rep", *_SIG, "text")
    rows = rows.repartition("g").sortWithinPartitions("g", "rep")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, 1):
            t = pa.Table.from_batches(run).combine_chunks()
            sets: list[np.ndarray] = []
            for i, j, h, off in distinct_shingles(t["text"].chunk(0)):
                sets += [h[off[k] : off[k + 1]] for k in range(j - i)]
            sig = np.stack([t[c].to_numpy() for c in _SIG], axis=1).view(np.uint64)
            ok = [k for k, x in enumerate(sets) if len(x)]
            if len(ok) > 1:
                u, v = linked(t["rep"].to_numpy()[ok], sig[ok], [sets[k] for k in ok], percent)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    small = map_arrow(rows, kernel, "u bigint, v bigint")
    if not n_big:
        return small

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, off in distinct_shingles(batch["text"]):
                sh = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(h.view(np.int64)))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part[c] for c in ("g", "chunks", "rep", "n", *_SIG)), sh], ["g", "chunks", "rep", "n", *_SIG, "sh"])

    schema = "g bigint, chunks int, rep bigint, n bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint, sh array<bigint>"
    large = with_text(member.join(few, F.col("g") == F.col("big"))).select("g", "chunks", "rep", "n", *_SIG, "text")
    return small.unionByName(_large_edges(materialise(map_arrow(large, listed, schema), "sets"), percent, block))


def _large_edges(sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Edges u, v of large groups: `sets` has g, chunks, rep, n, signature and shingles of each node."""
    mins = [F.min(F.struct(F.xxhash64("rep", F.lit(i)).alias("o"), F.col("rep").alias("r"))) for i in range(LEADERS)]
    leaders = sets.groupBy("g").agg(F.array_distinct(F.transform(F.array(*mins), lambda x: x["r"])).alias("l")).select("g", F.explode("l").alias("lead"))
    own = sets.withColumn("cluster", F.col("rep"))
    stars = materialise(_compared(own, leaders.select("g", "lead", F.lit(1).alias("blocks")), percent), "stars")
    parts = connected_components(stars).withColumnRenamed("node", "cn")
    clustered = sets.join(parts, F.col("rep") == F.col("cn"), "left").withColumn("cluster", F.coalesce("component", "rep")).drop("cn", "component")
    clustered = materialise(clustered, "clustered")
    main = clustered.groupBy("g", "cluster").count().groupBy("g").agg(F.max_by("cluster", F.struct("count", "cluster")).alias("main"))
    rest = clustered.join(main.withColumnRenamed("g", "mg"), F.col("g") == F.col("mg")).where("cluster <> main").select("g", "rep", "n", "sh")
    # how many shingles of a node outside the main cluster stand in another set of its group
    shared = clustered.select("g", F.explode("sh").alias("t")).groupBy("g", "t").count().where("count > 1").select(F.col("g").alias("tg"), F.col("t").alias("tt"))
    tokens = rest.select("g", "rep", "n", F.explode("sh").alias("t"))
    held = tokens.join(shared, (F.col("g") == F.col("tg")) & (F.col("t") == F.col("tt"))).groupBy("g", "rep", "n").count()
    # a link needs all but the prefix's rest in common, so a node with more shingles of its own than that has none
    able = held.where(100 * F.col("count") >= percent * F.col("n")).select("g", "rep", "n")
    size = able.groupBy(F.col("g").alias("ag")).agg(F.greatest(F.ceil(F.count("*") * 2 / block), F.ceil(F.sum("n") * 2 / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    able = materialise(able.join(size, F.col("g") == F.col("ag")).select("g", F.col("rep").alias("lead"), "blocks"), "able")
    return stars.unionByName(_compared(clustered, able, percent))


def _compared(sets: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Edges between clusters that links of the held nodes (g, lead, blocks) with any node of their group make.

    A task holds one block of held nodes and one chunk of the group.
    """
    columns = ["g", "j", "c", "role", "cluster", *_SIG, "sh"]
    blocks = held.groupBy(F.col("g").alias("hg")).agg(F.max("blocks").alias("blocks"))
    c, j = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")).cast("int")
    streamed = sets.join(blocks, F.col("g") == F.col("hg")).withColumn("c", c).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("role", F.lit(1))
    kept = sets.join(held.withColumnRenamed("g", "hg"), (F.col("g") == F.col("hg")) & (F.col("rep") == F.col("lead"))).withColumn("j", j)
    kept = kept.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("role", F.lit(0))
    rows = kept.select(columns).unionByName(streamed.select(columns)).repartition("g", "j", "c").sortWithinPartitions("g", "j", "c", "role", "cluster")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, 3):
            t = pa.Table.from_batches(run).combine_chunks()
            n = int((t["role"].to_numpy() == 0).sum())
            if not n or n == len(t):
                continue
            sig = np.stack([t[x].to_numpy() for x in _SIG], axis=1).view(np.uint64)
            u, v = linked(t["cluster"].to_numpy(), sig, _sets(t["sh"].chunk(0)), percent, n)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return map_arrow(rows, kernel, "u bigint, v bigint").distinct()


def _same_document(rows: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """Edges u, v between the nodes of the texts of each repeated doc_id; None if no doc_id is repeated."""
    twice = rows.where("doc_id is not null and n > 0").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("d"))
    twice = materialise(twice, "twice")
    if twice.isEmpty():
        return None
    own = rows.join(twice, F.col("doc_id") == F.col("d")).select("d", "f0", "f1").distinct().join(nodes.select("f0", "f1", "rep"), ["f0", "f1"])
    least = own.groupBy(F.col("d").alias("m")).agg(F.min("rep").alias("v"))
    return own.join(least, F.col("d") == F.col("m")).select(F.col("rep").alias("u"), "v")


def near_duplicates(docs: DataFrame, percent: int = 85, block: int = BLOCK_NODES) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    rows = materialise(sketch(docs, bands_for(percent)), "sketch")
    nodes = rows.where("n > 0").groupBy("f0", "f1").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), *(F.first(c).alias(c) for c in (*_SIG, "bands")))
    nodes = materialise(nodes, "nodes")
    known = nodes.where("rep is not null")
    groups = connected_components(candidate_edges(known, floor_for(percent)))
    same = _same_document(rows, known)
    found = verified_edges(docs, known, groups, percent, block, same is not None)
    parts = connected_components(found if same is None else found.unionByName(same)).withColumnRenamed("node", "cn")
    of = nodes.select("f0", "f1", "rep").join(parts, F.col("rep") == F.col("cn"), "left").select("f0", "f1", F.coalesce("component", "rep").alias("least"))
    out = rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("f0")).alias("r0"), F.col("f1").alias("r1"))
    out = out.join(of, (F.col("r0") == F.col("f0")) & (F.col("r1") == F.col("f1")), "left")
    component = F.coalesce("least", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One document of each component, with all columns; the report is keyed by doc_id, and rows repeated under one are one."""
    own = free_name(docs, "_nd_id")
    verdict = near_duplicates(docs, percent).groupBy(F.col("doc_id").alias(own)).agg(F.max("kept").alias("kept"))
    gone = materialise(verdict.where("not kept").select(own), "dropped")
    if gone.count() <= 2_000_000:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col("doc_id") == F.col(own), "left_anti")
