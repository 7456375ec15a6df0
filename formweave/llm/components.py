"""Connected components of an edge table by alternating large and small stars.

Each round joins every edge with the least neighbour of its upper end, so the work is spread over
edges and no task or driver holds a component. Rounds are written to the shared folder, and each round
deletes the one before. The centre of a large star is the end of many edges: up to BROADCAST_EDGES the
least neighbours are broadcast, so that edges are not dealt by their end at all; beyond it both sides are
written tables, whose join Spark splits where a key is frequent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: The least neighbours of so many edges, at most two rows of 16 bytes an edge, are broadcast.
BROADCAST_EDGES = 250_000


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that is not itself the least of its component; `edges` has u and v.

    Null ends, loops and repeated edges are ignored.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e = materialise(e, "edges")
    before = _mark(e)
    while before[0]:
        few, written = before[0] <= BROADCAST_EDGES, [e]

        def held(df: DataFrame, name: str) -> DataFrame:
            if few:
                return F.broadcast(df)
            written.append(materialise(df, name))
            return written[-1]

        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = held(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        if not few:
            large = materialise(large, "large")
            written.append(large)
        least = held(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m"), "least")
        small = large.join(least, F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        discard(*written)
        now = _mark(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
