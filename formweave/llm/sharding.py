"""Sharding by size-tiered compaction with a versioned manifest.

Arrivals are appended as small immutable Parquet shards. Compaction groups shards of similar size:
whenever a tier holds `fanout` runs, they are merged, until runs reach the target size. The tiers
are worked out on file sizes first, so each row is rewritten once and not once per tier. A manifest
lists the live shards of a version: its rows are a Parquet table, and a small file that names the table
commits it. Files are never changed, so readers follow one manifest throughout, and every version can
be read until `vacuum` is asked to drop it.

The commit is one step that fails if the version exists: a hard link on a local or mounted file system,
a rename without replacement elsewhere, which name nodes carry out atomically. Object stores have
neither and are refused. Appends commute, so a writer that loses tries the next version; a compaction
that loses fails and leaves the winner as it is.

Defined cases: an empty table appends no rows; its version may list a shard without rows. Null values,
very long texts, repeated rows and extra columns, whatever their names, are stored as they are. Shards
of one size are merged in order of their paths.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass
from urllib.parse import urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import drop_path, exchanges_dropped, file_system, free_name

BROADCAST_FILES = 100_000
#: Schemes whose renames are copies.
OBJECT_STORES = ("s3", "s3a", "s3n", "gs", "wasb", "wasbs", "oss", "cosn", "obs")


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str
    shards: tuple[Shard, ...]


class VersionTaken(RuntimeError):
    """Another writer has committed the version."""


def versions(spark: SparkSession, root: str) -> list[int]:
    fs, p = file_system(spark, f"{root}/_manifests")
    if not fs.exists(p):
        return []
    return sorted(int(s.getPath().getName()[1:-5]) for s in fs.listStatus(p) if s.getPath().getName().startswith("v"))


def load(spark: SparkSession, root: str, version: int | None = None) -> Manifest | None:
    """A committed manifest, the latest by default; None before the first commit."""
    known = versions(spark, root)
    if not known:
        return None
    version = known[-1] if version is None else version
    raw = json.loads(spark.read.text(f"{root}/_manifests/v{version:08d}.json", wholetext=True).head()[0])
    rows = spark.read.schema("path string, bytes bigint").parquet(f"{root}/_manifests/{raw['shards']}")
    return Manifest(version, raw["schema"], tuple(Shard(*r) for r in sorted(map(tuple, rows.collect()))))


def _publish(spark: SparkSession, temp: str, final: str) -> bool:
    """Gives a written file its final name in one step; false if another file has it."""
    fs, p = file_system(spark, temp)
    scheme = fs.getUri().getScheme()
    if scheme in OBJECT_STORES:
        raise ValueError(f"{scheme} has no atomic rename, so versions cannot be committed there")
    if scheme == "file":
        try:
            os.link(urlparse(temp).path, urlparse(final).path)
        except FileExistsError:
            return False
        return True
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs
    none = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        hadoop.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(p, hadoop.Path(final), none)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception):
            return False
        raise
    return True


def commit(spark: SparkSession, root: str, manifest: Manifest) -> None:
    """Writes the shards' table, then names it as the version; raises VersionTaken if that exists."""
    fs, folder = file_system(spark, f"{root}/_manifests")
    fs.mkdirs(folder)
    name = uuid.uuid4().hex
    rows = spark.createDataFrame([(s.path, s.bytes) for s in manifest.shards], "path string, bytes bigint")
    rows.coalesce(1).write.parquet(f"{root}/_manifests/shards-{name}")
    temp = f"{root}/_manifests/.{name}"
    out = fs.create(file_system(spark, temp)[1], False)
    out.write(bytearray(json.dumps({"version": manifest.version, "schema": manifest.schema, "shards": f"shards-{name}"}).encode()))
    out.close()
    won = _publish(spark, temp, f"{root}/_manifests/v{manifest.version:08d}.json")
    drop_path(spark, temp)
    if not won:
        drop_path(spark, f"{root}/_manifests/shards-{name}")
        raise VersionTaken(f"version {manifest.version} is already committed")


def _listed(spark: SparkSession, path: str) -> list[Shard]:
    """Parquet files under `path` with their sizes, without reading them: a row per file, of which there are as many as the data has shards."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return sorted((Shard(r["path"], r["length"]) for r in files.select("path", "length").collect()), key=lambda s: s.path)


def append(docs: DataFrame, root: str, rows_per_shard: int = 4_000, tries: int = 100) -> Manifest:
    """Stores arrivals as small shards and commits a version that adds them to the latest one."""
    spark = docs.sparkSession
    path = f"{root}/data/arrival-{uuid.uuid4().hex}"
    docs.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_shard).parquet(path)
    fresh = tuple(_listed(spark, path))
    for _ in range(tries):
        old = load(spark, root)
        new = Manifest(old.version + 1 if old else 1, docs.schema.json(), (old.shards if old else ()) + fresh)
        try:
            commit(spark, root, new)
            return new
        except VersionTaken:
            continue
    raise VersionTaken(f"{tries} versions were taken in turn")


def tiers(shards: list[Shard], target: int, fanout: int = 4, smallest: int = 1 << 20) -> list[list[Shard]]:
    """Groups of shards that size-tiered merging would bring together; a group of one stays as it is.

    A run's tier is the power of `fanout` that its size has over `smallest`. While a tier holds
    `fanout` runs below the target, its runs are merged smallest first into runs of up to the target.
    """

    def tier(size: int) -> int:
        t, edge = 0, smallest
        while size > edge:
            t, edge = t + 1, edge * fanout
        return t

    done: list[list[Shard]] = []
    open_runs: dict[int, list[tuple[int, list[Shard]]]] = {}
    for s in shards:
        if s.bytes >= target:
            done.append([s])
        else:
            open_runs.setdefault(tier(s.bytes), []).append((s.bytes, [s]))
    while full := [t for t, runs in open_runs.items() if len(runs) >= fanout]:
        t = min(full)
        runs = sorted(open_runs.pop(t), key=lambda r: (r[0], r[1][0].path))
        size, group, count, merged = 0, [], 0, []
        for b, g in runs:
            if group and size + b > target:
                merged.append((size, group, count))
                size, group, count = 0, [], 0
            size, group, count = size + b, group + g, count + 1
        merged.append((size, group, count))
        for size, group, count in merged:
            # a run that cannot grow within its tier leaves it, so that the loop ends
            if size * 2 > target or (count == 1 and len(merged) > 1):
                done.append(group)
            else:
                open_runs.setdefault(max(t + 1, tier(size)), []).append((size, group))
    return done + [g for t in sorted(open_runs) for _, g in open_runs[t]]


def compact(spark: SparkSession, root: str, target: int = 128 << 20, fanout: int = 4) -> Manifest:
    """Merges similar shards into files of about `target` bytes and commits the next version.

    A merged file is made by one task that reads at most the target size. Each merged row is moved
    once; rows of shards that stay are not read. The merged inputs stay for older versions.
    """
    old = load(spark, root)
    if old is None:
        raise ValueError(f"nothing is stored in {root}")
    groups = tiers(list(old.shards), target, fanout)
    merges = [g for g in groups if len(g) > 1]
    stay = [g[0] for g in groups if len(g) == 1]
    fresh: list[Shard] = []
    if merges:
        schema = StructType.fromJson(json.loads(old.schema))
        data = spark.read.schema(schema).parquet(*[s.path for g in merges for s in g])
        name, file, group = (free_name(data, x) for x in ("_sh_name", "_sh_file", "_sh_group"))
        rows = [(s.path.rsplit("/", 1)[1], k) for k, g in enumerate(merges) for s in g]
        plan = spark.createDataFrame(rows, f"{file} string, {group} int")
        plan = F.broadcast(plan) if len(rows) <= BROADCAST_FILES else plan
        path = f"{root}/data/merged-{uuid.uuid4().hex}"
        tagged = data.withColumn(name, F.col("_metadata.file_name")).join(plan, F.col(name) == F.col(file)).drop(name, file)
        with exchanges_dropped(spark):
            tagged.repartitionById(len(merges), F.col(group)).write.option("compression", "zstd").partitionBy(group).parquet(path)
        fresh = _listed(spark, path)
    new = Manifest(old.version + 1, old.schema, tuple(stay + fresh))
    commit(spark, root, new)
    return new


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> None:
    """Drops all versions but the latest `keep`, and the files that no kept version lists. No reader of a dropped version may be left."""
    known = versions(spark, root)
    gone, live = known[:-keep], known[-keep:]
    kept = {s.path for v in live for s in load(spark, root, v).shards}
    for v in gone:
        old = {s.path for s in load(spark, root, v).shards}
        # the version goes first, so that none is left that lists dropped files
        drop_path(spark, f"{root}/_manifests/v{v:08d}.json")
        for path in old - kept:
            drop_path(spark, path)


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of a committed version, with columns `_shard` and `_shard_bytes`, or these names and an underscore where the rows have them."""
    m = load(spark, root, version)
    if m is None:
        raise ValueError(f"nothing is stored in {root}")
    schema = StructType.fromJson(json.loads(m.schema))
    data = spark.read.schema(schema).parquet(*[s.path for s in m.shards]) if m.shards else spark.createDataFrame([], schema)
    shard, size = free_name(data, "_shard"), free_name(data, "_shard_bytes")
    if not m.shards:
        return data.withColumns({shard: F.lit("").cast("string"), size: F.lit(0).cast("long")})
    return data.withColumns({shard: F.regexp_extract(F.col("_metadata.file_path"), r"/data/(.*)$", 1), size: F.col("_metadata.file_size")})


def shard_documents(docs: DataFrame, root: str, target: int = 128 << 20) -> tuple[DataFrame, Manifest]:
    """Appends the documents, compacts, and returns the committed version's rows."""
    append(docs, root)
    m = compact(docs.sparkSession, root, target)
    return read(docs.sparkSession, root, m.version), m
