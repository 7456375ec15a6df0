"""Helpers shared by the corpus operators: tables, shared storage and vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Java regular expression of one word: a run without space, tab, LF, VT, FF and CR.
WORD_RE = r"[^\x20\x09-\x0D]+"
BATCH_ROWS = 2_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(c, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a temporary folder stands in, but on a local master alone: the executors of a
    cluster would each write to their own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not found:
        found = sc._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set, and the executors share no other folder")
        found = tempfile.mkdtemp(prefix="formweave-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which is deleted when the driver ends at the latest."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, p = file_system(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def exchanges_dropped(spark: SparkSession):
    """Inside, Spark drops the exchange files of a query as soon as its output is written; the setting is put back after."""
    old = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, old)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back, which cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with exchanges_dropped(spark):
        df.write.mode("append").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.formweave_path = path
    return out


def discard(*written: DataFrame) -> None:
    """Deletes the folders of tables that `materialise` returned and that nothing reads any more."""
    for df in written:
        drop_path(df.sparkSession, df.formweave_path)


def map_arrow(df: DataFrame, rows, schema: str | StructType) -> DataFrame:
    """mapInArrow with batches of at most BATCH_ROWS rows, so that workers and Arrow buffers stay small beside the heap."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(rows, schema)


def file_system(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of a path, and the path as its object."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def drop_path(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
#: Separators that also cut at ASCII punctuation.
PUNCT = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_M = 0x9E3779B97F4A7C15 | 1
_POW: dict[str, np.ndarray] = {}


def mix(x: np.ndarray, k: int = 0xBF58476D1CE4E5B9) -> np.ndarray:
    """A 64-bit finaliser on an unsigned array."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(k)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier mod 2^64, and of its inverse, up to n entries; kept per worker."""
    if len(_POW.get("f", ())) < n:
        size = max(n, (1 << 19) + (1 << 16))
        inverse = pow(_M, -1, 1 << 64)
        for key, m in (("f", _M), ("i", inverse)):
            out = np.full(size, m, np.uint64)
            out[0] = 1
            _POW[key] = np.cumprod(out, dtype=np.uint64)
    return _POW["f"][:n], _POW["i"][:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; null rows are empty."""
    return _bytes(pc.fill_null(column.cast(pa.large_string()), ""))


def binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a binary column; null rows are empty."""
    return _bytes(pc.fill_null(column.cast(pa.large_binary()), b""))


def _bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    n = len(arr)
    if n == 0 or arr.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1]
    return np.frombuffer(arr.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of some rows: `rows[i]:rows[i+1]` are the words of row i, `hash` their 64-bit hashes."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    rows: np.ndarray
    hash: np.ndarray
    total: np.ndarray

    def prefixes(self, k: int) -> np.ndarray:
        """Hashes of the first k bytes of each word; the word's own hash where it is no longer than that."""
        _, inv = powers(len(self.total))
        h = mix((self.total[np.minimum(self.start + k, self.end)] - self.total[self.start]) * inv[self.start] + np.uint64(k << 32))
        return np.where(self.end - self.start > k, h, self.hash)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word runs inside a row, and row offsets into them.

        A row with 1 to k-1 words has one run, its whole sequence; a row without words has none.
        """
        n = np.diff(self.rows)
        m = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
        off = np.concatenate([[0], np.cumsum(m)])
        first = np.repeat(self.rows[:-1], m) + np.arange(off[-1]) - np.repeat(off[:-1], m)
        out = np.zeros(off[-1], np.uint64)
        padded = np.concatenate([self.hash, np.zeros(k, np.uint64)])
        last = np.repeat(self.rows[1:], m)
        for j in range(k):
            out = out * np.uint64(0xD6E8FEB86659FD93) + np.where(first + j < last, padded[first + j], np.uint64(0x1234567))
        return mix(out), off


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, sep: np.ndarray = _SEP) -> Words:
    """Splits rows into words and hashes them, without a Python loop."""
    n = len(data)
    data = _LOW[data] if lower else data
    inside = ~sep[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    fwd, inv = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * fwd[:n], out=total[1:])
    h = mix((total[end] - total[start]) * inv[start] + (end - start).astype(np.uint64))
    return Words(data, start, end, np.searchsorted(start, offsets), h, total)


def slices(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; one longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_slices(column: pa.Array, lower: bool = True, most: int = 1 << 19, sep: np.ndarray = _SEP) -> Iterator[tuple[int, int, Words]]:
    """Words of a text column by row ranges, so that memory stays bounded by the range or the longest row."""
    data, offsets = utf8(column)
    for i, j in slices(offsets, most):
        yield i, j, words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower, sep)
