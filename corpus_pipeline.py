"""Documents to a sharded training mix: toxicity, near-duplicates, decontamination, mixing, sharding.

Each stage is a function of (spark, docs, sf_dir) on what its predecessor kept. All but the last
return the columns of `documents`; the last returns each row's shard in the committed manifest.

Defined cases, of all stages: documents with null or empty texts are neither toxic nor copies nor
contaminated, and the mix takes them as often as their source is taken whole. Null sources are a source;
rows with a null doc_id are kept by the filters unless they copy another row. Very long texts are read
whole. Of equal texts the smallest doc_id stays. Repeated rows under one doc_id stay or go together.
An empty table passes all stages. Extra columns, whatever their names, pass all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formweave.llm import decontaminate, minhash, mixing, sharding, toxicity
from formweave.llm.common import materialise, shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id; pairs link at a similarity of 0.80."""
    return minhash.drop_near_duplicates(docs, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as their source's target asks; repeats are rows."""
    return mixing.mix(docs, F.array(F.col("source")))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix is stored as shards; each row is returned with its shard and manifest version."""
    rows, manifest = sharding.shard_documents(docs, f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}")
    return rows.select("doc_id", F.lit(manifest.version).alias("version"), F.col("_shard").alias("shard"), F.col("_shard_bytes").alias("shard_bytes"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Learning, MinHash, tiling, flows and files are no SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
