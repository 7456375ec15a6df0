"""The corpus queries: one per operator, over its whole table with production parameters."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, minhash, mixing, oracles, quality_rules, quotations, secrets, sharding, suffix_dedup, toxicity, url_filter
from .common import scratch_path, table

#: The rules that the URL query judges by.
URL_RULES = [
    url_filter.Rule("block", "com", "/en/"),
    url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
]
#: Hosts whose pages the URL query's listing holds.
LISTED_HOSTS = ("spam-farm.example.com", "spam-farm.example.net", "spam-farm.example.org", "cheap-pills.example.com", "cheap-pills.example.net", "cheap-pills.example.org")
#: Fixed value: the tag in a query string that puts a page's canonical URL on the listing.
LISTED_TAG = "ref=x"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the plan's table of sizes, so that texts are read once; a document's pattern is its source."""
    plan = mixing.plan(table(spark, sf_dir, "documents"), F.array(F.col("source")))
    taken = mixing.times(plan.sized, plan, "id", "pattern", "n")
    rows = [(key, plan.source_sizes[s], float(plan.targets[s])) for key, *_ in plan.rows for s in json.loads(key)]
    sources = mixing.short_table(spark, rows, "source string, source_size bigint, target double")
    joined = taken.join(sources, F.col("pattern") == F.col("source"))
    return joined.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("n")).alias("taken"))


def op4_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table comes in three arrivals, each stored as small shards, and is compacted across them."""
    root = scratch_path(spark, "shards")
    docs = table(spark, sf_dir, "documents")
    for k in range(3):
        sharding.append(docs.where(F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(3)), F.lit(0)) == k), root)
    m = sharding.compact(spark, root)
    rows = sharding.read(spark, root, m.version)
    return rows.select("doc_id", F.lit(m.version).alias("version"), F.col("_shard").alias("shard"), F.col("_shard_bytes").alias("shard_bytes"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op6_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.link_conversations(table(spark, sf_dir, "conversations"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing: canonical URLs of pages on spam hosts, and of pages that were reached by a referral link."""
    pages = table(spark, sf_dir, "pages")
    host, path = url_filter.parts(F.col("url"))
    bad = F.regexp_extract("url", r"\?([^#]*)", 1).contains(LISTED_TAG)
    for h in LISTED_HOSTS:
        bad = bad | (F.col("host") == h) | F.col("host").endswith("." + h)
    listing = pages.select("url", host.alias("host"), path.alias("path")).where(bad).select(url_filter.canonical(F.col("host"), F.col("path")).alias("url"))
    return url_filter.filter_urls(pages, URL_RULES, listing)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_decontaminate, op2_secrets, op3_mix, op4_shard, op5_suffix_dedup, op6_quotes, op7_urls, op8_near_duplicates, op9_toxicity, op10_quality)
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_suffix_dedup": oracles.OP5,
        "op6_quotes": oracles.OP6,
        "op7_urls": oracles.op7(URL_RULES, LISTED_HOSTS, LISTED_TAG),
        "op8_near_duplicates": oracles.OP8,
        "op10_quality": oracles.OP10,
    }
