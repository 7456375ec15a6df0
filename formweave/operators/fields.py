"""Field values: extraction from lines, merge by priority, projection onto the dictionary, scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formweave.functions import text
from formweave.operators import lines as L
from formweave.operators import matching


def from_lines(lines: DataFrame, dictionary: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc, keyword, value, priority: `label: value` on a line (0), a bare label with the next value line (1), a prefix (2)."""
    headed = lines.withColumn("_head", text.before_colon(F.col("line"))).withColumn("_rest", text.clean_value(text.after_colon(F.col("line"))))
    # a bare line that is a caption is no value of the one above
    known = L.next_value(matching.exact(headed, "_head", dictionary), key=key, label=F.col("keyword").isNotNull()).where("keyword is not null")
    inline = known.where("_rest <> ''").select(key, "keyword", "line_no", F.col("_rest").alias("value"), F.lit(0).alias("priority"))
    below = known.where("_rest = ''").select(key, "keyword", "line_no", "value", F.lit(1).alias("priority"))
    prefix = L.longest_prefix(lines, dictionary, key=key).where("rest <> ''").select(key, "keyword", "line_no", F.col("rest").alias("value"), F.lit(2).alias("priority"))
    return inline.unionByName(below).unionByName(prefix)


def merge(candidates: DataFrame, key: str = "doc_id") -> DataFrame:
    """The non-empty value of the least priority, then the first line, per document and keyword."""
    return candidates.where("value <> ''").groupBy(key, "keyword").agg(F.min_by("value", F.struct("priority", "line_no")).alias("value"))


def canonical(values: DataFrame, docs: DataFrame, keywords: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every configured keyword of every document; an absent value is empty.

    The keywords ride along as one array per row, so documents are not joined with them.
    """
    listed = [r["keyword"] for r in keywords.select("keyword").distinct().orderBy("keyword").collect()]
    every = docs.select(key).withColumn("keyword", F.explode(F.array(*map(F.lit, listed)))) if listed else docs.select(key, F.lit("").alias("keyword")).limit(0)
    return every.join(values, [key, "keyword"], "left").withColumn("value", F.coalesce("value", F.lit("")))


def score(values: DataFrame, kinds: DataFrame, strict: float = 0.8) -> DataFrame:
    """Adds kind, confidence, reason, source and strict: non-empty with at least the strict confidence."""
    out = values.join(matching.small(kinds), "keyword", "left").withColumn("kind", F.coalesce("kind", F.lit("text")))
    out = out.withColumn("_a", text.assess_value(F.col("value"), F.col("kind")))
    out = out.withColumn("confidence", F.round("_a.confidence", 2)).withColumn("reason", F.col("_a.reason")).drop("_a").withColumn("source", F.when(F.col("value") != "", "matched").otherwise("not-found"))
    return out.withColumn("strict", (F.col("value") != "") & (F.col("confidence") >= strict))
