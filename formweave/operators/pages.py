"""Whole pages: fields from text lines with contexts and continuations, and all pages of a document merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from formweave.functions import text
from formweave.operators import matching, readings, rules
from formweave.operators.compose import SELECTION_KINDS, SELECTION_TOKENS

PREFIX_WORDS, VALUE_LINES = 6, 4


def table_keywords(keywords: DataFrame, columns: DataFrame) -> DataFrame:
    """keyword: the declared keywords that are `table.column` of a declared table; `columns` has table_name and column."""
    return columns.select(F.concat_ws(".", "table_name", "column").alias("keyword")).distinct().join(keywords.select("keyword").distinct(), "keyword")


def _printed(rows: DataFrame, label: str, means: str, dictionary: DataFrame, into: str) -> DataFrame:
    """Adds whether a text that means a keyword (column `means`) or looks like a caption is furniture, and whether it is printed text."""
    met = matching.furniture(rows, label, dictionary).withColumn("furniture", F.col("furniture") | F.col(means).isNotNull())
    return met.withColumn(into, text.form_text(F.col(label), F.col("furniture"))).withColumnRenamed("furniture", f"{into}_furniture")


def line_fields(lines: DataFrame, dictionary: DataFrame, contextual: DataFrame, kinds: DataFrame, page: list[str], threshold: float = 0.82) -> DataFrame:
    """page, keyword, value: fields from the text lines of each page.

    A line's caption is what stands before its colon, else its longest first words that mean a keyword. The value
    is the rest of the line, or, if nothing or only printed text is left there, the lines below that nobody printed:
    up to four for text, one for other kinds. Selections accept a selection's word alone. Of a keyword that has
    a contextual alias the first value on the page counts, of others the last.

    The dictionary rides along and pages are read whole, after one exchange; a dictionary too large for that is joined.
    """
    listed = [matching._listed(dictionary, "alias_norm", "keyword", "ord"), matching._listed(contextual, "label_norm", "keyword", "ord", "context_norm"), matching._listed(kinds, "keyword", "kind")]
    if any(rows is None for rows in listed):
        return joined_line_fields(lines, dictionary, contextual, kinds, page, threshold)
    plain, anchored, kind_of = ([tuple(r) for r in rows] for rows in listed)
    reader = readings.Reader(plain, anchored, dict(kind_of), threshold, tuple(SELECTION_KINDS), tuple(SELECTION_TOKENS), PREFIX_WORDS, VALUE_LINES)
    held = lines.select(*page, "line_no", F.col("line").cast("string").alias("line")).repartition(*page).sortWithinPartitions(*page, "line_no")
    schema = StructType([*(held.schema[c] for c in page), StructField("keyword", StringType()), StructField("value", StringType())])
    return held.mapInArrow(lambda batches: reader.pages(batches, len(page), page), schema)


def joined_line_fields(lines: DataFrame, dictionary: DataFrame, contextual: DataFrame, kinds: DataFrame, page: list[str], threshold: float = 0.82) -> DataFrame:
    """As `line_fields`, by joins with a dictionary of any size."""
    phrases = [r[0] for r in contextual.select("context_norm").distinct().orderBy("context_norm").collect()]
    packed = lines.select(F.struct(*page).alias("_p"), "line_no", text.clean_value(F.col("line")).alias("line"))
    held = rules.lookback(packed, phrases, key="_p").withColumn("context", F.coalesce("context", F.lit(""))).withColumn("whole", text.strip_edges(F.col("line")))
    words = F.filter(F.split("line", " "), lambda w: w != "")
    head = F.when(F.col("line").contains(":"), F.struct(F.lit(0).alias("o"), F.trim(text.before_colon(F.col("line"))).alias("label"), text.after_colon(F.col("line")).alias("rest")))
    firsts = F.transform(
        F.sequence(F.lit(1), F.least(F.size("_w"), F.lit(PREFIX_WORDS))),
        lambda n: F.struct((PREFIX_WORDS + 1 - n).alias("o"), F.array_join(F.slice("_w", 1, n), " ").alias("label"), F.array_join(F.slice("_w", n + 1, F.greatest(F.size("_w") - n, F.lit(0))), " ").alias("rest")),
    )
    # all texts of a line that may mean a keyword: captions to try, what stands behind each, and the whole line
    asked = lambda tag, o, label: F.struct(F.lit(tag).alias("tag"), o.alias("o"), label.alias("label"))
    held = held.withColumn("_w", words).withColumn("tries", F.when(F.size("_w") > 0, F.filter(F.concat(F.array(head), firsts), lambda t: t.isNotNull())).otherwise(F.array().cast("array<struct<o:int,label:string,rest:string>>")))
    texts = F.concat(F.array(asked("whole", F.lit(0), F.col("whole"))), F.transform("tries", lambda t: asked("label", t["o"], t["label"])), F.transform("tries", lambda t: asked("rest", t["o"], text.strip_edges(t["rest"]))))
    tried = held.select("_p", "line_no", "context", F.explode(texts).alias("t")).select("_p", "line_no", "context", "t.*")
    met = matching.match(tried, "label", "context", matching.lookup(tried, "label", dictionary, contextual, threshold)).where("keyword is not null")
    meant = lambda tag: F.when(F.col("tag") == tag, F.struct("o", "keyword"))
    by_line = met.groupBy("_p", "line_no").agg(F.min(meant("label")).alias("caption"), F.collect_list(meant("rest")).alias("rests"), F.min(meant("whole")).alias("means"))
    rows = held.join(by_line, ["_p", "line_no"], "left").withColumn("means", F.col("means.keyword"))
    rows = rows.withColumn("rest", text.strip_edges(F.get(F.filter("tries", lambda t: t["o"] == F.col("caption.o")), F.lit(0))["rest"]))
    rows = rows.withColumn("rest_means", F.get(F.filter("rests", lambda r: r["o"] == F.col("caption.o")), F.lit(0))["keyword"]).withColumn("keyword", F.col("caption.keyword"))
    rows = _printed(_printed(rows, "whole", "means", dictionary, "printed"), "rest", "rest_means", dictionary, "rest_printed")
    rows = rows.select("_p", "line_no", "keyword", "rest", "rest_printed", F.col("rest_printed_furniture").alias("rest_furniture"), F.col("whole").alias("line"), "printed")
    below = rules.continuation(rows, ~F.col("printed"), VALUE_LINES, "_p").withColumnRenamed("value", "many")
    chosen = rules.continuation(below, ~F.col("printed"), 1, "_p").withColumnRenamed("value", "one").where("keyword is not null")
    joined = chosen.join(matching.small(kinds), "keyword", "left").withColumn("kind", F.coalesce("kind", F.lit("text")))
    under = F.when(F.col("kind") == "text", F.col("many")).otherwise(F.col("one"))
    value = F.when((F.col("rest") == "") | F.col("rest_furniture"), under).when(F.col("rest_printed"), "").otherwise(F.col("rest"))
    got = joined.withColumn("value", value).where("value <> ''")
    got = got.where(~F.col("kind").isin(*SELECTION_KINDS) | F.upper(F.trim("value")).isin(*SELECTION_TOKENS))
    anchored = contextual.select(F.col("keyword").alias("_k")).distinct()
    got = got.join(matching.small(anchored), F.col("keyword") == F.col("_k"), "left")
    order = F.when(F.col("_k").isNotNull(), -F.col("line_no")).otherwise(F.col("line_no"))
    return got.groupBy("_p", "keyword").agg(F.max_by("value", order).alias("value")).select("_p.*", "keyword", "value")


def document_fields(page_fields: DataFrame, tables_only: DataFrame, key: str = "doc_id", page: str = "page_no") -> DataFrame:
    """key, keyword, value: of several pages the last one counts; keywords of table columns come from tables alone."""
    free = page_fields.join(matching.small(tables_only.select("keyword")), "keyword", "left_anti")
    return free.groupBy(key, "keyword").agg(F.max_by("value", page).alias("value"))


def unmatched(keywords: DataFrame, docs: DataFrame, fields: DataFrame, cells: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, missing: the declared keywords, in order, that neither a field nor a table cell of the document has; `keywords` has keyword and ord."""
    listed = [r["keyword"] for r in keywords.orderBy("ord").collect()]
    found = fields.select(key, "keyword").unionByName(cells.select(key, "keyword")).groupBy(key).agg(F.collect_set("keyword").alias("_f"))
    every = F.array(*map(F.lit, listed)) if listed else F.array().cast("array<string>")
    return docs.select(key).join(found, key, "left").select(key, F.array_except(every, F.coalesce("_f", F.array().cast("array<string>"))).alias("missing"))


def without_earlier(candidates: DataFrame, tables: DataFrame, key: str = "doc_id", page: str = "page_no") -> DataFrame:
    """Pages of `candidates` that have no geometric table themselves, and no HTML table on them or on an earlier page of the document.

    `tables` has key, page and source (`html` or `geometric`).
    """
    first = tables.where("source = 'html'").groupBy(F.col(key).alias("_k")).agg(F.min(page).alias("_first"))
    own = tables.where("source = 'geometric'").select(key, page).distinct()
    open_ = candidates.join(first, F.col(key) == F.col("_k"), "left").where(F.col("_first").isNull() | (F.col("_first") > F.col(page))).drop("_k", "_first")
    return open_.join(own, [key, page], "left_anti")
