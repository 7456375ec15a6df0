"""Operators on text lines in reading order: windows, sections, next values, longest prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formweave.functions import text


def explode_lines(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    return docs.select(key, F.posexplode(F.split(column, "\n", -1)).alias("line_no", "line"))


def context_window(lines: DataFrame, k: int = 2, key: str = "doc_id") -> DataFrame:
    """Adds `context`: the lines from k before to k after, joined by blanks."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(-k, k)
    return lines.withColumn("context", F.array_join(F.collect_list("line").over(w), " "))


def next_value(lines: DataFrame, reach: int = 4, key: str = "doc_id", label: Column | None = None) -> DataFrame:
    """Adds `value`: the first of the next lines that is informative, no numbered item, no label and without a colon.

    `label`: whether a line is the caption of a field.
    """
    w = Window.partitionBy(key).orderBy("line_no")
    line = text.clean_value(F.col("line"))
    ok = text.informative(line) & ~line.rlike(r"^\d+[.)]\s") & ~line.contains(":")
    if label is not None:
        ok = ok & ~F.coalesce(label, F.lit(False))
    marked = lines.withColumn("_ok", F.when(ok, line))
    ahead = F.coalesce(*(F.lead("_ok", i).over(w) for i in range(1, reach + 1)), F.lit(""))
    return marked.withColumn("value", ahead).drop("_ok")


def ticked_ahead(lines: DataFrame, reach: int = 2, key: str = "doc_id") -> DataFrame:
    """key, line_no, ahead: for each line with a ticked box, that line and the next ones, joined by blanks."""
    w = Window.partitionBy(key).orderBy("line_no")
    near = F.concat_ws(" ", "line", *(F.lead("line", i).over(w) for i in range(1, reach + 1)))
    return lines.withColumn("ahead", near).where(F.col("line").rlike(r"[☑☒✓✔]|\[" + text.MARK + r"\]")).select(key, "line_no", "ahead")


def section_ranges(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Numbered sections with first line and the line before the next header; of equal numbers the last one counts."""
    header = F.regexp_extract("line", r"^\s*#?\s*(\d{1,2})[.)\- ]", 1)
    heads = lines.withColumn("_s", header).where("_s <> ''")
    w = Window.partitionBy(key).orderBy("line_no")
    last = lines.groupBy(key).agg(F.max("line_no").alias("_last"))
    ranged = heads.withColumn("_next", F.lead("line_no").over(w)).join(last, key)
    out = ranged.select(key, F.col("_s").cast("int").alias("section"), F.col("line_no").alias("first_line"), F.coalesce(F.col("_next") - 1, F.col("_last")).alias("last_line"))
    return out.groupBy(key, "section").agg(F.max_by(F.struct("first_line", "last_line"), "first_line").alias("r")).select(key, "section", "r.first_line", "r.last_line")


def longest_prefix(lines: DataFrame, dictionary: DataFrame, most: int = 6, key: str = "doc_id") -> DataFrame:
    """Lines whose first words, up to `most`, are an alias: keyword of the longest such prefix, and the rest."""
    words = F.filter(F.split(text.clean_value(F.col("line")), " "), lambda w: w != "")
    tried = lines.withColumn("_w", words).where(F.size("_w") > 0).withColumn("n_words", F.explode(F.sequence(F.lit(1), F.least(F.size("_w"), F.lit(most)))))
    tried = tried.withColumn("_p", text.normalize_label(F.array_join(F.slice("_w", 1, F.col("n_words")), " ")))
    first = dictionary.groupBy(F.col("alias_norm").alias("_a")).agg(F.min_by("keyword", "ord").alias("keyword"))
    hits = tried.join(first, F.col("_p") == F.col("_a"))
    rest = F.array_join(F.slice("_w", F.col("n_words") + 1, F.greatest(F.size("_w") - F.col("n_words"), F.lit(0))), " ")
    best = hits.withColumn("_r", rest).groupBy(key, "line_no").agg(F.max_by(F.struct("keyword", "n_words", F.col("_r").alias("rest")), "n_words").alias("b"))
    return best.select(key, "line_no", "b.keyword", "b.n_words", "b.rest")


def all_lines(*sources: DataFrame) -> DataFrame:
    """The lines of all sources with `origin`, their source's place; repeated lines stay."""
    out = None
    for i, s in enumerate(sources):
        s = s.withColumn("origin", F.lit(i))
        out = s if out is None else out.unionByName(s)
    return out
