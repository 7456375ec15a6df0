"""A field dictionary from blank forms: captions on lines, tables' schemas, names without clashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formweave.functions import text


def label_of(segment: Column) -> Column:
    """The caption a segment announces: before a colon, before leaders, or before a wide blank and a value; else empty."""
    colon = F.regexp_extract(segment, r"^([^:]{2,}?)\s*:", 1)
    leader = F.regexp_extract(segment, r"^(.{2,}?)\s*(?:\.{3,}|_{3,})", 1)
    tail = F.regexp_extract(segment, r"^(\S.*?)\s{3,}(.+)$", 2)
    wide = F.when((tail != "") & text.value_like(tail), F.regexp_extract(segment, r"^(\S.*?)\s{3,}(.+)$", 1)).otherwise("")
    found = text.strip_edges(F.when(colon != "", colon).when(leader != "", leader).otherwise(wide))
    return F.when((F.length(found) >= 2) & (text.word_count(found) <= 8), found).otherwise("")


def label_fields(lines: DataFrame, key: str = "doc_id", back: int = 3) -> DataFrame:
    """key, line_no, label, context: captions; a repeated one takes the nearest of the lines before it that has 8 characters and another caption."""
    w = Window.partitionBy(key).orderBy("line_no")
    held = lines.withColumn("label", label_of(F.col("line"))).withColumn("_clean", text.clean_value(F.col("line")))
    above = [F.when((F.length(F.lag("_clean", i).over(w)) >= 8) & (F.lag("label", i).over(w) != F.col("label")), F.lag("_clean", i).over(w)) for i in range(1, back + 1)]
    named = held.withColumn("_above", F.coalesce(*above, F.lit(""))).where("label <> ''")
    again = F.count("*").over(Window.partitionBy(key, "label")) > 1
    return named.withColumn("context", F.when(again, F.col("_above")).otherwise("")).select(key, "line_no", "label", "context")


def unique_names(labels: DataFrame, label: str, name: str, order: str, group: list[str] | None = None) -> DataFrame:
    """Distinct labels with `field`: the name, from its second label on with the suffix 2, 3 and so on, in order of appearance."""
    by = group or []
    first = labels.groupBy(*by, name, label).agg(F.min(order).alias("_o"))
    n = F.row_number().over(Window.partitionBy(*by, name).orderBy("_o", label))
    return first.withColumn("_n", n).withColumn("field", F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(name, F.col("_n").cast("string")))).select(*by, label, "field")


def column_aliases(parts: Column) -> Column:
    """Header parts and their slash splits: trimmed, two characters or more, no values, distinct without regard to case, in order."""
    split = F.flatten(F.transform(parts, lambda p: F.split(p, "/")))
    clean = F.transform(F.concat(parts, split), lambda p: F.btrim(text.clean_value(p), F.lit(" /*")))
    kept = F.filter(clean, lambda p: (F.length(p) >= 2) & ~text.value_like(p))
    return F.filter(kept, lambda p, i: F.array_position(F.transform(kept, F.upper), F.upper(p)) == i + 1)


def table_schemas(cells: DataFrame, table: list[str], least_columns: int = 2, least_rows: int = 1) -> DataFrame:
    """table, columns, n_rows, accepted: captions of the header columns in order; `cells` carry is_header."""
    label = F.when(F.col("is_header") & ~text.value_like(F.col("text")), F.struct("col_no", "row_no", "text"))
    held = cells.groupBy(*table).agg(F.array_sort(F.collect_list(label)).alias("_h"), F.count_distinct(F.when(~F.col("is_header") & (F.col("text") != ""), F.col("row_no"))).cast("int").alias("n_rows"))
    columns = F.transform("_h", lambda x: text.camel_name(x["text"]))
    return held.select(*table, columns.alias("columns"), "n_rows").withColumn("accepted", (F.size("columns") >= least_columns) & (F.col("n_rows") >= least_rows))


def fields_of_rejected(cells: DataFrame, table: list[str]) -> DataFrame:
    """table, row_no, label of rows that hold one cell with a colon, or a caption and then a value."""
    rows = cells.where("trim(text) <> ''").groupBy(*table, "row_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "text"))), lambda x: x["text"]).alias("_t"))
    first, second = F.get("_t", F.lit(0)), F.get("_t", F.lit(1))
    label = F.when((F.size("_t") == 1) & first.contains(":"), text.before_colon(first)).when((F.size("_t") == 2) & ~text.value_like(first) & text.value_like(second), first)
    return rows.select(*table, "row_no", text.strip_edges(label).alias("label")).where("label <> ''")
