"""Results as JSON, Markdown and HTML texts, one row per document; writing them is `df.write`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHOWN = 0.7


def escape_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def escape_pipe(c: Column) -> Column:
    return F.replace(c, F.lit("|"), F.lit("\\|"))


def _listed(values: DataFrame, key: str, *columns: str) -> DataFrame:
    return values.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("keyword", *columns))).alias("f"))


def field_json(values: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, payload: every keyword with its value, by keyword; nothing but JSON's own characters is escaped."""
    return _listed(values, key, "value").select(key, F.to_json(F.map_from_arrays(F.transform("f", lambda x: x["keyword"]), F.transform("f", lambda x: x["value"]))).alias("payload"))


def content_markdown(docs: DataFrame, values: DataFrame, content: str, key: str = "doc_id") -> DataFrame:
    """key, body: the content, then a list of fields in which empty ones are NOT FOUND."""
    line = lambda x: F.concat(F.lit("- "), x["keyword"], F.lit(": "), F.when(F.trim(x["value"]) == "", "NOT FOUND").otherwise(x["value"]))
    listed = _listed(values, key, "value").select(key, F.array_join(F.transform("f", line), "\n").alias("_f"))
    return docs.join(listed, key, "left").select(key, F.concat_ws("\n\n", F.col(content), "_f").alias("body"))


def field_markdown(scored: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, body: fields, details from a confidence of 0.7 on, unmatched keywords; a sentence if there is nothing."""
    some = F.filter("f", lambda x: x["value"] != "")
    fields = F.array_join(F.transform(some, lambda x: F.concat(F.lit("- **"), x["keyword"], F.lit("**: "), escape_pipe(x["value"]))), "\n")
    sure = F.filter(some, lambda x: x["confidence"] >= SHOWN)
    details = F.array_join(F.transform(sure, lambda x: F.concat(F.lit("| "), x["keyword"], F.lit(" | "), escape_pipe(x["value"]), F.lit(" | "), F.format_string("%.2f", x["confidence"]), F.lit(" |"))), "\n")
    missing = F.array_join(F.transform(F.filter("f", lambda x: x["value"] == ""), lambda x: x["keyword"]), ", ")
    body = F.concat(
        F.lit("## Fields\n"), F.when(F.size(some) == 0, "No field was found.").otherwise(fields),
        F.when(F.size(sure) > 0, F.concat(F.lit("\n## Details\n| Field | Value | Confidence |\n| --- | --- | --- |\n"), details)).otherwise(""),
        F.when(missing != "", F.concat(F.lit("\n## Unmatched\n"), missing)).otherwise(""),
    )
    return _listed(scored, key, "value", "confidence").select(key, body.alias("body"))


def field_html(scored: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, body: the found fields as rows of an HTML table."""
    row = lambda x: F.concat(F.lit("<tr><th>"), escape_html(x["keyword"]), F.lit("</th><td>"), escape_html(x["value"]), F.lit("</td></tr>"))
    some = F.transform(F.filter("f", lambda x: x["value"] != ""), row)
    return _listed(scored, key, "value").select(key, F.concat(F.lit("<table>"), F.array_join(some, ""), F.lit("</table>")).alias("body"))


def table_markdown(cells: DataFrame, table: list[str]) -> DataFrame:
    """table, body: the dense matrix as a Markdown table; its first row is the header, absent cells are empty."""
    wide = F.max("col_no").over(Window.partitionBy(*table))
    rows = cells.withColumn("_n", wide).groupBy(*table, "row_no", "_n").agg(F.map_from_entries(F.collect_list(F.struct("col_no", "text"))).alias("_c"))
    line = F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), F.col("_n")), lambda i: escape_pipe(F.replace(F.coalesce(F.try_element_at("_c", i), F.lit("")), F.lit("\n"), F.lit(" ")))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("_n") + 1))
    packed = rows.select(*table, "row_no", line.alias("_l"), rule.alias("_r")).groupBy(*table).agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "_l"))), lambda x: x["_l"]).alias("_ls"), F.first("_r").alias("_r"))
    return packed.select(*table, F.array_join(F.concat(F.slice("_ls", 1, 1), F.array("_r"), F.slice("_ls", 2, 1 << 30)), "\n").alias("body"))


def dictionary_json(aliases: DataFrame, kinds: DataFrame, threshold: float = 0.9) -> DataFrame:
    """One row: the field dictionary as JSON. A dictionary is configuration, not data."""
    names = aliases.groupBy("keyword").agg(F.min("ord").alias("o"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "alias_norm"))), lambda x: x["alias_norm"]).alias("a"))
    held = names.join(kinds, "keyword", "left").groupBy().agg(F.array_sort(F.collect_list(F.struct("o", "keyword", "a", F.coalesce("kind", F.lit("text")).alias("kind")))).alias("f"))
    keys = F.transform("f", lambda x: x["keyword"])
    return held.select(F.to_json(F.struct(keys.alias("keywords"), F.map_from_arrays(keys, F.transform("f", lambda x: x["kind"])).alias("field_types"), F.map_from_arrays(keys, F.transform("f", lambda x: x["a"])).alias("aliases"), F.lit(threshold).alias("fuzzy_threshold"))).alias("payload"))


def result_json(scored: DataFrame, tables: DataFrame, keywords: list[str], strict: float = 0.8, key: str = "doc_id") -> DataFrame:
    """key, payload: the whole result of each document, by keyword in the declared order.

    `scored` has keyword, value, confidence, reason, source; `tables` has table_name, columns and rows (maps) of each table.
    """
    place = F.array_position(F.array(*map(F.lit, keywords)), F.col("keyword")).cast("int")
    held = scored.withColumn("_o", place).where("_o > 0").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_o", "keyword", "value", "confidence", "reason", "source"))).alias("f"))
    grids = tables.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("table_name", "columns", "rows"))).alias("t"))
    as_map = lambda a, k, v: F.map_from_arrays(F.transform(a, k), F.transform(a, v))
    name = lambda x: x["keyword"]
    sure = F.filter("f", lambda x: (x["value"] != "") & (x["confidence"] >= strict))
    unsure = F.filter("f", lambda x: (x["value"] == "") | (x["confidence"] < strict))
    grid = F.coalesce("t", F.array().cast("array<struct<table_name:string,columns:array<string>,rows:array<map<string,string>>>>"))
    body = F.struct(
        F.array(*map(F.lit, keywords)).alias("keywords"),
        as_map("f", name, lambda x: x["value"]).alias("fields"),
        as_map("f", name, lambda x: F.struct(x["value"].alias("value"), x["confidence"].alias("confidence"), x["reason"].alias("reason"), x["source"].alias("source"))).alias("fieldDetails"),
        F.lit(strict).alias("strictConfidenceThreshold"),
        as_map(sure, name, lambda x: x["value"]).alias("strictFields"),
        F.transform(unsure, name).alias("strictUnmatchedKeywords"),
        F.transform(F.filter("f", lambda x: x["value"] == ""), name).alias("unmatchedKeywords"),
        as_map(grid, lambda x: x["table_name"], lambda x: F.struct(x["columns"].alias("columns"), x["rows"].alias("rows"))).alias("tableData"),
    )
    return held.join(grids, key, "left").select(key, F.to_json(body).alias("payload"))


def record_markdown(records: DataFrame, columns: Column, table: list[str]) -> DataFrame:
    """table, body: a table's records as a Markdown table under its columns; absent values are empty."""
    joined = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    line = joined(F.transform(columns, lambda c: escape_pipe(F.coalesce(F.try_element_at("record", c), F.lit("")))))
    rows = records.select(*table, "row_no", line.alias("_l"), joined(columns).alias("_h"), joined(F.transform(columns, lambda c: F.lit("---"))).alias("_r"))
    packed = rows.groupBy(*table, "_h", "_r").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "_l"))), lambda x: x["_l"]).alias("_ls"))
    return packed.select(*table, F.array_join(F.concat(F.array("_h", "_r"), "_ls"), "\n").alias("body"))


def failure_report(title: Column, document: Column, seconds: Column, details: Column) -> Column:
    """The report of a document that could not be read, as Markdown."""
    return F.concat_ws("\n", title, F.lit(""), F.concat(F.lit("Input document: `"), document, F.lit("`")), F.concat(F.lit("Execution time: "), seconds.cast("string")), F.lit(""), details, F.lit(""))


def output_path(summary: Column, kind: str) -> Column:
    """Where the `readable`, `json` or `html` form of a summary goes: beside it, by its extension; Markdown if it has none."""
    ext = F.regexp_extract(summary, r"[^/.][^/]*?(\.[^./]*)$", 1)
    base = summary.substr(F.lit(1), F.length(summary) - F.length(ext))
    tail = F.concat(F.lit("_readable"), F.when(ext != "", ext).otherwise(".md")) if kind == "readable" else F.lit("." + kind)
    return F.concat(base, tail)
