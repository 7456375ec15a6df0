"""OCR result payloads as JSON texts: lines, layout blocks, HTML tables, scores and quadrilaterals, one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formweave.functions import text

_POINTS = "array<array<double>>"


def _read(payloads: DataFrame, key: list[str], column: str) -> DataFrame:
    """key and variant v: the payload, or what stands under `res`; a text that is no JSON has none."""
    v = F.expr(f"coalesce(try_variant_get(try_parse_json({column}), '$.res', 'variant'), try_parse_json({column}))")
    return payloads.select(*key, v.alias("v"))


def _get(path: str, kind: str, v: str = "v") -> Column:
    return F.expr(f"try_variant_get({v}, '$.{path}', '{kind}')")


def _filled(name: str, kind: str) -> Column:
    """An array at the top level, or under `overall_ocr_res` where that is empty."""
    top = _get(name, kind)
    return F.when(F.size(top) > 0, top).otherwise(_get(f"overall_ocr_res.{name}", kind))


def ocr_lines(payloads: DataFrame, key: list[str], column: str = "payload") -> DataFrame:
    """key, line_no, line: recognised texts in order, blank ones left out; the numbers are those of all texts."""
    rows = _read(payloads, key, column).select(*key, F.posexplode(_filled("rec_texts", "array<string>")).alias("line_no", "line"))
    return rows.withColumn("line", text.normalize_lines(F.col("line"))).where("line <> ''")


def layout_blocks(payloads: DataFrame, key: list[str], column: str = "payload") -> DataFrame:
    """key, source, block_no, label, content: parsed blocks (source 0), then recognised tables (1); a table needs a `<table`."""
    read = _read(payloads, key, column)
    parsed = read.select(*key, F.lit(0).alias("source"), F.posexplode(_get("parsing_res_list", "array<variant>")).alias("block_no", "b"))
    label = F.coalesce(F.nullif(_get("label", "string", "b"), F.lit("")), F.lit("text"))
    parsed = parsed.select(*key, "source", "block_no", label.alias("label"), _get("content", "string", "b").alias("content"))
    found = read.select(*key, F.lit(1).alias("source"), F.posexplode(_get("table_res_list", "array<variant>")).alias("block_no", "b"))
    found = found.select(*key, "source", "block_no", F.lit("table").alias("label"), _get("pred_html", "string", "b").alias("content"))
    return parsed.unionByName(found).where((F.col("content") != "") & ((F.col("label") != "table") | F.col("content").contains("<table")))


def block_lines(blocks: DataFrame, key: list[str]) -> DataFrame:
    """key, source, block_no, line_no, line: the lines of all blocks but tables."""
    rows = blocks.where("label <> 'table'").select(*key, "source", "block_no", F.posexplode(F.split(text.normalize_lines(F.col("content")), "\n")).alias("line_no", "line"))
    return rows.where("line <> ''")


def html_tables(payloads: DataFrame, key: list[str], column: str = "payload") -> DataFrame:
    """key, table_no, html: recognised tables, then table blocks, each text once, the first place counts; numbers from 1."""
    tables = layout_blocks(payloads, key, column).where("label = 'table'")
    first = tables.groupBy(*key, F.col("content").alias("html")).agg(F.min(F.struct((1 - F.col("source")).alias("s"), "block_no")).alias("_o"))
    return first.withColumn("table_no", F.row_number().over(Window.partitionBy(*key).orderBy("_o"))).select(*key, "table_no", "html")


def scores(payloads: DataFrame, key: list[str], column: str = "payload") -> DataFrame:
    """key, cell_id, score: confidences that are numbers or read as such; others are left out one by one."""
    rows = _read(payloads, key, column).select(*key, F.posexplode(_filled("rec_scores", "array<variant>")).alias("cell_id", "s"))
    return rows.select(*key, "cell_id", F.expr("try_cast(try_variant_get(s, '$', 'string') as double)").alias("score")).where("score is not null")


def confidence_text(scored: DataFrame, pages: DataFrame, key: list[str]) -> DataFrame:
    """key, summary: average, least, greatest and number of a page's scores, or that there are none."""
    agg = scored.groupBy(*key).agg(F.avg("score").alias("a"), F.min("score").alias("b"), F.max("score").alias("c"), F.count("*").alias("n"))
    said = F.format_string("Confidence score: avg=%.4f, min=%.4f, max=%.4f, n=%d", "a", "b", "c", "n")
    return pages.select(*key).distinct().join(agg, key, "left").select(*key, F.when(F.col("n") > 0, said).otherwise("Confidence score: unavailable").alias("summary"))


def quad(flat: Column, points: Column) -> Column:
    """Four corners as [x, y]: of eight numbers, of a box of four, or of points, four as they are and fewer by their extent; zeros else."""
    at = lambda i: F.get(flat, F.lit(i))
    box = lambda x0, y0, x1, y1: F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1))
    xs, ys = (F.transform(points, lambda p, i=i: F.get(p, F.lit(i))) for i in (0, 1))
    zero = F.lit(0.0)
    return (
        F.when(F.size(flat) == 8, F.array(*(F.array(at(2 * i), at(2 * i + 1)) for i in range(4))))
        .when(F.size(flat) == 4, box(at(0), at(1), at(2), at(3)))
        .when(F.size(points) >= 4, F.transform(F.slice(points, 1, 4), lambda p: F.slice(p, 1, 2)))
        .when(F.size(points) > 0, box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))
        .otherwise(box(zero, zero, zero, zero))
    )


def rectangle(corners: Column) -> Column:
    """The extent of four corners as x0, y0, x1, y1."""
    side = lambda f, i: f(F.transform(corners, lambda p: F.get(p, F.lit(i))))
    return F.struct(side(F.array_min, 0).alias("x0"), side(F.array_min, 1).alias("y0"), side(F.array_max, 0).alias("x1"), side(F.array_max, 1).alias("y1"))


def blocks(payloads: DataFrame, key: list[str], column: str = "payload") -> DataFrame:
    """key, block_no, text, score, quad of recognised texts; an absent score is 0, a polygon goes before a box.

    A payload in the older shape, a list of `[quad, [text, score]]`, is read as it is.
    """
    v = _read(payloads, key, column)
    old = v.select(*key, F.posexplode(F.expr("try_variant_get(v, '$[0]', 'array<variant>')")).alias("block_no", "b"))
    corners = F.expr(f"try_variant_get(b, '$[0]', '{_POINTS}')")
    old = old.select(*key, "block_no", F.expr("try_variant_get(b, '$[1][0]', 'string')").alias("text"), F.expr("try_variant_get(b, '$[1][1]', 'double')").alias("score"), corners.alias("quad"))
    new = v.select(*key, F.posexplode(_get("rec_texts", "array<string>")).alias("block_no", "text"), *(_get(f"rec_{n}", "array<variant>").alias(n) for n in ("scores", "polys", "boxes")))
    new = new.select(*key, "block_no", "text", F.get("scores", "block_no").alias("s"), F.coalesce(F.get("polys", "block_no"), F.get("boxes", "block_no")).alias("p"))
    flat, points = F.expr("try_variant_get(p, '$', 'array<double>')"), F.expr(f"try_variant_get(p, '$', '{_POINTS}')")
    score = F.coalesce(F.expr("try_cast(try_variant_get(s, '$', 'string') as double)"), F.lit(0.0))
    return new.select(*key, "block_no", "text", score.alias("score"), quad(flat, points).alias("quad")).unionByName(old.where("text is not null"))
