"""Field dictionaries, OCR payloads and template files as DataFrames."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formweave.functions import text
from formweave.operators.images import Box


def from_rows(spark: SparkSession, rows: list[tuple[str, list[str], str]]) -> tuple[DataFrame, DataFrame]:
    """Aliases (keyword, alias_norm, ord) and kinds (keyword, kind); a keyword's own name is its first alias."""
    aliases = [(k, a, i * 1000 + j) for i, (k, names, _) in enumerate(rows) for j, a in enumerate([k, *names])]
    table = spark.createDataFrame(aliases, "keyword string, alias string, ord int")
    table = table.select("keyword", text.normalize_label(F.col("alias")).alias("alias_norm"), "ord").where("alias_norm <> ''")
    return table, spark.createDataFrame([(k, kind) for k, _, kind in rows], "keyword string, kind string")


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, float]:
    """Plain aliases, contextual aliases (keyword, label_norm, context_norm, ord) and the threshold of a dictionary file.

    Raises ValueError if keywords are missing or the threshold is not within 0 and 1.
    """
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    head = raw.select(F.expr("try_variant_get(v, '$.keywords', 'array<string>')").alias("k"), F.coalesce(F.expr("try_variant_get(v, '$.fuzzy_threshold', 'double')"), F.lit(0.82)).alias("t")).head()
    keywords = [k.strip() for k in head["k"] or [] if k and k.strip()]
    if not keywords:
        raise ValueError("keywords must be a non-empty list")
    if not 0 <= head["t"] <= 1:
        raise ValueError("fuzzy_threshold must be within 0 and 1")
    listed = spark.createDataFrame([(k, i * 1000) for i, k in enumerate(keywords)], "keyword string, base int")
    alias = raw.select(F.explode(F.expr("try_variant_get(v, '$.aliases', 'map<string,array<variant>>')")).alias("keyword", "items")).select("keyword", F.posexplode("items").alias("pos", "item"))
    alias = alias.join(listed, "keyword").withColumn("ord", F.col("base") + F.col("pos") + 1)
    label = F.coalesce(F.expr("try_variant_get(item, '$.label', 'string')"), F.expr("try_variant_get(item, '$', 'string')"))
    context = F.coalesce(F.expr("try_variant_get(item, '$.context', 'array<string>')"), F.array(F.expr("try_variant_get(item, '$.context', 'string')")))
    alias = alias.select("keyword", "ord", label.alias("label"), F.filter(context, lambda c: c.isNotNull()).alias("context"))
    own = listed.select("keyword", F.col("base").alias("ord"), F.col("keyword").alias("label"))
    plain = own.unionByName(alias.where(F.size("context") == 0).drop("context")).select("keyword", text.normalize_label(F.col("label")).alias("alias_norm"), "ord").where("alias_norm <> ''")
    ctx = alias.select("keyword", text.normalize_label(F.col("label")).alias("label_norm"), F.explode("context").alias("c"), "ord").select("keyword", "label_norm", text.normalize_label(F.col("c")).alias("context_norm"), "ord")
    return plain, ctx, float(head["t"])


def read_template(spark: SparkSession, path: str, size: float = 0.026) -> list[Box]:
    """Boxes of a template file, `{"templates": ...}` or the bare map of pages; an unreadable file has none."""
    text_ = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    try:
        read = json.loads(text_)
    except ValueError:
        return []
    pages = read.get("templates", read) if isinstance(read, dict) else {}
    out: list[Box] = []
    for page, fields in pages.items():
        number = page.removeprefix("page")
        if not number.isdigit() or not isinstance(fields, dict):
            continue
        for keyword, spec in fields.items():
            kind = spec.get("type")
            answers = {
                "single": [(spec.get("value", "YES"), spec.get("coord"))],
                "yesno": [("YES", spec.get("yes")), ("NO", spec.get("no"))],
                "option": [(o.get("label", ""), o.get("coord")) for o in spec.get("options", [])],
            }.get(kind, [])
            out += [Box(int(number), keyword, kind, i, answer, float(at[0]), float(at[1]), float(spec.get("box_size", size))) for i, (answer, at) in enumerate(answers) if at]
    return out


def ocr_cells(payloads: DataFrame, key: str = "doc_id", column: str = "payload") -> DataFrame:
    """Cells of OCR results: parallel arrays zipped, blank texts dropped, boxes from polygons where boxes lack.

    A payload that is no JSON has no cells; one without geometry gets a line per text. Without texts at
    the top level those under `overall_ocr_res` are read, with its geometry where the top level has none.
    """
    v = F.expr(f"coalesce(try_variant_get(try_parse_json({column}), '$.res', 'variant'), try_parse_json({column}))")
    kinds = {"texts": "array<string>", "scores": "array<double>", "boxes": "array<array<double>>", "polys": "array<array<array<double>>>"}
    filled = lambda path, kind: F.expr(f"try_variant_get(v, '$.{path}', '{kind}')")
    both = payloads.select(key, v.alias("v")).select(
        key,
        *(F.when(F.size(filled(f"rec_{n}", k)) > 0, filled(f"rec_{n}", k)).alias(n) for n, k in kinds.items()),
        *(filled(f"overall_ocr_res.rec_{n}", k).alias(f"under_{n}") for n, k in kinds.items()),
    )
    fall = F.col("texts").isNull()
    got = both.select(key, *(F.when(fall, F.coalesce(n, f"under_{n}")).otherwise(F.col(n)).alias(n[0]) for n in kinds))
    cells = got.select(key, F.posexplode("t").alias("cell_id", "text"), "s", "b", "p").where(text.clean_value(F.col("text")) != "")
    poly = F.get("p", F.col("cell_id"))
    box = F.get("b", F.col("cell_id"))
    side = lambda i, f: F.coalesce(F.get(box, F.lit(i + (2 if f is F.array_max else 0))), f(F.transform(poly, lambda q: F.get(q, F.lit(i)))))
    return cells.select(
        key, "cell_id", text.clean_value(F.col("text")).alias("text"),
        F.coalesce(side(0, F.array_min), F.lit(0.0)).alias("x0"), F.coalesce(side(1, F.array_min), F.col("cell_id") * 10.0).alias("y0"),
        F.coalesce(side(0, F.array_max), F.length("text").cast("double")).alias("x1"), F.coalesce(side(1, F.array_max), F.col("cell_id") * 10.0 + 1).alias("y1"),
        F.get("s", F.col("cell_id")).alias("conf"),
    )
