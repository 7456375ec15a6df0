"""Signature boxes: filters, signers, titles and file names. Boxes come from a detector outside this library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formweave.functions import text
from formweave.operators import geometry

# The window around a box in which a signer's name stands, in pixels.
ABOVE, BELOW, ASIDE = 30, 250, 400


def large_enough(boxes: DataFrame, least: float = 0.005) -> DataFrame:
    """Boxes that cover at least that share of their page."""
    share = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("page_width") * F.col("page_height"))
    return boxes.where(share >= least)


def not_printed(boxes: DataFrame, blocks: DataFrame, page: list[str], overlap: float = 0.2, score: float = 0.95) -> DataFrame:
    """Boxes that no confident text block of three letters or digits overlaps."""
    sure = blocks.where((F.col("score") >= score) & (F.length(text.normalize_label(F.col("text"))) >= 3))
    t = sure.select(*page, *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    box = tuple(F.col(c) for c in ("x0", "y0", "x1", "y1"))
    on = geometry.iou(box, tuple(F.col(f"_{c}") for c in ("x0", "y0", "x1", "y1"))) >= overlap
    hit = boxes.join(t, page).where(on).select(*page, "box_id").distinct()
    return boxes.join(hit, [*page, "box_id"], "left_anti")


#: What stands before a signer's name, and what no name holds.
ANCHOR = r"(?i)(?:Name|By|Printed Name|Signer)[:\s]*([A-Za-z\s]{3,30})"
NO_NAMES = ("date", "title", "signed", "page")


def _slug(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit(" "), F.lit("_")), "[^a-zA-Z0-9_]", "")


def signers(boxes: DataFrame, blocks: DataFrame, page: list[str], person=None) -> DataFrame:
    """page, box_id, signer, by the texts in the box's window from the nearest on: a person's name, a name behind an anchor, a text that is no caption.

    Distances run from the middle of the box's lower edge to the middle of the text's upper edge. `person` is a
    function of a text column that gives the name of a person in it or null; without one that step is left out.
    """
    t = blocks.select(*page, F.col("text").alias("_t"), ((F.col("x0") + F.col("x1")) / 2).alias("_cx"), F.col("y0").alias("_top"))
    cx = (F.col("x0") + F.col("x1")) / 2
    near = boxes.join(t, page).where((F.col("_top") >= F.col("y0") - ABOVE) & (F.col("_top") <= F.col("y1") + BELOW) & (F.abs(F.col("_cx") - cx) < ASIDE))
    anchored, plain = F.regexp_extract("_t", ANCHOR, 1), _slug(F.col("_t"))
    is_name = F.length(plain) > 2
    for word in NO_NAMES:
        is_name = is_name & ~F.lower(plain).contains(word)
    steps = [(F.lit(0), _slug(person(F.col("_t"))))] if person else []
    steps += [(F.lit(1), F.when(anchored != "", _slug(F.trim(anchored)))), (F.lit(2), F.when(is_name, plain))]
    found = F.filter(F.array(*(F.struct(k.alias("k"), v.alias("v")) for k, v in steps)), lambda x: x["v"].isNotNull())
    far = F.hypot(F.col("_cx") - cx, F.col("_top") - F.col("y1"))
    best = near.select(*page, "box_id", far.alias("_d"), "_t", F.explode(found).alias("_f"))
    best = best.groupBy(*page, "box_id").agg(F.min_by("_f.v", F.struct("_f.k", "_d", "_t")).alias("signer"))
    return boxes.select(*page, "box_id").join(best, [*page, "box_id"], "left").withColumn("signer", F.coalesce("signer", F.lit("Unknown_Signer")))


def titles(blocks: DataFrame, page: list[str], fallback: str = "Untitled") -> DataFrame:
    """page, title: of the three topmost texts the first of five characters that is not all digits, as a slug of 25 characters."""
    top = blocks.withColumn("_r", F.row_number().over(Window.partitionBy(*page).orderBy("y0", "text"))).where("_r <= 3")
    fits = (F.length("text") > 4) & ~F.col("text").rlike(r"^\d+$")
    slug = F.substring(F.regexp_replace(F.regexp_replace("text", " ", "_"), r"[^A-Za-z0-9_]", ""), 1, 25)
    best = top.groupBy(*page).agg(F.min_by(F.when(fits, slug), F.when(fits, F.col("_r"))).alias("title"))
    return best.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), F.lit(fallback)))


def file_names(signed: DataFrame, page: list[str]) -> DataFrame:
    """Adds `file_name` from title, page (the last column of `page`), signer and the box's number on its page, in the detector's order."""
    n = F.row_number().over(Window.partitionBy(*page).orderBy("box_id")).cast("string")
    return signed.withColumn("file_name", F.concat(F.concat_ws("_", "title", F.concat(F.lit("p"), F.col(page[-1]).cast("string")), "signer", F.concat(F.lit("sig"), n)), F.lit(".png")))
