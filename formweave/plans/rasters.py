"""Registered queries of page rasters drawn from labels."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formweave.operators import images, ink
from formweave.plans.registry import query
from formweave.session import table

SIDE = 400
#: Pages drawn at once.
DRAWN = 64


def _pages(said: DataFrame, draw: Callable[[int, int, int], tuple], schema: str) -> DataFrame:
    """Pages drawn from doc_id, quality and toxic, a few at a time: labels are few bytes, their pages are not.

    So labels are dealt to tasks first, and no batch of labels becomes one frame of rasters.
    """
    columns = [c.split()[0] for c in schema.split(", ")]

    def rows(batches):
        for b in batches:
            for i in range(0, len(b), DRAWN):
                part = b.iloc[i : i + DRAWN]
                yield pd.DataFrame([draw(*x) for x in zip(part["doc_id"], part["quality"], part["toxic"], strict=True)], columns=columns)

    tasks = int(said.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return said.select("doc_id", "quality", "toxic").repartition(tasks, "doc_id").mapInPandas(rows, schema)


def _draw(ticks: tuple[int, int]) -> np.ndarray:
    """Two pale boxes, ticked or not, a comb of four, a filled square, and a page of white."""
    g = np.full((SIDE, SIDE), 255, np.uint8)

    def box(x: int, y: int) -> None:
        g[y - 7 : y + 7, [x - 7, x + 6]] = 150
        g[[y - 7, y + 6], x - 7 : x + 7] = 150

    for on, (x, y) in zip(ticks, ((60, 80), (300, 200)), strict=True):
        box(x, y)
        if on == 1:
            g[np.arange(y - 4, y + 4), np.arange(x - 4, x + 4)] = 0
            g[np.arange(y - 4, y + 4), np.arange(x - 3, x + 5)] = 0
    for i in range(4):
        box(100 + 18 * i, 300)
        g[298:302, 98 + 18 * i : 102 + 18 * i] = 0
    g[340:354, 40:54] = 0
    return g


@query("select doc_id, unnest([60, 300, 47])::double as cx, unnest([80, 200, 347])::double as cy, unnest([quality = 1, toxic = 1, false]) as ticked from labels")
def page_box_ticks(spark, sf):
    """All boxes of a page with their ticks; characters in combs are none, and a filled square is a box without a tick."""

    def draw(d: int, q: int, t: int) -> tuple:
        return d, 1, SIDE, SIDE, _draw((q, t)).tobytes(), 0.0

    pages = _pages(table(spark, sf, "labels"), draw, "doc_id bigint, page_no int, width int, height int, gray binary, text_height double")
    return images.boxes_of_pages(pages).select("doc_id", "cx", "cy", "ticked")


@query(
    """select doc_id, 1 as page_no, unnest([0, 1]) as box_id, 'preserve' as mode, unnest([quality = 1, toxic = 1]) as inked, true as is_png, (quality = 1)::int + (toxic = 1)::int as n_signed
    from labels"""
)
def signature_ink(spark, sf):
    """Two boxes a page, each with a rule below, one for a blue and one for a black stroke; the rule is no ink. Scores are equal, so the first mode counts."""

    def draw(d: int, q: int, t: int) -> tuple:
        g = np.full((200, 260, 3), 255, np.uint8)
        for on, top, pen in ((q, 10, (20, 20, 120)), (t, 110, (0, 0, 0))):
            g[top + 62 : top + 64] = 0
            x = np.arange(50, 180) if on == 1 else np.arange(0)
            y = np.rint(top + 30 + 12 * np.sin(x / 6.0)).astype(int)
            for step in range(-2, 3):
                g[y + step, x] = pen
        return d, 1, 260, 200, zlib.compress(g.tobytes(), 1)

    said = table(spark, sf, "labels")
    pages = _pages(said, draw, "doc_id bigint, page_no int, width int, height int, rgb binary")
    boxes = said.select("doc_id", F.lit(1).alias("page_no"), F.expr("inline(array(struct(0 as box_id, 5 as x0, 5 as y0, 255 as x1, 80 as y1), struct(1 as box_id, 5 as x0, 105 as y0, 255 as x1, 180 as y1)))"))
    got = ink.signature_images(pages, boxes, ["doc_id", "page_no"], deflated=True)
    inked = F.col("n_ink") > 0
    made = got.select("doc_id", "page_no", "box_id", "mode", inked.alias("inked"), (F.hex(F.substring("png", 1, 8)) == "89504E470D0A1A0A").alias("is_png"))
    # a window and no join, which would clean every crop twice
    return made.withColumn("n_signed", F.count_if("inked").over(Window.partitionBy("doc_id")).cast("int"))
