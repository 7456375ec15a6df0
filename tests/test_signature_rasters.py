"""Rasters of signature pages on their way: short, and read as whole as raw ones."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from formweave.operators import ink
from formweave.plans import rasters
from formweave.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pages_move_deflated(spark, monkeypatch):
    moved, images = [], ink.signature_images
    monkeypatch.setattr(rasters.ink, "signature_images", lambda pages, *a, **k: moved.append(pages) or images(pages, *a, **k))
    QUERIES["signature_ink"](spark, SF)
    n, longest, whole = moved[0].agg(F.count("*"), F.max(F.octet_length("rgb")), F.max(3 * F.col("width") * F.col("height"))).head()
    assert n == spark.read.parquet(f"{SF}/labels.parquet").count() and whole == 156_000 and longest < 8_000


def test_deflated_pages_give_the_crops_of_raw_ones(spark):
    g = np.random.default_rng(3).integers(200, 256, (120, 160, 3), np.uint8)
    g[40:60, 40:44] = g[48:52, 40:100] = 0
    raw = g.tobytes()
    boxes = spark.createDataFrame([(d, 1, b, 5, 5 + 50 * b, 150, 60 + 50 * b) for d in range(9) for b in (0, 1)], "doc_id int, page_no int, box_id int, x0 int, y0 int, x1 int, y1 int")

    def cropped(rows, **options):
        pages = spark.createDataFrame(rows, "doc_id int, page_no int, width int, height int, rgb binary")
        got = ink.signature_images(pages, boxes, ["doc_id", "page_no"], **options).collect()
        return sorted((r["doc_id"], r["box_id"], r["mode"], r["n_ink"], bytes(r["png"])) for r in got)

    z = zlib.compress(raw, 1)
    plain = cropped([(0, 1, 160, 120, raw), (1, 1, 160, 120, raw[:-1]), (2, 1, 160, 120, None), (3, 1, None, 120, raw)])
    odd = [z[:-1], z + b"x", raw, b"", zlib.compress(raw + b"x"), zlib.compress(raw[:-1])]
    packed = cropped([(0, 1, 160, 120, z), (1, 1, 160, 120, None), (2, 1, None, 120, z), *((3 + i, 1, 160, 120, x) for i, x in enumerate(odd))], deflated=True)
    assert packed == plain and [x[:2] for x in plain] == [(0, 0), (0, 1)] and plain[0][3] > 0
