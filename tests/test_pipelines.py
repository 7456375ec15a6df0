import os

import duckdb
import numpy as np
import pytest

from formweave.operators import compose, geometry, images, ink, layout
from formweave.plans.catalog import ORACLES, QUERIES
from formweave.sources import dictionary

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["promoted_values", "canonical_fields", "column_claims", "plausible_values", "form_schemas", "box_centers", "template_values", "geometric_tables", "page_box_ticks", "page_line_index", "cell_text_lines", "words_by_region", "box_answers", "blank_mark_fields", "dominant_clusters", "signature_ink"])
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in "customer orders lineitem labels".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = con.execute(ORACLES[name])
    order = [x[0] for x in got.description]
    assert sorted(order) == cols
    expected = sorted(tuple(str(r[order.index(c)]) for c in cols) for r in got.fetchall())
    assert sorted(tuple(map(str, r)) for r in df.select(*cols).collect()) == expected


VALUES = "doc_id bigint, keyword string, value string"


def read(df):
    return {r["keyword"]: r["value"] for r in df.collect()}


def test_only_selections_take_a_selection_word(spark):
    kinds = spark.createDataFrame([("a", "text"), ("b", "yesno"), ("c", "text")], "keyword string, kind string")
    cells = spark.createDataFrame([(1, 1, 1, "a", "Yes"), (1, 1, 2, "a", "later"), (1, 2, 1, "b", "No"), (1, 2, 1, "c", " "), (1, 1, 1, "d", "unknown")], "doc_id bigint, table_no int, row_no int, keyword string, value string")
    assert read(compose.promoted(cells, kinds)) == {"a": "later", "b": "No"}


def test_first_source_with_a_value_wins(spark):
    docs = spark.createDataFrame([(1,)], "doc_id bigint")
    keywords = spark.createDataFrame([("a",), ("b",), ("c",)], "keyword string")
    one, two = spark.createDataFrame([(1, "a", ""), (1, "b", "x")], VALUES), spark.createDataFrame([(1, "a", "y"), (1, "b", "z")], VALUES)
    got = compose.by_priority([("one", one), ("two", two)], docs, keywords)
    assert {r["keyword"]: (r["value"], r["source"]) for r in got.collect()} == {"a": ("y", "two"), "b": ("x", "one"), "c": ("", "not-found")}


def test_a_claim_fills_only_empty_fields_and_takes_the_text_from_others(spark):
    values = spark.createDataFrame([(1, "a", ""), (1, "b", "12 May"), (1, "c", "kept")], VALUES)
    claims = spark.createDataFrame([(1, "a", "12 May"), (1, "c", "other"), (1, "z", "nobody")], VALUES)
    assert read(compose.claim_columns(values, claims, ["a", "b", "c"])) == {"a": "12 May", "b": "", "c": "kept"}
    assert read(compose.claim_columns(values, claims.limit(0), ["a", "b", "c"])) == {"a": "", "b": "12 May", "c": "kept"}


def test_far_values_and_captions_are_cleared(spark):
    d = dictionary.from_rows(spark, [("name", ["Full Name"], "text"), ("city", [], "text"), ("day", [], "date")])[0]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(["Full Name: Ann", "City", "x", "y", "z", "Far Town", "Day", "1/2/2024"])], "doc_id bigint, line_no int, line string")
    values = spark.createDataFrame([(1, "name", "City"), (1, "city", "Far Town"), (1, "day", "1/2/2024")], VALUES)
    assert read(compose.plausible(values, lines, d)) == {"name": "", "city": "", "day": "1/2/2024"}
    assert read(compose.plausible(values, lines, d, ("name", "city"))) == {"name": "City", "city": "Far Town", "day": "1/2/2024"}


def test_layout_captions_count_only_without_pairs(spark):
    schema = "doc_id bigint, stage string, ord int, label string, context string"
    rows = [
        (1, "layout", 0, "Found by layout", ""), (1, "key_value", 1, "Date", "Applicant"), (1, "key_value", 2, "Date", ""), (1, "key_value", 3, "Date", ""),
        (2, "layout", 0, "Total Amount", ""), (2, "mark", 0, "I hold one card and no other card of any other bank.", ""), (2, "layout", 1, "one two three four five six seven eight", ""),
    ]
    columns = spark.createDataFrame([(2, "Items", 0, "Qty", "Quantity")], "doc_id bigint, table_name string, ord int, column string, label string")
    got = compose.form_schema(spark.createDataFrame(rows, schema), columns).orderBy("doc_id", "field_no").collect()
    assert [(r["doc_id"], r["field"], r["stage"]) for r in got] == [(1, "ApplicantDate", "key_value"), (1, "Date", "key_value"), (2, got[2]["field"], "mark"), (2, "TotalAmount", "layout"), (2, "Items.Qty", "table")]
    assert compose.form_schema(spark.createDataFrame([], schema), columns.limit(0)).count() == 0


def test_empty_page_has_no_table(spark):
    cells = spark.createDataFrame([], "page bigint, cell_id bigint, text string, x0 double, x1 double, y0 double, y1 double")
    assert layout.geometric_tables(cells, dictionary.from_rows(spark, [("a", ["Part Number"], "text")])[0]).count() == 0
    assert layout.geometric_tables(cells, dictionary.from_rows(spark, [("a", ["Part Number"], "text")])[0].limit(0)).count() == 0


def test_components():
    m = np.zeros((6, 6), bool)
    m[0, 0] = m[1, 1] = m[4, 4] = True
    m[4, 0:3] = True
    assert images.components(m).tolist() == [[0, 0, 2, 2], [0, 4, 3, 5], [4, 4, 5, 5]]
    assert len(images.components(m, False)) == 4
    assert images.box_centers(np.full((20, 20), 255, np.uint8)) == []
    # a shape that closes only in its last row is one area
    u = np.zeros((5, 5), bool)
    u[:, [0, 4]] = u[4] = True
    assert images.components(u).tolist() == [[0, 0, 5, 5]]


def test_templates(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"templates": {"page0": {"a": {"type": "single", "coord": [0.5, 0.5], "box_size": 0.4}, "b": {"type": "odd"}}, "page1": {"a": {"type": "option", "options": [{"label": "x"}, {"label": "y", "coord": [0.5, 0.5]}], "box_size": 0.4}}}}')
    boxes = dictionary.read_template(spark, str(tmp_path / "t.json"))
    assert [(b.page_no, b.keyword, b.answer, b.size) for b in boxes] == [(0, "a", "YES", 0.4), (1, "a", "y", 0.4)]
    (tmp_path / "bad.json").write_text("{")
    assert dictionary.read_template(spark, str(tmp_path / "bad.json")) == []
    g = np.full((40, 40), 255, np.uint8)
    g[16:24, 16:24] = 0
    page = bytearray(g.tobytes())
    df = spark.createDataFrame([(1, 0, 40, 40, page), (1, 1, 40, 40, page), (2, 0, 40, 40, page), (3, 0, 40, 40, None), (4, 7, 40, 40, page)], "doc_id bigint, page_no int, width int, height int, gray binary")
    assert {r["doc_id"]: r["value"] for r in images.template_values(df, boxes).collect()} == {1: "y", 2: "YES"}


def test_page_boxes_scale_with_text():
    g = np.full((300, 300), 255, np.uint8)
    g[50:62, [50, 61]] = g[[50, 61], 50:62] = 120
    assert images.page_boxes(g) == [(56.0, 56.0, images.page_boxes(g)[0][2], False)]
    assert images.page_boxes(g, 30.0) == []
    assert images.page_boxes(np.zeros((0, 0), np.uint8)) == images.page_boxes(np.full((30, 30), 9, np.uint8)) == []


def test_combs_by_seed_bands():
    # the third box lies half a side below the first and belongs to its band, the fourth to no band of it
    boxes = np.array([(0, 0, 10), (15, 2, 10), (30, 5, 10), (45, 9, 10), (200, 9, 10)], float)
    assert images.combs(boxes) == {0, 1, 2}
    assert images.combs(np.zeros((0, 3))) == set()


def test_nearest_line_of_ties_and_blanks(spark):
    marks = spark.createDataFrame([(1, 0, 5.0), (1, 1, 5.5), (1, 2, 90.0), (2, 3, 1.0), (1, 4, None), (3, 5, 0.0)], "page int, mark int, my double")
    lines = spark.createDataFrame([(1, 7, 4.0), (1, 3, 6.0), (1, 2, 6.0), (1, 9, None), (3, 1, 1.0)], "page int, line int, ly double")
    got = geometry.nearest_line(marks, lines, ["page"], "mark", "my", "line", "ly", 10.0)
    assert {r["mark"]: r["line"] for r in got.collect()} == {0: 2, 1: 2, 2: None, 3: None, 4: None, 5: 1}


def _crop(rule=True, stroke=True):
    g = np.full((80, 240, 3), 255, np.uint8)
    if stroke:
        x = np.arange(40, 180)
        y = np.rint(35 + 15 * np.sin(x / 8)).astype(int)
        for step in range(-2, 3):
            g[y + step, x] = (20, 20, 120)
    if rule:
        g[70:72] = 0
    return g


def test_signature_keeps_its_strokes_and_loses_rules():
    alone = ink.clean(_crop(rule=False))
    assert alone.sum() > 600 and np.array_equal(ink.clean(_crop()), alone)
    assert not ink.clean(_crop(stroke=False)).any() and not ink.clean(np.full((40, 60, 3), 255, np.uint8)).any()
    speck = _crop(rule=False)
    speck[0:3, 0:3] = 0
    assert np.array_equal(ink.clean(speck), alone)
    assert ink.score(np.zeros((5, 5), bool)) == ink.NO_INK
    assert ink.score(alone) > ink.score(alone | (np.arange(80) == 70)[:, None])


def test_lines_and_colours():
    z = np.zeros((50, 100), bool)
    z[30, 10:90] = True
    z[np.rint(10 + np.arange(60) * 0.05).astype(int), np.arange(60)] = True
    assert [(a, b) for a, b, _, _ in ink.straight(z, 20, 6, 20, 0.12)] == [(10, 89), (0, 59)]
    assert ink.straight(np.eye(50, dtype=bool), 20, 6, 20, 0.12) == []
    pens = np.array([[(20, 20, 120), (200, 10, 10), (0, 0, 0), (255, 255, 255), (20, 120, 20), (120, 118, 118)]], np.uint8)
    assert ink.coloured(pens).tolist() == [[True, True, False, False, False, False]]


def test_png_holds_the_image():
    import struct
    import zlib

    g = np.arange(12, dtype=np.uint8).reshape(3, 4)
    file = ink.png(g)
    at = file.index(b"IDAT")
    raw = zlib.decompress(file[at + 4 : at + 4 + struct.unpack(">I", file[at - 4 : at])[0]])
    assert struct.unpack(">II", file[16:24]) == (4, 3)
    assert np.array_equal(np.frombuffer(raw, np.uint8).reshape(3, 5)[:, 1:], g)


def test_crops_of_signatures(spark):
    raw = bytearray(_crop().tobytes())
    pages = spark.createDataFrame([(1, 1, 240, 80, raw), (2, 1, 240, 80, None), (3, 1, 9, 9, raw)], "doc int, page_no int, width int, height int, rgb binary")
    boxes = spark.createDataFrame([(1, 1, 5, 0, 0, 240, 80), (1, 1, 6, 500, 500, 600, 600), (2, 1, 5, 0, 0, 9, 9), (3, 1, 5, 0, 0, 9, 9), (4, 1, 5, 0, 0, 9, 9)], "doc int, page_no int, box_id int, x0 int, y0 int, x1 int, y1 int")
    got = ink.signature_images(pages, boxes, ["doc", "page_no"], "strict").collect()
    assert [(r["doc"], r["box_id"], r["mode"], r["n_ink"]) for r in got] == [(1, 5, "strict", int(ink.clean(_crop(), "strict").sum()))]
