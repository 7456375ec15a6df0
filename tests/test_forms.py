import os

import duckdb
import pytest
from pyspark.sql import functions as F

from formweave.functions import text
from formweave.operators import layout, marks, rules, schema, signatures
from formweave.plans.catalog import ORACLES, QUERIES
from formweave.sinks import render
from formweave.sources import dictionary

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["rule_values", "section_values", "mark_values", "mark_groups", "center_clusters", "text_tables", "label_fields", "signature_files", "table_markdown"])
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in "customer part orders lineitem events documents labels".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = con.execute(ORACLES[name])
    order = [x[0] for x in got.description]
    expected = sorted(tuple(str(r[order.index(c)]) for c in cols) for r in got.fetchall())
    assert sorted(tuple(map(str, r)) for r in df.select(*cols).collect()) == expected


def lines(spark, *texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id bigint, line_no int, line string")


def test_continuation_stops_at_a_gap_and_at_four_lines(spark):
    got = rules.continuation(lines(spark, "label", "a", "b", "", "c", "d", "e", "f", "g"), F.lit(True)).orderBy("line_no").collect()
    assert [r["value"] for r in got][:4] == ["a b", "b", "", "c d e f"]


def test_last_line_and_last_rule_win(spark):
    many = [rules.Rule("p", ("RATE",), "percent"), rules.Rule("p", ("FINAL",), "percent")]
    got = rules.line_rules(lines(spark, "rate 1%", "rate 2 %", "final rate 3%", None), many).collect()
    assert [(r["keyword"], r["value"]) for r in got] == [("p", "3%")]


def test_last_of_equal_sections_counts(spark):
    got = rules.section_texts(lines(spark, "intro", "7. a", "b", "7. c", "8", "9 d")).orderBy("section").collect()
    assert [(r["section"], r["body"]) for r in got] == [(7, "7. c\n8"), (9, "9 d")]


def test_text_table_leaves_out_a_row_that_is_not_whole(spark):
    d = dictionary.from_rows(spark, [("name", [], "text"), ("sum", [], "text")])[0]
    got = layout.text_tables(lines(spark, "x", "Name", "", "Sum", "ann", "1", "bob", "2", "carl"), d).orderBy("row_no", "keyword").collect()
    assert [(r["row_no"], r["keyword"], r["value"]) for r in got] == [(1, "name", "ann"), (1, "sum", "1"), (2, "name", "bob"), (2, "sum", "2")]
    assert layout.text_tables(lines(spark, "Name", "Name", "a", "b"), d).count() == 0
    assert layout.text_tables(spark.createDataFrame([], "doc_id bigint, line_no int, line string"), d).count() == 0


def test_box_label_ends_at_the_next_box(spark):
    boxes = spark.createDataFrame([(1, 0.0, True), (1, 50.0, False)], "row int, x double, ticked boolean")
    cells = spark.createDataFrame([(1, 10.0, "full"), (1, 20.0, "name"), (1, 60.0, "no")], "row int, x0 double, text string")
    got = marks.box_values(marks.box_labels(boxes, cells, ["row"])).orderBy("x").collect()
    assert [(r["label"], r["value"]) for r in got] == [("full name", "full name"), ("no", "")]


def test_gap_is_zero_without_one_side(spark):
    some = spark.createDataFrame([(1, 3), (1, 9)], "k int, row_no int")
    other = spark.createDataFrame([(1, 5)], "k int, row_no int")
    assert marks.caption_gaps(some, other, ["k"]).first()["gap"] == 2
    assert marks.caption_gaps(some, other.limit(0), ["k"]).first()["gap"] == 0


def test_unticked_labels_are_cleared(spark):
    v = spark.createDataFrame([("Option One", ["Option One"]), ("Option One x7", ["Option One"]), ("abc", ["abc"])], "value string, labels array<string>")
    assert [r["value"] for r in marks.clear_unticked(v, "labels").collect()] == ["", "Option One x7", "abc"]


def test_names_get_suffixes_in_order(spark):
    df = spark.createDataFrame([("Date a", "Date", 1), ("Date b", "Date", 2), ("Date a", "Date", 3)], "label string, name string, o int")
    assert {r["label"]: r["field"] for r in schema.unique_names(df, "label", "name", "o").collect()} == {"Date a": "Date", "Date b": "Date2"}


@pytest.mark.parametrize("line, label", [("Name : x", "Name"), ("Amount ......", "Amount"), ("City ____", "City"), ("Total    12.50", "Total"), ("plain text", ""), ("", "")])
def test_labels(spark, line, label):
    assert spark.createDataFrame([(line,)], "line string").select(schema.label_of(F.col("line"))).first()[0] == label


def test_signer_is_unknown_without_a_text_in_the_window(spark):
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0, 50.0), (2, 2, 0.0, 0.0, 100.0, 50.0)], "page int, box_id int, x0 double, y0 double, x1 double, y1 double")
    blocks = spark.createDataFrame([(1, "Date signed", 0.0, 60.0, 90.0, 70.0), (1, "Ann Bee", 0.0, 90.0, 90.0, 99.0), (2, "Far", 0.0, 900.0, 90.0, 910.0)], "page int, text string, x0 double, y0 double, x1 double, y1 double")
    assert {r["box_id"]: r["signer"] for r in signatures.signers(boxes, blocks, ["page"]).collect()} == {1: "Ann_Bee", 2: "Unknown_Signer"}


def test_signer_behind_an_anchor_goes_before_a_nearer_text(spark):
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0, 50.0)], "page int, box_id int, x0 double, y0 double, x1 double, y1 double")
    blocks = spark.createDataFrame([(1, "Nearer Text", 0.0, 52.0, 90.0, 70.0), (1, "Name: Bo Ray", 0.0, 90.0, 90.0, 99.0), (1, "Printed Name: Cy", 0.0, 190.0, 90.0, 199.0)], "page int, text string, x0 double, y0 double, x1 double, y1 double")
    assert signatures.signers(boxes, blocks, ["page"]).first()["signer"] == "Bo_Ray"
    person = lambda t: F.when(t.contains("Nearer"), F.lit("Nora Near"))
    assert signatures.signers(boxes, blocks, ["page"], person).first()["signer"] == "Nora_Near"


def test_renderers_escape(spark):
    v = spark.createDataFrame([(1, "a", "x|<y>", 0.9), (1, "b", "", 0.0)], "doc_id int, keyword string, value string, confidence double")
    assert "x\\|<y>" in render.field_markdown(v).first()["body"] and "## Unmatched\nb" in render.field_markdown(v).first()["body"]
    assert render.field_html(v).first()["body"] == "<table><tr><th>a</th><td>x|&lt;y&gt;</td></tr></table>"


def test_percent_without_a_word_behind_it_is_low(spark):
    df = spark.createDataFrame([("40%",), ("40%x",)], "v string").select(text.score_strict(F.col("v"), F.lit("percent")))
    assert [r[0] for r in df.collect()] == [0.2, 0.95]
