import os
from difflib import SequenceMatcher

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from formweave.functions import text
from formweave.operators import geometry, images, lines, matching, tables
from formweave.plans.queries import ORACLES, QUERIES
from formweave.sources import dictionary

SF = "/root/testdata/sf0.001"


def rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(map(str, r)) for r in df.select(*cols).collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["normalize_labels", "next_values", "section_ranges", "row_clusters", "heading_as_of", "table_records", "field_values", "unmatched_keywords"])
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in "customer part orders lineitem events documents pages labels".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    got = con.execute(ORACLES[name])
    order = [x[0] for x in got.description]
    expected = sorted(tuple(str(r[order.index(c)]) for c in sorted(order)) for r in got.fetchall())
    assert rows(df) == expected


def test_every_query_is_registered():
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(ORACLES) <= set(QUERIES)


def one(spark, c, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(c.alias("x")).head()[0]


def test_text_functions(spark):
    v = F.col("v")
    assert one(spark, text.clean_value(v), v=" a\u00a0\t b ") == "a b"
    assert one(spark, text.percent(v), v="up to 12.5 % a year") == "12.5%"
    assert one(spark, text.date(v), v="on 3 March 2024 or 4/5/2024") == "4/5/2024"
    assert one(spark, text.date(v), v="on 3 March 2024") == "3 March 2024"
    assert one(spark, text.camel_name(v), v="name of the (full) account holder") == "NameOfTheAccountHolder"
    assert one(spark, text.yes_no(v), v="[X] YES [ ] NO") == "YES"
    assert one(spark, text.yes_no(v), v="[ ] YES  ,  [X] NO") == "NO"
    assert one(spark, text.label_variants(v), v="* Name: Ann") == ["* Name: Ann", "Name: Ann", "Name"]


def test_context_equals_longest_common_run(spark):
    pairs = [("theaccountholdername", "accountho1der"), ("abcdefghij", "xbcdefgh"), ("short", "sho"), ("anything", ""), ("zzaccountzz", "accounts")]
    for hay, needle in pairs:
        m = SequenceMatcher(None, hay, needle, autojunk=False).find_longest_match().size
        expected = bool(needle) and (needle in hay or (len(needle) >= 8 and m / len(needle) >= 0.7))
        assert one(spark, text.has_context(F.col("h"), F.col("n")), h=hay, n=needle) == expected


def test_fuzzy_keeps_the_winner_over_all_aliases(spark):
    aliases, _ = dictionary.from_rows(spark, [("customer", ["Customer Name"], "text"), ("custom", ["Custom Names"], "text")])
    labels = spark.createDataFrame([("CUST0MER NAME",), ("nothing alike",)], "label string")
    got = matching.fuzzy(labels, "label", aliases).collect()
    assert [(r["label_norm"], r["keyword"]) for r in got] == [("cust0mername", "customer")]


def test_row_clustering_follows_the_running_mean(spark):
    ys = [0.0, 7.0, 11.0, 12.1, 30.0]
    cells = spark.createDataFrame([(1, i, y, 8.0) for i, y in enumerate(ys)], "page int, id bigint, y double, tol double")
    got = {r["id"]: r["row_no"] for r in geometry.cluster_rows(cells, ["page"], "y", "id", "tol").collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 4: 2}


def test_as_of_takes_the_last_heading_above(spark):
    left = spark.createDataFrame([(1, 5.0), (1, 1.0), (2, 9.0)], "p int, y double")
    right = spark.createDataFrame([(1, 2.0, "a"), (1, 5.0, "b")], "p int, hy double, name string")
    assert rows(geometry.as_of(left, right, ["p"], "y", "hy", "name")) == [("None", "1", "1.0"), ("None", "2", "9.0"), ("b", "1", "5.0")]


def test_spans_cross():
    html = "<table><tr><td rowspan=2>a</td><td colspan=2>b</td></tr><tr><td>c</td><td>d &amp; e</td></tr><tr><td>f</td></tr></table>"
    assert tables.grid(html) == [["a", "b", "b"], ["a", "c", "d & e"], ["f", "", ""]]
    assert tables.grid("") == []


def test_ticks():
    g = np.full((40, 40), 255, np.uint8)
    assert not images.ticked(g, 0.5, 0.5, 0.5)
    g[16:24, 16:24] = 0
    assert images.ticked(g, 0.5, 0.5, 0.5)


def test_dictionary_file(spark, tmp_path):
    p = tmp_path / "d.json"
    p.write_text('{"keywords": ["name", "date"], "aliases": {"name": ["Full Name", {"label": "Name", "context": "next of kin"}], "date": [{"label": "Day", "context": []}]}, "fuzzy_threshold": 0.9}')
    plain, ctx, t = dictionary.read_json(spark, str(p))
    assert t == 0.9
    assert {(r["keyword"], r["alias_norm"]) for r in plain.collect()} == {("name", "name"), ("date", "date"), ("name", "fullname"), ("date", "day")}
    assert [(r["keyword"], r["label_norm"], r["context_norm"]) for r in ctx.collect()] == [("name", "name", "nextofkin")]
    p.write_text('{"keywords": []}')
    with pytest.raises(ValueError):
        dictionary.read_json(spark, str(p))


def test_ocr_payloads(spark):
    data = [(1, '{"res": {"rec_texts": ["a", " ", "b"], "rec_scores": [0.9, 0.1, 0.8], "rec_boxes": [[1,2,3,4],[0,0,1,1],[5,6,7,8]]}}'), (2, "no json"), (3, '{"rec_texts": ["x"]}')]
    got = dictionary.ocr_cells(spark.createDataFrame(data, "doc_id bigint, payload string")).collect()
    assert [(r["doc_id"], r["text"], r["x0"], r["y1"]) for r in got] == [(1, "a", 1.0, 4.0), (1, "b", 5.0, 8.0), (3, "x", 0.0, 1.0)]


def test_prefix_prefers_the_longest(spark):
    aliases, _ = dictionary.from_rows(spark, [("order", [], "text"), ("order_no", ["Order No"], "number")])
    df = spark.createDataFrame([(1, 0, "Order no 77")], "doc_id bigint, line_no int, line string")
    r = lines.longest_prefix(df, aliases).head()
    assert (r["keyword"], r["n_words"], r["rest"]) == ("order_no", 2, "77")
