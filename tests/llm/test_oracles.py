import os

import duckdb
import pytest

from formweave.llm import oracles, queries, quality_rules, quotations

SF = "/root/testdata/sf0.001"


def same(df, con, sql):
    got = con.execute(sql)
    names = [x[0] for x in got.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted(tuple(str(r[names.index(c)]) for c in sorted(names)) for r in got.fetchall())
    assert sorted(tuple(map(str, r)) for r in df.select(*sorted(names)).collect()) == expected


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in "documents pages conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    same(queries.queries()[name](spark, SF), con, queries.oracle_sql()[name])


def test_quotes_match_sql(spark):
    rows = [
        (1, 0, "user", "How does it work?\nTell me  more"),
        (1, 1, "assistant", "> how does it work?\nBy itself."),
        (1, 2, "user", "> > How does it work?\n> By itself.\nThanks"),
        (1, 3, "assistant", ">> By itself.\n > thanks\nplain\n> tell me more"),
        (1, 4, "user", None),
        (1, 5, "user", ""),
        (2, 0, "user", "> nowhere said\n>\nHello"),
        (2, 1, "user", "> hello\n> and more"),
        (2, 1, "user", "> hello\n> and more"),
        (None, 1, "user", "> hello"),
        (3, None, "user", "> hello"),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    same(quotations.link_conversations(df), con, oracles.OP6)


def test_quality_matches_sql_on_edges(spark):
    block = " ".join(f"w{i}" for i in range(9))
    rows = [(1, None), (2, ""), (3, "\n\n \t"), (4, f"{block} {block} {block}"), (5, "# | <a> $ the\nThe!\nthe\n  \n  "), (6, " ".join(["the"] * 50)), (None, "a b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    out = quality_rules.judge(df)
    same(out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"), con, oracles.OP10)
