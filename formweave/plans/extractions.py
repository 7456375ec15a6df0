"""Registered queries of payload scans, page fields, header maps and whole results."""

from __future__ import annotations

from pyspark.sql import functions as F

from formweave.operators import pages, tables
from formweave.plans.registry import query
from formweave.plans.views import v_grid
from formweave.session import table
from formweave.sinks import render
from formweave.sources import dictionary, payloads

_ORDERS = "select o.*, c.* from orders o join customer c on o_custkey = c_custkey"

#: Keywords with aliases and kinds, and aliases that need a phrase in the lines above.
PAGE_FIELDS = [
    ("customer", ["Customer Name"], "text"), ("segment", ["Market Segment"], "text"), ("priority", ["Priority of Order"], "number"), ("status", ["Order Status"], "text"),
    ("accepted", ["Accepted"], "yesno"), ("signed_by_principal", [], "date"), ("signed_by_joint", [], "date"),
]
ANCHORED = [("signed_by_principal", "date", "principalsignature", 5000), ("signed_by_joint", "date", "jointsignature", 6000)]


def _orders(spark, sf):
    return table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))


def v_page(spark, sf):
    """Pages with misread captions, one bare caption under two headings, wrapped values, a caption with a qualifier, and prose where a tick belongs."""
    k = F.col("o_orderkey")
    rows = F.array(
        F.concat(F.when(k % 7 == 0, "CUST0MER NAME: ").otherwise("CUSTOMER NAME: "), "c_name"),
        F.lit("PRINCIPAL SIGNATURE"), F.concat(F.lit("DATE: "), F.date_format("o_orderdate", "dd/MM/yyyy")),
        F.when(k % 5 == 0, "J0INT SIGNATURE").otherwise("JOINT SIGNATURE"), F.concat(F.lit("DATE: "), F.date_format(F.date_add("o_orderdate", 3), "dd/MM/yyyy")),
        F.lit("MARKET SEGMENT"), F.col("c_mktsegment"), F.when(k % 2 == 0, "and its suppliers").otherwise(""),
        F.lit(""), F.lit("PRIORITY OF ORDER (MANDATORY)"), F.col("o_orderpriority"), F.lit("of this year"),
        F.concat(F.lit("ORDER STATUS : "), "o_orderstatus", F.lit(" pending")), F.when(k % 3 == 0, "ACCEPTED: YES").otherwise("ACCEPTED: as agreed"), F.lit("DATE: 01/01/1900"),
    )
    return _orders(spark, sf).select(k.alias("doc_id"), F.posexplode(rows).alias("line_no", "line"))


def _page_dictionary(spark):
    plain, kinds = dictionary.from_rows(spark, PAGE_FIELDS)
    return plain, spark.createDataFrame(ANCHORED, "keyword string, label_norm string, context_norm string, ord int"), kinds


@query(
    f"""select doc_id, unnest(['customer', 'signed_by_principal', 'signed_by_joint', 'segment', 'priority', 'status', 'accepted']) as keyword,
      unnest([c_name, strftime(o_orderdate, '%d/%m/%Y'), strftime(o_orderdate + interval 3 day, '%d/%m/%Y'), c_mktsegment || case when doc_id % 2 = 0 then ' and its suppliers' else '' end,
        o_orderpriority, o_orderstatus || ' pending', 'YES']) as value from (select *, o_orderkey as doc_id from ({_ORDERS})) where true
    """.replace("where true", "").join(["select * from (", ") where keyword <> 'accepted' or doc_id % 3 = 0"])
)
def page_fields(spark, sf):
    """Fuzzy and anchored captions; the last line's bare caption has no anchor and is no field."""
    plain, anchored, kinds = _page_dictionary(spark)
    return pages.line_fields(v_page(spark, sf), plain, anchored, kinds, ["doc_id"])


_DOCS = "select c_custkey as doc_id, c_custkey % 4 as k from customer"


def v_pages_of(spark, sf):
    """Two pages a customer, each with values of a free keyword and of a table's column; not every first page has the free one."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("page_no"))
    one = c.withColumn("keyword", F.explode(F.array(F.lit("name"), F.lit("Items.Part"), F.lit("only")))).withColumn("value", F.concat_ws("-", "keyword", "page_no"))
    return one.where("keyword <> 'only' or (page_no = 1 and doc_id % 4 = 0)")


@query(f"select doc_id, 'name' as keyword, 'name-2' as value from ({_DOCS}) union all select doc_id, 'only', 'only-1' from ({_DOCS}) where k = 0")
def document_fields(spark, sf):
    keywords = spark.createDataFrame([("name",), ("only",), ("Items.Part",), ("absent",)], "keyword string")
    columns = spark.createDataFrame([("Items", "Part"), ("Items", "Undeclared")], "table_name string, column string")
    return pages.document_fields(v_pages_of(spark, sf), pages.table_keywords(keywords, columns))


@query(f"select doc_id, case when k = 0 then 'absent' else 'only,absent' end as missing from ({_DOCS})")
def missing_keywords(spark, sf):
    keywords = spark.createDataFrame([("name", 0), ("Items.Part", 1), ("only", 2), ("absent", 3)], "keyword string, ord int")
    cells = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("Items.Part").alias("keyword"))
    got = pages.unmatched(keywords, cells.select("doc_id"), document_fields(spark, sf), cells)
    return got.select("doc_id", F.array_join("missing", ",").alias("missing"))


@query(f"select doc_id, p as page_no from ({_DOCS}), (select unnest([1, 2, 3]) as p) where k = 0 or (k = 1 and p < 2) or (k = 2 and p <> 2)")
def open_pages(spark, sf):
    """Pages that may have text tables: of four documents one has no other table, one an HTML table on page 2, one a geometric one there, one HTML from page 1 on."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), (F.col("c_custkey") % 4).alias("k"))
    made = lambda page, source: F.struct(F.lit(page).alias("page_no"), F.lit(source).alias("source"))
    known = F.when(F.col("k") == 1, made(2, "html")).when(F.col("k") == 2, made(2, "geometric")).when(F.col("k") == 3, made(1, "html"))
    tables_ = c.withColumn("t", known).where("t is not null").select("doc_id", "t.*")
    every = c.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("page_no"))
    return pages.without_earlier(every, tables_)


#: Header cells of three rows over two columns and a third that means nothing; the second column's caption runs over two rows.
_HEADS = [(0, 0, "* Part /"), (0, 1, "Quantity"), (1, 1, "Ordered/"), (0, 2, "Remarks"), (1, 0, ""), (1, 2, "")]


def _grid(spark, sf):
    body = v_grid(spark, sf).where("row_no > 0").select("table_no", (F.col("row_no") + 1).alias("row_no"), "col_no", F.when((F.col("col_no") == 1) & (F.col("table_no") % 3 == 0), "").otherwise(F.regexp_replace("text", "^Q", "")).alias("text"))
    heads = F.array(*(F.struct(F.lit(r).alias("row_no"), F.lit(c).alias("col_no"), F.lit(t).alias("text")) for r, c, t in _HEADS))
    first = v_grid(spark, sf).select("table_no").distinct().select("table_no", F.explode(heads).alias("h")).select("table_no", "h.*")
    return first.unionByName(body)


def _column_dictionary(spark):
    plain, _ = dictionary.from_rows(spark, [("Items.Part", ["Part"], "text"), ("Items.Quantity", ["Quantity/Ordered"], "text"), ("remarks", ["Remarks"], "text")])
    return plain, spark.createDataFrame([], "keyword string, label_norm string, context_norm string, ord int")


_ROWS = "select table_no, row_no + 1 as row_no, max(text) filter (col_no = 0) as part, max(text) filter (col_no = 1) as flag from v_grid where row_no > 0 group by 1, 2"


@query("select distinct table_no, unnest([0, 1])::int as col_no, unnest(['Items.Part', 'Items.Quantity']) as keyword from v_grid", "v_grid")
def header_keywords(spark, sf):
    """The third column means a keyword that belongs to no table, so it has none."""
    return tables.header_map(tables.header_rows(_grid(spark, sf), ["table_no"], whole=True), ["table_no"], *_column_dictionary(spark), dotted=True)


@query(f"select table_no, row_no, part, case when table_no % 3 = 0 then null else flag end as flag from ({_ROWS})", "v_grid")
def keyword_records(spark, sf):
    cells = tables.header_rows(_grid(spark, sf), ["table_no"], whole=True)
    got = tables.keyword_records(cells, ["table_no"], tables.header_map(cells, ["table_no"], *_column_dictionary(spark), dotted=True))
    return got.select("table_no", "row_no", F.try_element_at("record", F.lit("Items.Part")).alias("part"), F.try_element_at("record", F.lit("Items.Quantity")).alias("flag"))


@query(f"select table_no, '| Items.Part | Items.Quantity |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || part || ' | ' || case when table_no % 3 = 0 then '' else flag end || ' |', chr(10) order by row_no) as body from ({_ROWS}) group by 1", "v_grid")
def record_markdown(spark, sf):
    cells = tables.header_rows(_grid(spark, sf), ["table_no"], whole=True)
    records = tables.keyword_records(cells, ["table_no"], tables.header_map(cells, ["table_no"], *_column_dictionary(spark), dotted=True))
    return render.record_markdown(records, F.array(F.lit("Items.Part"), F.lit("Items.Quantity")), ["table_no"])


@query("select table_no, 'Part|Flag|Quantity' as header, string_agg(r, ';' order by row_no) as rows from (select table_no, row_no, string_agg(text, '|' order by col_no) as r from v_grid where row_no > 0 group by 1, 2) group by 1", "v_grid")
def dense_tables(spark, sf):
    got = tables.dense(v_grid(spark, sf), ["table_no"])
    return got.select("table_no", F.array_join("header", "|").alias("header"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";").alias("rows"))


_L = "select doc_id, doc_id % 4 as k, quality, toxic from labels"


def v_payload(spark, sf):
    """Results in four shapes: texts at the top, under `res`, under `overall_ocr_res`, and no JSON; scores of which one is no number, and tables listed twice."""
    d = F.col("doc_id").cast("string")
    texts = F.concat(F.lit('"rec_texts":["Name ",'), F.lit('"  ","'), d, F.lit('","a\\n\\n b"],"rec_scores":[0.5,"x","0.75",1],"rec_boxes":[[1,2,3,4],[0,0,1,1],[5,6,'), d, F.lit(',8]]'))
    table_ = F.concat(F.lit("<table><tr><td>"), d, F.lit("</td></tr></table>"))
    blocks = F.concat(F.lit('"parsing_res_list":[{"label":"title","content":"Form '), d, F.lit('"},{"label":"table","content":"none"},{"label":"","content":"two\\nlines"},{"label":"table","content":"'), table_, F.lit('"},{"content":""}],"table_res_list":[{"pred_html":"'), table_, F.lit('"},{"pred_html":"<table></table>"}]'))
    top = F.concat(F.lit("{"), texts, F.lit(","), blocks, F.lit("}"))
    under = F.concat(F.lit('{"rec_texts":[],"overall_ocr_res":{'), texts, F.lit("},"), blocks, F.lit("}"))
    k = F.col("doc_id") % 4
    return table(spark, sf, "labels").select("doc_id", F.when(k == 0, top).when(k == 1, F.concat(F.lit('{"res":'), top, F.lit("}"))).when(k == 2, under).otherwise("no json").alias("payload"))


@query(f"select doc_id, unnest([0, 2, 3])::int as line_no, unnest(['Name', doc_id::varchar, 'a' || chr(10) || 'b']) as line from ({_L}) where k < 3")
def payload_lines(spark, sf):
    return payloads.ocr_lines(v_payload(spark, sf), ["doc_id"])


@query(
    f"""select doc_id, unnest([0, 0, 0, 1, 1])::int as source, unnest([0, 2, 3, 0, 1])::int as block_no, unnest(['title', 'text', 'table', 'table', 'table']) as label,
      unnest(['Form ' || doc_id::varchar, 'two' || chr(10) || 'lines', '<table><tr><td>' || doc_id::varchar || '</td></tr></table>', '<table><tr><td>' || doc_id::varchar || '</td></tr></table>', '<table></table>']) as content from ({_L}) where k < 3"""
)
def payload_blocks(spark, sf):
    return payloads.layout_blocks(v_payload(spark, sf), ["doc_id"])


@query(f"select doc_id, unnest([0, 2, 2])::int as block_no, unnest([0, 0, 1])::int as line_no, unnest(['Form ' || doc_id::varchar, 'two', 'lines']) as line from ({_L}) where k < 3")
def payload_block_lines(spark, sf):
    return payloads.block_lines(payloads.layout_blocks(v_payload(spark, sf), ["doc_id"]), ["doc_id"]).drop("source")


@query(f"select doc_id, unnest([1, 2])::int as table_no, unnest(['<table><tr><td>' || doc_id::varchar || '</td></tr></table>', '<table></table>']) as html from ({_L}) where k < 3")
def payload_tables(spark, sf):
    return payloads.html_tables(v_payload(spark, sf), ["doc_id"])


@query(f"select doc_id, case when k < 3 then 'Confidence score: avg=0.7500, min=0.5000, max=1.0000, n=3' else 'Confidence score: unavailable' end as summary from ({_L})")
def payload_confidence(spark, sf):
    p = v_payload(spark, sf)
    return payloads.confidence_text(payloads.scores(p, ["doc_id"]), p, ["doc_id"])


@query(
    f"""select doc_id, unnest([0, 1, 2, 3])::int as block_no, unnest([0.5, 0.0, 0.75, 1.0])::double as score, unnest([1.0, 0.0, least(5.0, doc_id), 0.0])::double as x0, unnest([2.0, 0.0, 6.0, 0.0])::double as y0,
      unnest([3.0, 1.0, greatest(5.0, doc_id), 0.0])::double as x1, unnest([4.0, 1.0, 8.0, 0.0])::double as y1 from ({_L}) where k < 2"""
)
def payload_rectangles(spark, sf):
    """Blocks with four corners each; the corners of a box whose right side lies left of its left one are ordered by the rectangle."""
    rows = payloads.blocks(v_payload(spark, sf), ["doc_id"])
    r = payloads.rectangle(F.col("quad"))
    return rows.select("doc_id", "block_no", "score", r["x0"].alias("x0"), r["y0"].alias("y0"), r["x1"].alias("x1"), r["y1"].alias("y1"))


@query("select c_custkey as doc_id, 'a/b.c/out' || c_custkey::varchar || '_readable.txt' as readable, 'a/b.c/out' || c_custkey::varchar || '.json' as json, 'a/b.c/plain_readable.md' as bare, '# Failed' || chr(10) || chr(10) || 'Input document: `' || c_name || '`' || chr(10) || 'Execution time: 2.5' || chr(10) || chr(10) || 'no pages' || chr(10) as report from customer")
def failure_reports(spark, sf):
    path = F.concat(F.lit("a/b.c/out"), F.col("c_custkey").cast("string"), F.lit(".txt"))
    report = render.failure_report(F.lit("# Failed"), F.col("c_name"), F.lit(2.5), F.lit("no pages"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), render.output_path(path, "readable").alias("readable"), render.output_path(path, "json").alias("json"), render.output_path(F.lit("a/b.c/plain"), "readable").alias("bare"), report.alias("report"))
