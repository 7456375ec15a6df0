"""Registered queries of whole extractions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from formweave.functions import text
from formweave.operators import compose, fields, images, schema
from formweave.plans.forms import _LABEL, mark_values, rule_values, section_values
from formweave.plans.queries import _FIELDS, NORM, _values
from formweave.plans.registry import ORACLES, query
from formweave.plans.views import FORM_FIELDS, v_dict, v_form, v_grid
from formweave.session import table

TABLE_FIELDS = ["part", "flag", "quantity"]
MORE_FIELDS = ["discount", "ordered", "customer_no", "gift", "approved", "express", "choice"]
EVERY_FIELD = [k for k, _, _ in FORM_FIELDS] + MORE_FIELDS + TABLE_FIELDS
_PROMOTED = "select table_no as doc_id, keyword, arg_min(text, row_no) as value from (select *, (['part', 'flag', 'quantity'])[col_no + 1] as keyword from v_grid where row_no > 0) where trim(text) not in ('', 'YES', 'NO') group by 1, 2"


def _docs(spark, sf):
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return orders.select(F.col("o_orderkey").alias("doc_id"))


@query(_PROMOTED, "v_grid")
def promoted_values(spark, sf):
    keyword = F.element_at(F.array(*map(F.lit, TABLE_FIELDS)), F.col("col_no") + 1)
    cells = v_grid(spark, sf).where("row_no > 0").select(F.col("table_no").alias("doc_id"), F.lit(1).alias("table_no"), "row_no", keyword.alias("keyword"), F.col("text").alias("value"))
    return compose.promoted(cells, spark.createDataFrame([(k, "text") for k in TABLE_FIELDS], "keyword string, kind string"))


@query()
def canonical_fields(spark, sf):
    """Marks, caption rules, section rules, lines and tables merged by priority onto all keywords of every form."""
    sources = [
        ("marks", mark_values(spark, sf)), ("rules", rule_values(spark, sf)), ("sections", section_values(spark, sf)),
        ("lines", fields.merge(fields.from_lines(v_form(spark, sf), v_dict(spark)[0]))), ("tables", promoted_values(spark, sf)),
    ]
    keywords = spark.createDataFrame([(k,) for k in EVERY_FIELD], "keyword string")
    return compose.by_priority(sources, _docs(spark, sf), keywords)


def _canonical_sql() -> str:
    names = ["mark_values", "rule_values", "section_values", "field_values", "promoted_values"]
    parts = " union all ".join(
        f"select doc_id, keyword, value, {i} as p, '{source}' as source from ({ORACLES[n]})" for i, (n, source) in enumerate(zip(names, ["marks", "rules", "sections", "lines", "tables"], strict=True))
    )
    return f"""select d.doc_id, k.keyword, coalesce(b.value, '') as value, coalesce(b.source, 'not-found') as source
    from (select o_orderkey as doc_id from orders where o_custkey in (select c_custkey from customer)) d, (select unnest({EVERY_FIELD}) as keyword) k
    left join (select doc_id, keyword, arg_min(value, p) as value, arg_min(source, p) as source from ({parts}) where value <> '' group by 1, 2) b on b.doc_id = d.doc_id and b.keyword = k.keyword"""


ORACLES["canonical_fields"] = _canonical_sql()


@query(
    f"""select doc_id, keyword, case when keyword = 'approver' and doc_id % 3 = 0 then 'status ' || status when keyword = 'status' and doc_id % 3 = 1 then priority
      when keyword = 'priority' and doc_id % 3 = 1 then '' else value end as value from (select *, max(value) filter (keyword = 'status') over (partition by doc_id) as status,
      max(value) filter (keyword = 'priority') over (partition by doc_id) as priority from ({_FIELDS}))""",
    "v_form v_dict v_kinds",
)
def column_claims(spark, sf):
    """A caption over an answer fills an empty field, and takes the answer from the field that holds it."""
    got = _values(spark, sf).select("doc_id", "keyword", "value")
    blank = (F.col("keyword") == "status") & (F.col("doc_id") % 3 == 1)
    read = got.withColumn("value", F.when(blank, "").otherwise(F.col("value")))
    status = got.where("keyword = 'status' and doc_id % 3 = 0").select("doc_id", F.lit("approver").alias("keyword"), F.concat(F.lit("status "), "value").alias("value"))
    priority = got.where("keyword = 'priority' and doc_id % 3 = 1").select("doc_id", F.lit("status").alias("keyword"), "value")
    return compose.claim_columns(read, status.unionByName(priority), [k for k, _, _ in FORM_FIELDS])


_SHIFTED = f"""select doc_id, keyword, case when keyword = 'status' and doc_id % 5 = 0 then name when keyword = 'customer' and doc_id % 5 = 1 then 'Market Segment' when keyword = 'total' and doc_id % 5 = 2 then name else value end as value
  from (select *, max(value) filter (keyword = 'customer') over (partition by doc_id) as name from ({_FIELDS}))"""
_CAPTIONS = f"select doc_id, line_no, arg_min(keyword, ord) as keyword from v_form join v_dict on alias_norm = {NORM.format(chr(115) + 'tring_split(line, ' + chr(39) + ':' + chr(39) + ')[1]')} group by 1, 2"


@query(
    f"""select doc_id, keyword, case when value <> '' and keyword <> 'total' and (exists (select 1 from v_dict d where d.alias_norm = {NORM.format('value')} and d.keyword <> s.keyword) or coalesce(gap, 0) > 2) then '' else value end as value
      from ({_SHIFTED}) s left join (select c.doc_id, c.keyword, min(abs(c.line_no - f.line_no)) as gap from ({_CAPTIONS}) c join ({_SHIFTED}) v on v.doc_id = c.doc_id and v.keyword = c.keyword
        join v_form f on f.doc_id = c.doc_id and {NORM.format('v.value')} <> '' and contains({NORM.format('f.line')}, {NORM.format('v.value')}) group by 1, 2) g using (doc_id, keyword)""",
    "v_form v_dict v_kinds",
)
def plausible_values(spark, sf):
    """Of every five forms one reads a name into its status, one a caption into its name, and one a name into a protected field."""
    got = _values(spark, sf).select("doc_id", "keyword", "value")
    names = got.where("keyword = 'customer'").select("doc_id", F.col("value").alias("name"))
    k, on = F.col("doc_id") % 5, lambda x: F.col("keyword") == x
    wrong = F.when(on("status") & (k == 0), F.col("name")).when(on("customer") & (k == 1), "Market Segment").when(on("total") & (k == 2), F.col("name")).otherwise(F.col("value"))
    return compose.plausible(got.join(names, "doc_id").select("doc_id", "keyword", wrong.alias("value")), v_form(spark, sf), v_dict(spark)[0], ("total",))


_CAMEL = "array_to_string(list_transform(list_filter(string_split_regex(label, '[^A-Za-z0-9]+'), lambda w: w <> ''), lambda w: upper(w[1:1]) || lower(w[2:])), '')"
_KIND = r"""case when regexp_matches(upper(label), '\bDATE\b|DD[-/]MM|MM[-/]YY|\bDOB\b|\bBIRTH\b') then 'date' when regexp_matches(upper(label), '\bSIGNATURE\b') then 'signature'
  when regexp_matches(upper(label), '\bNO\.|NUMBER\b|\bAMOUNT\b|\bRM\b|\bCODE\b|%') then 'number' else 'text' end"""


@query(
    f"""select doc_id, (row_number() over (partition by doc_id order by s, o) - 1)::int as field_no, field, label, kind, stage from (
      select doc_id, {_CAMEL} as field, label, {_KIND} as kind, 3 as s, line_no as o, 'layout' as stage from (select *, {_LABEL} as label from v_form) where label <> '' and doc_id % 2 = 0 and label <> 'ORDER STATUS'
      union all select doc_id, 'MarketSegment', 'MARKET SEGMENT', 'text', 1, line_no, 'key_value' from v_form where line_no = 2 and doc_id % 2 = 1
      union all select doc_id, 'Approved', 'APPROVED', 'text', 2, 6, 'mark' from v_form where line_no = 6
      union all select doc_id, 'Items.' || name, label, 'text', 5, o, 'table' from (select distinct doc_id from v_form), (values ('Status', 'Order Status', 0), ('Quantity', 'Quantity', 1)) t(name, label, o))""",
    "v_form",
)
def form_schemas(spark, sf):
    """Blank forms' fields: odd ones have key-value pairs, the others are read by layout; a table column owns one caption."""
    form = v_form(spark, sf)
    none = F.lit("").alias("context")
    layout = schema.label_fields(form).select("doc_id", F.lit("layout").alias("stage"), F.col("line_no").alias("ord"), "label", "context")
    pairs = form.where("line_no = 2 and doc_id % 2 = 1").select("doc_id", F.lit("key_value").alias("stage"), F.col("line_no").alias("ord"), text.clean_value(F.col("line")).alias("label"), none)
    ticks = form.where("line_no = 6").select("doc_id", F.lit("mark").alias("stage"), F.col("line_no").alias("ord"), F.lit("APPROVED").alias("label"), none)
    made = F.array(*(F.struct(F.lit("Items").alias("table_name"), F.lit(i).alias("ord"), F.lit(c).alias("column"), F.lit(label).alias("label")) for i, (c, label) in enumerate([("Status", "Order Status"), ("Quantity", "Quantity")])))
    columns = _docs(spark, sf).select("doc_id", F.explode(made).alias("c")).select("doc_id", "c.*")
    return compose.form_schema(layout.unionByName(pairs).unionByName(ticks), columns)


@query("select doc_id, 32 / 96::double as cx, 64 / 96::double as cy from labels where quality = 1 union all select doc_id, 72 / 96::double, 24 / 96::double from labels where toxic = 1")
def box_centers(spark, sf):
    """Draws two thin boxes per label, filled in part where it says so, and finds those that are ticked."""

    def rows(batches):
        for b in batches:
            out = []
            for d, *says in zip(b["doc_id"], b["quality"], b["toxic"], strict=True):
                g = np.full((96, 96), 255, np.uint8)
                g[88:92, 4:80] = 0  # a rule, no box
                for on, (x, y) in zip(says, ((32, 64), (72, 24)), strict=True):
                    g[y - 15 : y + 15, [x - 15, x + 14]] = 0
                    g[[y - 15, y + 14], x - 15 : x + 15] = 0
                    if on == 1:
                        g[y - 7 : y + 7, x - 7 : x + 7] = 0
                out += [(d, cx, cy) for cx, cy in images.box_centers(g)]
            yield pd.DataFrame(out, columns=["doc_id", "cx", "cy"])

    return table(spark, sf, "labels").select("doc_id", "quality", "toxic").mapInPandas(rows, "doc_id bigint, cx double, cy double")


_TEMPLATE = [
    images.Box(0, "good", "yesno", 0, "YES", 0.25, 0.25, 0.2), images.Box(0, "good", "yesno", 1, "NO", 0.75, 0.25, 0.2),
    images.Box(0, "tone", "option", 0, "harsh", 0.25, 0.75, 0.2), images.Box(0, "tone", "option", 1, "any", 0.75, 0.75, 0.2),
    images.Box(1, "good", "single", 0, "YES", 0.5, 0.5, 0.2),
]


@query(
    """select doc_id, 'good' as keyword, case when quality = 1 and toxic = 1 then 'BOTH' when quality = 1 then 'YES' else 'NO' end as value from labels where quality = 1 or toxic = 1
    union all select doc_id, 'tone', case when toxic = 1 then 'harsh' else 'any' end from labels"""
)
def template_values(spark, sf):
    """Pages drawn with ticks at the places of a fixed template, read back by it."""

    def rows(batches):
        for b in batches:
            out = []
            for d, q, t in zip(b["doc_id"], b["quality"], b["toxic"], strict=True):
                g = np.full((80, 80), 255, np.uint8)
                for on, (x, y) in ((q, (20, 20)), (t, (60, 20)), (t, (20, 60)), (1, (60, 60))):
                    if on == 1:
                        g[y - 4 : y + 4, x - 4 : x + 4] = 0
                out.append((d, 0, 80, 80, g.tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "page_no", "width", "height", "gray"])

    drawn = table(spark, sf, "labels").select("doc_id", "quality", "toxic").mapInPandas(rows, "doc_id bigint, page_no int, width int, height int, gray binary")
    return images.template_values(drawn, _TEMPLATE)
