"""Document-shaped views of the generic tables, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formweave.operators import lines
from formweave.session import table
from formweave.sources import dictionary

#: Keywords with aliases and kinds.
FORM_FIELDS = [
    ("order_date", ["Order Date", "Date of Order"], "date"),
    ("customer", ["Customer Name", "Client"], "text"),
    ("segment", ["Market Segment"], "text"),
    ("total", ["Total Amount", "Amount Due"], "number"),
    ("priority", ["Priority of Order"], "text"),
    ("status", ["Order Status"], "text"),
    ("approver", ["Approved By"], "signature"),
]


def v_lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines.explode_lines(table(spark, sf, "documents"))


def v_form(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of an invented order form per order; every seventh has a misread caption."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    name = F.when(k % 7 == 0, "CUST0MER NAME: ").otherwise("CUSTOMER NAME: ")
    rows = F.array(
        F.concat(F.lit("ORDER DATE: "), F.date_format("o_orderdate", "dd/MM/yyyy")),
        F.concat(name, "c_name"),
        F.lit("MARKET SEGMENT"),
        F.col("c_mktsegment"),
        F.concat(F.lit("TOTAL AMOUNT: RM "), F.floor("o_totalprice").cast("bigint").cast("string")),
        F.concat(F.lit("PRIORITY OF ORDER "), "o_orderpriority"),
        F.when(k % 2 == 0, "[x] YES [ ] NO").otherwise("[ ] YES [x] NO"),
        F.concat(F.lit("ORDER STATUS : "), "o_orderstatus"),
        F.concat(F.lit("DISCOUNT "), (k % 40).cast("string"), F.lit(" % GRANTED")),
    )
    return o.select(k.alias("doc_id"), F.posexplode(rows).alias("line_no", "line"))


def v_dict(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return dictionary.from_rows(spark, FORM_FIELDS)


def v_grid(spark: SparkSession, sf: str) -> DataFrame:
    """A table per order: a header row, then a row per line item."""
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    li = table(spark, sf, "lineitem").withColumn("row_no", F.row_number().over(place))
    body = li.select(
        F.col("l_orderkey").alias("table_no"), "row_no",
        F.posexplode(F.array(F.col("l_partkey").cast("string"), F.col("l_returnflag"), F.concat(F.lit("Q"), F.floor("l_quantity").cast("bigint").cast("string")))).alias("col_no", "text"),
    )
    head = li.select(F.col("l_orderkey").alias("table_no")).distinct().select("table_no", F.lit(0).alias("row_no"), F.posexplode(F.array(F.lit("Part"), F.lit("Flag"), F.lit("Quantity"))).alias("col_no", "text"))
    return head.unionByName(body)


#: The same views for the oracle.
SQL = {
    "v_lines": "select doc_id, unnest(generate_series(0, len(string_split(text, chr(10)))-1))::int as line_no, unnest(string_split(text, chr(10))) as line from documents",
    "v_form": """select o_orderkey as doc_id, unnest(generate_series(0, 8))::int as line_no, unnest([
      'ORDER DATE: ' || strftime(o_orderdate, '%d/%m/%Y'),
      case when o_orderkey % 7 = 0 then 'CUST0MER NAME: ' else 'CUSTOMER NAME: ' end || c_name,
      'MARKET SEGMENT', c_mktsegment, 'TOTAL AMOUNT: RM ' || floor(o_totalprice)::bigint::varchar,
      'PRIORITY OF ORDER ' || o_orderpriority,
      case when o_orderkey % 2 = 0 then '[x] YES [ ] NO' else '[ ] YES [x] NO' end,
      'ORDER STATUS : ' || o_orderstatus, 'DISCOUNT ' || (o_orderkey % 40)::varchar || ' % GRANTED']) as line
      from orders join customer on o_custkey = c_custkey""",
    "v_dict": "select * from (values "
    + ", ".join(f"('{k}', '{''.join(c for c in a.lower() if c.isalnum())}', {i * 1000 + j})" for i, (k, names, _) in enumerate(FORM_FIELDS) for j, a in enumerate([k, *names]))
    + ") t(keyword, alias_norm, ord)",
    "v_kinds": "select * from (values " + ", ".join(f"('{k}', '{t}')" for k, _, t in FORM_FIELDS) + ") t(keyword, kind)",
    "v_grid": """select table_no, row_no, unnest([0,1,2])::int as col_no, unnest([l_partkey::varchar, l_returnflag, 'Q' || floor(l_quantity)::bigint::varchar]) as text from (select *, l_orderkey as table_no, (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice))::int as row_no from lineitem)
      union all select table_no, 0, unnest([0,1,2])::int, unnest(['Part','Flag','Quantity']) from (select distinct l_orderkey as table_no from lineitem)""",
}


def with_views(names: str, body: str) -> str:
    """A statement with the named views in front."""
    return "with " + ", ".join(f"{n} as ({SQL[n]})" for n in names.split()) + " " + body
