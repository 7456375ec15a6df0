"""Registered queries of the document operators, each with the statement that checks it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from formweave.functions import text
from formweave.operators import fields, geometry, images, lines, matching, tables
from formweave.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from formweave.plans.views import v_dict, v_form, v_grid, v_lines
from formweave.session import table

NORM = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')"
CLEAN = r"trim(regexp_replace(coalesce({}, ''), '\s+', ' ', 'g'))"


@query(f"select doc_id, line_no, {NORM.format('line')} as label from v_lines", "v_lines")
def normalize_labels(spark, sf):
    return v_lines(spark, sf).select("doc_id", "line_no", text.normalize_label(F.col("line")).alias("label"))


@query(f"select doc_id, line_no, {CLEAN.format('line')} as value, trim({CLEAN.format('line')}, ' :;-_.•%*─—–') as stripped from v_lines", "v_lines")
def clean_values(spark, sf):
    return v_lines(spark, sf).select("doc_id", "line_no", text.clean_value(F.col("line")).alias("value"), text.strip_edges(F.col("line")).alias("stripped"))


@query(
    r"""select doc_id, line_no, case when regexp_extract(line, '(\d+(?:\.\d+)?)\s*%', 1) <> '' then regexp_extract(line, '(\d+(?:\.\d+)?)\s*%', 1) || '%' else '' end as pct,
    regexp_extract(line, '\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b', 0) as day from v_form""",
    "v_form",
)
def percents_and_dates(spark, sf):
    return v_form(spark, sf).select("doc_id", "line_no", text.percent(F.col("line")).alias("pct"), text.date(F.col("line")).alias("day"))


_WORDS = "list_filter(string_split_regex(p_name, '[^A-Za-z0-9]+'), lambda w: w <> '')"


@query(f"select p_partkey, array_to_string(list_transform({_WORDS}, lambda w: upper(w[1:1]) || lower(w[2:])), '') as camel from part")
def camel_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.camel_name(F.col("p_name")).alias("camel"))


@query(
    """select p_partkey, case when contains(p_brand, ' ') then p_brand || '/' || p_type || '|' || p_brand || case when contains(p_type, ' ') then '|' || p_type else '' end
    when contains(p_type, ' ') then p_brand || '/' || p_type || '|' || p_type else p_brand || '|' || p_type end as aliases from part"""
)
def slash_aliases(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(text.slash_aliases(F.concat_ws("/", "p_brand", "p_type")), "|").alias("aliases"))


_N = f"len(list_filter(string_split({CLEAN.format('line')}, ' '), lambda w: w <> ''))"


@query(
    rf"""select doc_id, line_no, {CLEAN.format('line')} <> '' and not starts_with(line, '#') and {NORM.format('line')} not in ('', 'yesno') as informative,
    {_N} >= 8 or ({_N} >= 5 and regexp_matches({CLEAN.format('line')}, '[.:;]$')) as prose,
    trim(trim({CLEAN.format('line')}, ':')) = '' or not regexp_matches({CLEAN.format('line')}, '[A-Za-z]') or regexp_matches(trim(trim({CLEAN.format('line')}, ':')), '(?i)^(?:RM|MYR|USD|SGD|\$)\s*[\d.,]+$') as value_like,
    length(trim({CLEAN.format('line')}, ' .:-')) < 3 or length({NORM.format("regexp_replace(upper(line), '\\b(?:YES|NO)\\b', '', 'g')")}) < 3 as noise,
    case when regexp_matches(upper(line), '\bDATE\b|DD[-/]MM|MM[-/]YY|\bDOB\b|\bBIRTH\b') then 'date' when regexp_matches(upper(line), '\bSIGNATURE\b') then 'signature'
    when regexp_matches(upper(line), '\bNO\.|NUMBER\b|\bAMOUNT\b|\bRM\b|\bCODE\b|%') then 'number' else 'text' end as kind from v_form""",
    "v_form",
)
def line_classes(spark, sf):
    c = F.col("line")
    return v_form(spark, sf).select(
        "doc_id", "line_no", text.informative(c).alias("informative"), text.prose(c).alias("prose"), text.value_like(c).alias("value_like"), text.option_noise(c).alias("noise"), text.text_type(c).alias("kind")
    )


@query("select doc_id, line_no, case when line_no <> 6 then '' when doc_id % 2 = 0 then 'YES' else 'BOTH' end as answer from v_form", "v_form")
def yes_no_marks(spark, sf):
    """The unticked box of the odd forms stands before YES, the ticked one between both words."""
    return v_form(spark, sf).select("doc_id", "line_no", text.yes_no(F.col("line")).alias("answer"))


@query("select doc_id, line_no, string_agg(line, ' ') over (partition by doc_id order by line_no rows between 2 preceding and 2 following) as context from v_form", "v_form")
def context_windows(spark, sf):
    return lines.context_window(v_form(spark, sf)).select("doc_id", "line_no", "context")


@query(
    r"""select doc_id, line_no, coalesce(lead(ok, 1) over w, lead(ok, 2) over w, lead(ok, 3) over w, lead(ok, 4) over w, '') as value from (
    select *, case when trim(line) <> '' and not starts_with(line, '#') and not regexp_matches(line, '^\d+[.)]\s') and not contains(line, ':') then trim(line) end as ok from v_form)
    window w as (partition by doc_id order by line_no)""",
    "v_form",
)
def next_values(spark, sf):
    return lines.next_value(v_form(spark, sf)).select("doc_id", "line_no", "value")


@query(
    r"""select doc_id, section::int as section, max(first_line)::int as first_line, arg_max(last_line, first_line)::int as last_line from (
    select doc_id, regexp_extract(line, '^\s*#?\s*(\d{1,2})[.)\- ]', 1) as section, line_no as first_line,
      coalesce(lead(line_no) over (partition by doc_id order by line_no) - 1, m) as last_line
    from (select *, max(line_no) over (partition by doc_id) as m from numbered) where regexp_extract(line, '^\s*#?\s*(\d{1,2})[.)\- ]', 1) <> '') group by all""".replace(
        "from numbered", "from (select doc_id, line_no, case when line_no % 3 = 0 then (line_no % 12)::varchar || '. ' || line else line end as line from v_lines) numbered"
    ),
    "v_lines",
)
def section_ranges(spark, sf):
    numbered = v_lines(spark, sf).withColumn("line", F.when(F.col("line_no") % 3 == 0, F.concat((F.col("line_no") % 12).cast("string"), F.lit(". "), "line")).otherwise(F.col("line")))
    return lines.section_ranges(numbered)


_PRE = "select doc_id, line_no, k as n_words, " + NORM.format("array_to_string(w[1:k], ' ')") + " as p, array_to_string(w[k+1:], ' ') as rest from (select doc_id, line_no, w, unnest(generate_series(1, least(6, len(w)))) as k from (select *, list_filter(string_split(" + CLEAN.format("line") + ", ' '), lambda x: x <> '') as w from v_form))"


@query(
    f"select doc_id, line_no, arg_max(keyword, n_words) as keyword, max(n_words)::int as n_words, arg_max(rest, n_words) as rest from ({_PRE}) join (select alias_norm, arg_min(keyword, ord) as keyword from v_dict group by 1) on p = alias_norm group by 1, 2",
    "v_form v_dict",
)
def prefix_match(spark, sf):
    return lines.longest_prefix(v_form(spark, sf), v_dict(spark)[0])


_NEEDLES = ["therhean", "andthethat", "nichtundder", "ofthethe", "delaque"]


@query(
    f"""select doc_id, needle from (select doc_id, {NORM.format('text')} as v from documents), (select unnest({_NEEDLES}) as needle)
    where contains(v, needle) or (length(needle) >= 8 and len(list_filter(range(1, length(needle) - ceil(length(needle) * 7 / 10)::int + 2), lambda i: contains(v, substr(needle, i, ceil(length(needle) * 7 / 10)::int)))) > 0)"""
)
def context_match(spark, sf):
    needles = F.filter(F.array(*map(F.lit, _NEEDLES)), lambda n: text.has_context(F.col("v"), n))
    return table(spark, sf, "documents").select("doc_id", text.normalize_label(F.col("text")).alias("v")).select("doc_id", F.explode(needles).alias("needle"))


@query(
    f"select doc_id, line_no, keyword, max(length(alias_norm))::int as alias_length from v_form join v_dict on length(alias_norm) >= 6 and contains({NORM.format('line')}, alias_norm) group by 1, 2, 3", "v_form v_dict"
)
def substring_match(spark, sf):
    return matching.contained(v_form(spark, sf).select("doc_id", "line_no", "line"), "line", v_dict(spark)[0]).select("doc_id", "line_no", "keyword", "alias_length")


@query(
    f"""select doc_id, line_no, arg_max(keyword, length(alias_norm) * 100000 - ord) as keyword from (select *, {NORM.format('line')} as n from v_form) join v_dict on length(alias_norm) >= 6 and length(n) >= 6
    and (contains(n, alias_norm) or contains(alias_norm, n)) and least(length(n), length(alias_norm)) / greatest(length(n), length(alias_norm)) >= 0.5 group by 1, 2""",
    "v_form v_dict",
)
def coverage_match(spark, sf):
    return matching.covered(v_form(spark, sf).select("doc_id", "line_no", "line"), "line", v_dict(spark)[0]).select("doc_id", "line_no", "keyword")


@query()
def fuzzy_match(spark, sf):
    heads = v_form(spark, sf).where("line like '%:%'").withColumn("head", text.before_colon(F.col("line")))
    return matching.fuzzy(heads, "head", v_dict(spark)[0]).select("label_norm", "keyword", F.round("score", 6).alias("score"))


@query()
def row_clusters(spark, sf):
    return geometry.cluster_rows(_boxes(spark, sf).withColumn("tol", F.lit(8.0)), ["page"], "value", "event_id", "tol").select("page", "event_id", "row_no")


ORACLES["row_clusters"] = """with recursive e as (select user_id as page, event_id, value, row_number() over (partition by user_id order by value, event_id) as k from events),
walk as (select page, event_id, k, value as m, 1 as n, 1 as row_no from e where k = 1
  union all select e.page, e.event_id, e.k, case when abs(e.value - w.m) <= 8 then (w.m * w.n + e.value) / (w.n + 1) else e.value end,
    case when abs(e.value - w.m) <= 8 then w.n + 1 else 1 end, case when abs(e.value - w.m) <= 8 then w.row_no else w.row_no + 1 end
  from walk w join e on e.page = w.page and e.k = w.k + 1)
select page, event_id, row_no from walk"""


def _boxes(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("page"), "event_id", "value")


@query(
    """select page, event_id, sum(n) over (partition by page order by value, event_id)::int as segment from (
    select user_id as page, event_id, value, coalesce((value - lag(value) over (partition by user_id order by value, event_id) > 5)::int, 0) as n from events)"""
)
def gap_segments(spark, sf):
    return geometry.gap_segments(_boxes(spark, sf), ["page"], ["value", "event_id"], "value", "value", 5.0).select("page", "event_id", "segment")


@query(
    """select page, event_id, sum(n) over (partition by page order by value, event_id)::int as cluster from (select *, coalesce((value > max(x1) over (partition by page order by value, event_id rows between unbounded preceding and 1 preceding))::int, 0) as n
    from (select user_id as page, event_id, value, value + (event_id % 9) as x1 from events))"""
)
def overlap_clusters(spark, sf):
    b = _boxes(spark, sf).withColumn("x1", F.col("value") + F.col("event_id") % 9)
    return geometry.overlap_clusters(b, ["page"], ["value", "event_id"], "value", "x1").select("page", "event_id", "cluster")


@query(
    """select page, event_id from (select *, count(*) over (partition by page, run) as c from (select *, sum(n) over (partition by page order by value, event_id) as run from (
    select user_id as page, event_id, value, coalesce((value - lag(value) over (partition by user_id order by value, event_id) > 3.6)::int, 0) as n from events))) where c < 3"""
)
def comb_runs(spark, sf):
    return geometry.comb_runs(_boxes(spark, sf), ["page"], "value", "event_id", 2.0).select("page", "event_id")


@query(
    """select event_id, arg_min(line_no, line_no) filter (d = best)::int as line_no from (select *, min(d) over (partition by event_id) as best from (
    select event_id, line_no, abs(value - line_no * 20) as d from events join v_lines on user_id = doc_id)) where best <= 50 group by 1
    union all select event_id, null from events where not exists (select 1 from v_lines where doc_id = user_id and abs(value - line_no * 20) <= 50)""",
    "v_lines",
)
def nearest_lines(spark, sf):
    held = v_lines(spark, sf).select(F.col("doc_id").alias("page"), "line_no", (F.col("line_no") * 20.0).alias("cy"))
    marks = _boxes(spark, sf).select("page", "event_id", "value")
    return geometry.nearest_line(marks, held, ["page"], "event_id", "value", "line_no", "cy", 50.0).select("event_id", "line_no")


_COLS = [(k, k * 20.0, k * 20.0 + 24.0) for k in range(6)]


@query(
    f"""select event_id, arg_max(col_no, o * 1000000 - col_no)::int as col_no from (select event_id, c.col_no, round(least(value + 9, c.b) - greatest(value, c.a), 6) as o
    from events join (values {', '.join(str(c) for c in _COLS)}) c(col_no, a, b) on least(value + 9, c.b) - greatest(value, c.a) > 0) group by 1"""
)
def cell_assignment(spark, sf):
    columns = spark.createDataFrame(_COLS, "col_no int, cx0 double, cx1 double").withColumn("t", F.lit(0))
    cells = _boxes(spark, sf).select("event_id", F.col("value").alias("x0"), (F.col("value") + 9).alias("x1"), F.lit(0).alias("t"))
    return geometry.assign_columns(cells, columns, ["t"], ["event_id"]).select("event_id", "col_no")


@query(
    """select e.event_id, max(o.event_id) filter (o.ts = best) as heading from (select e.event_id, e.user_id, max(o.ts) as best from events e left join events o on o.user_id = e.user_id and o.event_type = 'purchase' and o.ts <= e.ts
    group by all) e left join events o on o.user_id = e.user_id and o.event_type = 'purchase' and o.ts = e.best group by 1"""
)
def heading_as_of(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    heads = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("h_ts"), F.col("event_id").alias("heading"))
    return geometry.as_of(e.select("event_id", "user_id", "ts"), heads, ["user_id"], "ts", "h_ts", "heading").select("event_id", "heading")


@query("select table_no, row_no, col_no, row_no = 0 as is_header from v_grid", "v_grid")
def header_rows(spark, sf):
    return tables.header_rows(v_grid(spark, sf), ["table_no"]).select("table_no", "row_no", "col_no", "is_header")


@query("select table_no, row_no, max(text) filter (col_no = 0) as part, max(text) filter (col_no = 1) as flag, max(text) filter (col_no = 2) as quantity from v_grid where row_no > 0 group by 1, 2", "v_grid")
def table_records(spark, sf):
    r = tables.records(tables.header_rows(v_grid(spark, sf), ["table_no"]), ["table_no"])
    return r.select("table_no", "row_no", F.col("record")["Part"].alias("part"), F.col("record")["Flag"].alias("flag"), F.col("record")["Quantity"].alias("quantity"))


@query("select page_id, 0 as row_no, 0 as col_no, url as text from pages union all select page_id, 0, 1, url from pages union all select page_id, 1, 0, 'id' from pages union all select page_id, 1, 1, page_id::varchar from pages")
def html_grid(spark, sf):
    html = F.concat(F.lit("<table><tr><td colspan=2>"), F.regexp_replace("url", "&", "&amp;"), F.lit("</td></tr><tr><th>id</th><td>"), F.col("page_id").cast("string"), F.lit("</td></tr></table>"))
    return tables.html_cells(table(spark, sf, "pages").select("page_id", html.alias("html")), "page_id", "html")


@query()
def subsumed_tables(spark, sf):
    """Orders' item tables that are part of a larger one of the same customer."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = li.select("o_custkey", "l_orderkey", F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("status"), F.col("l_linestatus")).alias("r"))
    packed = rows.groupBy("o_custkey", "l_orderkey").agg(F.to_json(F.collect_list("r")).alias("rows"), F.count("*").alias("n_rows"))

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        import json

        t = pd.DataFrame({"name": pdf["l_orderkey"], "n_rows": pdf["n_rows"], "rows": pdf["rows"].map(json.loads), "columns": [["flag", "status"]] * len(pdf)}).sort_values("name")
        gone = tables.subsumed(t)
        return pd.DataFrame({"o_custkey": pdf["o_custkey"].iloc[0], "l_orderkey": gone["name"].astype("int64")})

    return packed.groupBy("o_custkey").applyInPandas(part, "o_custkey bigint, l_orderkey bigint")


_BOX = "p_partkey, p_size * 3.0 as x0, (p_partkey % 50) * 2.0 as y0, p_size * 3.0 + 20 as x1, (p_partkey % 50) * 2.0 + 10 as y1"


@query(
    f"""select p_partkey, round(i / greatest(1, 600 - i), 6) as iou from (select p_partkey, greatest(0, least(x1, 80) - greatest(x0, 60)) * greatest(0, least(y1, 40) - greatest(y0, 20)) as i from (select {_BOX} from part))
    where i / greatest(1, 600 - i) >= 0.2"""
)
def printed_text_overlap(spark, sf):
    b = table(spark, sf, "part").selectExpr(*[c.strip() for c in _BOX.split(", ")])
    v = geometry.iou((F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")), tuple(map(F.lit, (60.0, 20.0, 80.0, 40.0))))
    return b.withColumn("v", v).where("v >= 0.2").select("p_partkey", F.round("v", 6).alias("iou"))


@query("select p_type as label, count(*) as n from part group by 1 having count(*) > 1")
def duplicate_labels(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_type").alias("label")).agg(F.count("*").alias("n")).where("n > 1")


@query("select p_brand, arg_max(prefix, n * 1000000 - first) as prefix from (select p_brand, string_split(p_name, ' ')[1] as prefix, count(*) as n, min(p_partkey) as first from part group by 1, 2) group by 1")
def dominant_prefix(spark, sf):
    p = table(spark, sf, "part").groupBy("p_brand", F.substring_index("p_name", " ", 1).alias("prefix")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))
    return p.groupBy("p_brand").agg(F.max_by("prefix", F.struct("n", -F.col("first"))).alias("prefix"))


@query("select event_type, round(avg(value), 4) as mean, min(value) as low, max(value) as high, count(*) as n, median(value) as mid from events group by 1")
def confidence_stats(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"), F.median("value").alias("mid"))


_FIELDS = f"""select d.doc_id, k.keyword, k.kind, coalesce(v.value, '') as value from (select distinct doc_id from v_form) d, v_kinds k left join (
  select doc_id, keyword, arg_min(value, p * 1000 + line_no) as value from (
    select doc_id, line_no, keyword, case when rest <> '' then rest else nxt end as value, case when rest <> '' then 0 else 1 end as p from (
      select *, trim(case when contains(line, ':') then substr(line, instr(line, ':') + 1) else '' end) as rest, {NORM.format("string_split(line, ':')[1]")} as n,
        coalesce(lead(ok, 1) over w, lead(ok, 2) over w, lead(ok, 3) over w, lead(ok, 4) over w, '') as nxt
      from (select *, case when trim(line) <> '' and not starts_with(line, '#') and not regexp_matches(line, '^\\d+[.)]\\s') and not contains(line, ':') and {NORM.format('line')} not in (select alias_norm from v_dict) then trim(line) end as ok from v_form)
      window w as (partition by doc_id order by line_no)) join (select alias_norm, arg_min(keyword, ord) as keyword from v_dict group by 1) a on n = alias_norm
    union all select doc_id, line_no, arg_max(keyword, n_words), arg_max(rest, n_words), 2 from ({_PRE}) join (select alias_norm, arg_min(keyword, ord) as keyword from v_dict group by 1) on p = alias_norm group by 1, 2
  ) where value <> '' group by 1, 2) v on v.doc_id = d.doc_id and v.keyword = k.keyword"""
_SCORED = f"""select *, case when value = '' then 0.0 when kind = 'date' then case when regexp_matches(value, '\\b\\d{{1,2}}[-/]\\d{{1,2}}[-/]\\d{{2,4}}\\b|\\b\\d{{4}}[-/]\\d{{1,2}}[-/]\\d{{1,2}}\\b') then 0.95 else 0.3 end
  when kind = 'number' then case when regexp_matches(value, '\\b\\d+(?:[.,]\\d+)?\\b') then 0.9 else 0.3 end when kind = 'signature' then case when length(value) >= 2 then 0.8 else 0.2 end
  when length(value) >= 3 then 0.8 else 0.4 end::double as confidence from ({_FIELDS})"""


def _values(spark, sf):
    form, (aliases, kinds) = v_form(spark, sf), v_dict(spark)
    got = fields.merge(fields.from_lines(form, aliases))
    return fields.score(fields.canonical(got, table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("doc_id")), kinds), kinds)


@query(f"select doc_id, keyword, value from ({_FIELDS})", "v_form v_dict v_kinds")
def field_values(spark, sf):
    return _values(spark, sf).select("doc_id", "keyword", "value")


@query(f"select doc_id, keyword, value, kind, confidence, case when value <> '' then 'matched' else 'not-found' end as source from ({_SCORED})", "v_form v_dict v_kinds")
def field_scores(spark, sf):
    return _values(spark, sf).select("doc_id", "keyword", "value", "kind", "confidence", "source")


@query(f"select doc_id, keyword, value from ({_SCORED}) where value <> '' and confidence >= 0.8", "v_form v_dict v_kinds")
def strict_fields(spark, sf):
    return _values(spark, sf).where("strict").select("doc_id", "keyword", "value")


@query(f"select doc_id, array_to_string(list_sort(list(keyword)), ',') as missing from ({_FIELDS}) where value = '' group by 1", "v_form v_dict v_kinds")
def unmatched_keywords(spark, sf):
    return _values(spark, sf).where("value = ''").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("keyword")), ",").alias("missing"))


@query("select doc_id, quality = 1 as ticked from labels")
def tick_raster(spark, sf):
    """Draws a box per label, with a cross where quality is 1, and reads it back."""

    def rows(batches):
        for b in batches:
            out = []
            for q in b["quality"]:
                g = np.full((64, 64), 255, np.uint8)
                g[16:48, [16, 47]] = 0
                g[[16, 47], 16:48] = 0
                if q == 1:
                    for d in range(-1, 2):
                        np.fill_diagonal(g[20 + max(d, 0) : 44, 20 - min(d, 0) : 44], 0)
                out.append(images.ticked(g, 0.5, 0.5, 0.5))
            yield pd.DataFrame({"doc_id": b["doc_id"], "ticked": out})

    return table(spark, sf, "labels").select("doc_id", "quality").mapInPandas(rows, "doc_id bigint, ticked boolean")

