"""Registered queries of rules, marks, layout, schemas, signatures and renderers."""

from __future__ import annotations

from pyspark.sql import functions as F

from formweave.functions import text
from formweave.operators import layout, lines, marks, matching, rules, schema, signatures, tables
from formweave.plans.queries import _N, _NEEDLES, _SCORED, CLEAN, NORM, _values
from formweave.plans.registry import query
from formweave.plans.views import v_dict, v_form, v_grid, v_lines
from formweave.session import table
from formweave.sinks import render
from formweave.sources import dictionary

Rule = rules.Rule
RULES = [
    Rule("discount", ("DISCOUNT", "GRANTED"), "percent"),
    Rule("status", ("ORDER STATUS",), "after_colon"),
    Rule("ordered", ("ORDER DATE",), "date"),
    Rule("customer_no", ("NAME",), "identifier", argument="CUSTOMER#"),
    Rule("gift", ("PRIORITY",), "yes_no", "context"),
    Rule("express", ("PRIORITY",), "checked", "context"),
    Rule("choice", ("PRIORITY",), "option", "context", "NO"),
]
_PCT = r"case when regexp_extract({0}, '(\d+(?:\.\d+)?)\s*%', 1) <> '' then regexp_extract({0}, '(\d+(?:\.\d+)?)\s*%', 1) || '%' else '' end"
_YN = r"""case when regexp_matches(upper({0}), '\[X\]\s*YES\b|\bYES\s*\[X\]') and regexp_matches(upper({0}), '\[X\]\s*NO\b|\bNO\s*\[X\]') then 'BOTH'
  when regexp_matches(upper({0}), '\[X\]\s*YES\b|\bYES\s*\[X\]') then 'YES' when regexp_matches(upper({0}), '\[X\]\s*NO\b|\bNO\s*\[X\]') then 'NO' else '' end"""


@query(
    rf"""select doc_id, keyword, arg_max(value, line_no) as value from (
      select doc_id, line_no, 'discount' as keyword, {_PCT.format('line')} as value from v_form where contains(upper(line), 'DISCOUNT') and contains(upper(line), 'GRANTED')
      union all select doc_id, line_no, 'status', trim(substr(line, instr(line, ':') + 1)) from v_form where contains(upper(line), 'ORDER STATUS') and contains(line, ':')
      union all select doc_id, line_no, 'ordered', regexp_extract(line, '\b\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}\b', 0) from v_form where contains(upper(line), 'ORDER DATE')
      union all select doc_id, line_no, 'customer_no', regexp_extract(upper(line), 'CUSTOMER#\s*[:\-]?\s*([A-Z0-9\-]{{6,}})', 1) from v_form where contains(upper(line), 'NAME')
      union all select doc_id, line_no, 'gift', {_YN.format('ctx')} from ctx where contains(upper(ctx), 'PRIORITY')
      union all select doc_id, line_no, 'express', case when regexp_matches(line, '^\s*\[[xX]\]') then 'YES' else '' end from ctx where contains(upper(ctx), 'PRIORITY')
      union all select doc_id, line_no, 'choice', case when regexp_matches(upper(line), '\[X\]\s*NO\b') then 'NO' else '' end from ctx where contains(upper(ctx), 'PRIORITY')
    ) where value <> '' group by 1, 2""".replace("from ctx", "from (select *, string_agg(line, ' ') over (partition by doc_id order by line_no rows between 1 preceding and 1 following) as ctx from v_form)"),
    "v_form",
)
def rule_values(spark, sf):
    return rules.line_rules(v_form(spark, sf), RULES)


_SECTIONED = "select doc_id, line_no, case when line_no % 3 = 0 then (line_no // 3 + 6)::varchar || '. ' || line else line end as line from v_form"


@query(
    rf"""select doc_id, keyword, value from (select doc_id, 'express' as keyword, {_YN.format('body')} as value from s where section = 8 and contains(upper(body), 'YES')
      union all select doc_id, 'discount', {_PCT.format('body')} from s where section = 8
      union all select doc_id, 'ordered', regexp_extract(body, '\b\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}\b', 0) from s where section = 6) where value <> ''""".replace(
        "from s ", f"from (select doc_id, line_no // 3 + 6 as section, string_agg(line, chr(10) order by line_no) as body from ({_SECTIONED}) group by all) "
    ),
    "v_form",
)
def section_values(spark, sf):
    n = F.col("line_no")
    numbered = v_form(spark, sf).withColumn("line", F.when(n % 3 == 0, F.concat((F.floor(n / 3) + 6).cast("string"), F.lit(". "), "line")).otherwise(F.col("line")))
    got = [Rule("express", ("YES",), "yes_no", 8), Rule("discount", ("DISCOUNT",), "percent", 8), Rule("ordered", ("ORDER DATE",), "date", 6), Rule("absent", (), "date", 9)]
    return rules.section_rules(numbered, got)


@query(
    r"select doc_id, 'k' || (line_no % 3)::varchar as keyword, line_no, case when line_no % 3 = 0 and regexp_matches(line, '^ORDER') then '' when line_no % 3 = 1 and regexp_matches(line, '\d{5,}') then '' else trim(line) end as value from v_form",
    "v_form",
)
def sanitized_values(spark, sf):
    v = v_form(spark, sf).select("doc_id", "line_no", F.concat(F.lit("k"), (F.col("line_no") % 3).cast("string")).alias("keyword"), F.col("line").alias("value"))
    return rules.sanitize(v, [("k0", "^ORDER"), ("k1", r"\d{5,}")])


@query(
    """select doc_id, unnest(['joint', 'own', 'single']) as keyword, unnest([case when toxic = 1 and quality = 0 then 'YES' else '' end, case when quality = 1 and toxic = 0 then 'YES' else '' end, case when quality = 1 then 'YES' else '' end]) as value from labels"""
)
def exclusive_flags(spark, sf):
    yes = lambda c, other: F.when(F.col(c) == 1, "YES").otherwise(other)
    pairs = F.array(*(F.struct(F.lit(k).alias("keyword"), v.alias("value")) for k, v in [("own", yes("quality", "")), ("joint", yes("toxic", "")), ("single", yes("quality", "BOTH"))]))
    v = table(spark, sf, "labels").select("doc_id", F.explode(pairs).alias("p")).select("doc_id", "p.keyword", "p.value")
    return rules.exclusive(v, ("own", "joint"), ("single",))


_HAS = "len(list_filter({needles}, lambda p: contains({norm}, p) or (length(p) >= 8 and len(list_filter(range(1, length(p) - ceil(length(p) * 7 / 10)::int + 2), lambda i: contains({norm}, substr(p, i, ceil(length(p) * 7 / 10)::int)))) > 0))) > 0"


@query(
    "select doc_id, line_no, case "
    + " ".join(f"when {_HAS.format(needles=_NEEDLES, norm='n' + str(k))} then w{k}" for k in range(1, 5))
    + " else coalesce(w4, '') end as context from (select *, "
    + ", ".join(NORM.format(f"coalesce(w{k}, '')") + f" as n{k}" for k in range(1, 5))
    + " from (select doc_id, line_no, "
    + ", ".join(f"string_agg(line, ' ') over (partition by doc_id order by line_no rows between {k} preceding and 1 preceding) as w{k}" for k in range(1, 5))
    + " from v_lines))",
    "v_lines",
)
def lookback_contexts(spark, sf):
    return rules.lookback(v_lines(spark, sf), _NEEDLES).select("doc_id", "line_no", "context")


_OK = f"case when {CLEAN.format('line')} <> '' and not ({_N} >= 8 or ({_N} >= 5 and regexp_matches({CLEAN.format('line')}, '[.:;]$'))) then {CLEAN.format('line')} end"


@query(
    f"""select doc_id, line_no, case when a is null then '' when b is null then a when c is null then a || ' ' || b when d is null then a || ' ' || b || ' ' || c else a || ' ' || b || ' ' || c || ' ' || d end as value
    from (select doc_id, line_no, lead(ok, 1) over w as a, lead(ok, 2) over w as b, lead(ok, 3) over w as c, lead(ok, 4) over w as d from (select doc_id, line_no, {_OK} as ok from v_lines) window w as (partition by doc_id order by line_no))""",
    "v_lines",
)
def continued_values(spark, sf):
    return rules.continuation(v_lines(spark, sf), ~text.prose(F.col("line"))).select("doc_id", "line_no", "value")


@query(r"select doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)) as body from documents where text is not null")
def normalized_texts(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", text.normalize_lines(F.col("text")).alias("body"))


@query(
    """select doc_id, line_no, case when starts_with(g, '☒ ') then '- [x] ' || ltrim(substr(g, 2)) when starts_with(g, '☐ ') then '- [ ] ' || ltrim(substr(g, 2)) else g end as token
    from (select *, replace(replace(line, '[x]', '☒'), '[ ]', '☐') as g from v_form)""",
    "v_form",
)
def task_tokens(spark, sf):
    glyphs = F.replace(F.replace("line", F.lit("[x]"), F.lit("☒")), F.lit("[ ]"), F.lit("☐"))
    return v_form(spark, sf).select("doc_id", "line_no", text.task_tokens(glyphs).alias("token"))


@query("select p_partkey, printf('%.3f', greatest(0, least(100, 100.0::double * (p_size - 1) / 48))) as pct from part")
def percent_coordinates(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.percent_coordinate(F.col("p_size") - 1.0, F.lit(48.0)).alias("pct"))


@query("select doc_id, array_to_string(list_concat(w[greatest(n - 5, 1):n], w[n + 2:n + 9]), ' ') as near from (select doc_id, w, len(w) // 2 as n from (select doc_id, string_split(text, ' ') as w from documents where text is not null))")
def words_around(spark, sf):
    w = F.split("text", " ", -1)
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", w.alias("w"))
    return d.select("doc_id", text.around(F.col("w"), F.floor(F.size("w") / 2).cast("int")).alias("near"))


_FURN = f"exists (select 1 from v_dict where alias_norm = n or (length(alias_norm) >= 6 and contains(n, alias_norm) and length(alias_norm) >= 0.5 * length(n)) or (length(n) >= 8 and contains(alias_norm, n)))"


@query(
    rf"""select doc_id, line_no, furniture, length(c) < 2 or c like '%?' or regexp_matches(c, '^\d{{1,2}}$') or ({_N} >= 8 or ({_N} >= 5 and regexp_matches(c, '[.:;]$'))) or furniture
      or ({_N} - regexp_matches(c, '^\d{{1,2}}\s+')::int >= 3 and not regexp_matches(bare, '\d') and regexp_matches(bare, '[A-Z]') and not regexp_matches(bare, '[a-z]')) as form_text
    from (select *, regexp_replace(c, '^\d{{1,2}}\s+', '') as bare, n <> '' and {_FURN} as furniture from (select *, {CLEAN.format('line')} as c, {NORM.format('line')} as n from v_form))""",
    "v_form v_dict",
)
def form_texts(spark, sf):
    f = matching.furniture(v_form(spark, sf), "line", v_dict(spark)[0])
    return f.select("doc_id", "line_no", "furniture", text.form_text(F.col("line"), F.col("furniture")).alias("form_text"))


_KINDS = ["date", "percent", "identifier", "yesno", "text", "other"]


@query(
    rf"""select doc_id, line_no, kind, case when line = '' then 0.0 when line = 'BOTH' then 0.35 when kind = 'date' then case when regexp_matches(line, '\b\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}\b') then 0.95 else 0.25 end
      when kind = 'percent' then case when regexp_matches(line, '\b\d+(?:\.\d+)?%\b') then 0.95 else 0.2 end when kind = 'identifier' then case when regexp_matches(line, '(?i)\b[A-Z0-9-]{{6,}}\b') then 0.9 else 0.35 end
      when kind = 'yesno' then case when line in ('YES', 'NO') then 0.9 else 0.35 end when kind = 'text' then case when length(line) >= 3 then 0.8 else 0.3 end else 0.75 end::double as confidence
    from (select *, ({_KINDS})[(line_no + doc_id) % 6 + 1] as kind from v_form)""",
    "v_form",
)
def strict_scores(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), ((F.col("line_no") + F.col("doc_id")) % 6 + 1).cast("int"))
    return v_form(spark, sf).withColumn("kind", kind).select("doc_id", "line_no", "kind", text.score_strict(F.col("line"), F.col("kind")).alias("confidence"))


@query(
    """select doc_id, 'gift' as keyword, arg_max(value, mark_id) as value from (select doc_id, mark_id, case when contains(upper(line), 'YES') then 'YES' when contains(upper(line), 'NO') then 'NO' else '' end as value from (
      select m.doc_id, mark_id, arg_min(line, abs(y - 20 * line_no) * 1000 + line_no) as line, arg_min(ctx, abs(y - 20 * line_no) * 1000 + line_no) as ctx from (
        select doc_id, 0 as mark_id, 120 + doc_id % 5 as y from (select distinct doc_id from v_form) where doc_id % 2 = 0 union all select doc_id, 1, 100 from (select distinct doc_id from v_form)) m
      join (select *, string_agg(line, ' ') over (partition by doc_id order by line_no rows between 2 preceding and 2 following) as ctx from v_form) l on l.doc_id = m.doc_id group by 1, 2) where contains(upper(ctx), 'PRIORITY')) where value <> '' group by 1""",
    "v_form",
)
def mark_values(spark, sf):
    form = v_form(spark, sf).withColumn("cy", F.col("line_no") * 20.0)
    k = F.col("o_orderkey")
    drawn = F.array(F.struct(F.lit(0).alias("mark_id"), (k % 5 + 120.0).alias("mark_y"), (k % 2 == 0).alias("selected")), F.struct(F.lit(1).alias("mark_id"), F.lit(100.0).alias("mark_y"), F.lit(True).alias("selected")))
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    m = orders.select(k.alias("doc_id"), F.explode(drawn).alias("m")).select("doc_id", "m.*")
    return marks.selection_values(m, form, {"gift": "PRIORITY", "approved": "APPROVAL"})


_CELLS = "select doc_id, line_no, unnest(range(len(w))) as i, unnest(w) as t from (select doc_id, line_no, list_filter(string_split(" + CLEAN.format("line") + ", ' '), lambda x: x <> '') as w from v_lines)"


@query(
    f"""select doc_id, line_no, x, label, case when not ticked then '' when upper(label) in ('YES', 'NO') then upper(label) when n <= 3 then label else 'YES' end as value from (
      select doc_id, line_no, (i - i % 4) * 10.0::double as x, (i - i % 4) % 8 = 0 as ticked, string_agg(t, ' ' order by i) as label, count(*) as n from ({_CELLS}) group by 1, 2, 3, 4)""",
    "v_lines",
)
def checkbox_values(spark, sf):
    w = F.filter(F.split(text.clean_value(F.col("line")), " "), lambda x: x != "")
    cells = v_lines(spark, sf).select("doc_id", "line_no", F.posexplode(w).alias("i", "text")).withColumn("x0", F.col("i") * 10.0)
    boxes = cells.where("i % 4 = 0").select("doc_id", "line_no", F.col("x0").alias("x"), (F.col("i") % 8 == 0).alias("ticked"))
    return marks.box_values(marks.box_labels(boxes, cells, ["doc_id", "line_no"])).select("doc_id", "line_no", "x", "label", "value")


@query("select doc_id, line_no, case when length(trim(replace(replace(line, 'MARKET SEGMENT', ''), 'YES [ ] NO', ''))) < 2 then '' else line end as line from v_form", "v_form")
def cleared_values(spark, sf):
    v = v_form(spark, sf).withColumn("labels", F.array(F.lit("MARKET SEGMENT"), F.lit("YES [ ] NO"), F.lit("RM")))
    return marks.clear_unticked(v, "labels", "line").select("doc_id", "line_no", "line")


@query(
    """with recursive e as (select user_id as page, event_id, value, row_number() over (partition by user_id order by event_id) as k from events),
    walk as (select page, event_id, k, [value] as lead, 1 as group_no from e where k = 1
      union all select page, event_id, k, case when g = 0 then list_append(lead, value) else lead end, case when g = 0 then len(lead) + 1 else g end from (
        select e.page, e.event_id, e.k, e.value, w.lead, coalesce(list_position(list_transform(w.lead, lambda m: abs(m - e.value) < 8), true), 0) as g from walk w join e on e.page = w.page and e.k = w.k + 1))
    select page, event_id, group_no::int as group_no from walk"""
)
def mark_groups(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("page"), "event_id", "value")
    return marks.group_marks(e, ["page"], "value", "event_id", 8.0)


@query(
    """select doc_id, coalesce(min(abs(a - b)), 0)::int as gap from (select doc_id, unnest(case when doc_id % 3 = 0 then [7] else [null] end) as a, unnest([b, 4]) as b from (
      select doc_id, min(line_no) as b from v_form where contains(line, 'PRIORITY') group by 1)) group by 1""",
    "v_form",
)
def caption_distances(spark, sf):
    form = v_form(spark, sf)
    captions = form.where("line like '%STATUS%' and doc_id % 3 = 0")
    values = form.where("line like '%PRIORITY%' or line like '%AMOUNT%'")
    return marks.caption_gaps(captions, values, ["doc_id"], "line_no", "line_no")


@query(
    """with recursive e as (select user_id as page, event_id, value, row_number() over (partition by user_id order by value, event_id) as k from events),
    walk as (select page, k, [value] as c from e where k = 1
      union all select e.page, e.k, case when e.value - c[-1] > 6 then list_append(c, e.value) else list_append(c[1:len(c) - 1], (c[-1] + e.value) / 2) end from walk w join e on e.page = w.page and e.k = w.k + 1)
    select page, (i - 1)::int as center_no, round(c[i], 6) as center from (select page, c, unnest(range(1, len(c) + 1)) as i from (select page, arg_max(c, k) as c from walk group by 1))"""
)
def center_clusters(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("page"), "event_id", "value")
    return layout.center_clusters(e, ["page"], "value", "event_id", 6.0).withColumn("center", F.round("center", 6))


@query(
    """select o_custkey, o_orderkey, (dense_rank() over (partition by o_custkey order by g))::int as block from (select *, max((n >= 3)::int) over (partition by o_custkey, g order by o_orderkey) as s from (
      select *, sum((n < 2)::int) over (partition by o_custkey order by o_orderkey) as g from (select o_custkey, o_orderkey, count(l_orderkey) as n from orders left join lineitem on l_orderkey = o_orderkey group by 1, 2))) where s = 1 and n >= 2"""
)
def row_blocks(spark, sf):
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey").join(n, "o_orderkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return layout.row_blocks(rows, ["o_custkey"], "o_orderkey", "n").select("o_custkey", "o_orderkey", "block")


@query("select p_brand, p_partkey, coalesce(sum(length(p_name) + 1) over (partition by p_brand order by p_partkey rows between unbounded preceding and 1 preceding), 0)::int as \"offset\" from part")
def word_spans(spark, sf):
    return layout.spans(table(spark, sf, "part"), ["p_brand"], ["p_partkey"], "p_name").select("p_brand", "p_partkey", "offset")


@query(
    r"""select doc_id, term_no::int as term_no, string_agg(trim(line, ' '), ' ' order by line_no) as term from (select *, sum(regexp_matches(line, '^\s*\d{1,2}[.)]\s')::int) over (partition by doc_id order by line_no) as term_no from (
      select doc_id, line_no, case when line_no % 3 = 1 then (line_no % 90)::varchar || '. ' || line else line end as line from v_lines) where trim(line, ' ') <> '') where term_no > 0 group by 1, 2""",
    "v_lines",
)
def numbered_terms(spark, sf):
    n = F.col("line_no")
    return layout.numbered_terms(v_lines(spark, sf).withColumn("line", F.when(n % 3 == 1, F.concat((n % 90).cast("string"), F.lit(". "), "line")).otherwise(F.col("line"))))


@query(
    """select page, event_id, band from (select *, max(score) over (partition by page) as top, min(case when score = top0 then band end) over (partition by page) as first from (
      select b.*, s.score, max(s.score) over (partition by b.page) as top0 from (select page, event_id, keyword, sum(n) over (partition by page order by value, event_id)::int as band from (
        select user_id as page, event_id, event_type as keyword, value, coalesce((value - lag(value) over (partition by user_id order by value, event_id) > 10)::int, 0) as n from events)) b
      join (select page, band, count(distinct keyword) as score from (select page, keyword, sum(n) over (partition by page order by value, event_id)::int as band from (
        select user_id as page, event_id, event_type as keyword, value, coalesce((value - lag(value) over (partition by user_id order by value, event_id) > 10)::int, 0) as n from events)) group by 1, 2) s on s.page = b.page and s.band = b.band)) where band = first"""
)
def header_bands(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("page"), "event_id", F.col("event_type").alias("keyword"), "value")
    return layout.best_band(layout.gap_bands(e, ["page"], "value", "event_id", 10.0), ["page"]).select("page", "event_id", "band")


_GRID_FIELDS = [("part", ["Part Number"], "text"), ("flag", ["Return Flag"], "text"), ("quantity", ["Quantity Ordered"], "text")]


@query(
    """select table_no as page, row_no, unnest(['part', 'flag', 'quantity']) as keyword, unnest([max('P-' || text) filter (col_no = 0), max('F-' || text) filter (col_no = 1), max('C-' || text) filter (col_no = 2)]) as value
    from v_grid where row_no between 1 and 4 group by 1, 2""",
    "v_grid",
)
def geometric_tables(spark, sf):
    """Item tables drawn with a gap after the fourth row, at which they end."""
    names = F.array(F.lit("Part Number"), F.lit("Return Flag"), F.lit("Quantity Ordered"))
    label = F.element_at(names, F.col("col_no") + 1)
    body = F.concat(F.element_at(F.array(F.lit("P-"), F.lit("F-"), F.lit("C-")), F.col("col_no") + 1), "text")
    y = F.col("row_no") * 20.0 + F.when(F.col("row_no") >= 5, 200.0).otherwise(0.0)
    row_label = F.when((F.col("row_no") % 2 == 0) & (F.col("col_no") == 0), "b) ").otherwise("")
    cells = v_grid(spark, sf).select(
        F.col("table_no").alias("page"), (F.col("row_no") * 10 + F.col("col_no")).cast("bigint").alias("cell_id"), F.when(F.col("row_no") == 0, label).otherwise(F.concat(row_label, body)).alias("text"),
        (F.col("col_no") * 100.0).alias("x0"), (F.col("col_no") * 100.0 + 80).alias("x1"), y.alias("y0"), (y + 10).alias("y1"),
    )
    # beside each row a number in the gutter, a marker and a text wider than any column; beside the fourth, too far for the header's band, a repeated caption
    beside = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(t).alias("t"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, t, a, b in [(5, "101", -40.0, -2.0), (6, "c)", 10.0, 20.0), (7, "Return Flag", 110.0, 170.0), (8, "wide note", 100.0, 320.0)]))
    at = v_grid(spark, sf).where("col_no = 0 and row_no > 0").select(F.col("table_no").alias("page"), "row_no", y.alias("y0"), F.explode(beside).alias("c")).where("c.i <> 7 or row_no = 4")
    cells = cells.unionByName(at.select("page", (F.col("row_no") * 10 + F.col("c.i")).cast("bigint").alias("cell_id"), F.col("c.t").alias("text"), F.col("c.a").alias("x0"), F.col("c.b").alias("x1"), "y0", (F.col("y0") + 10).alias("y1")))
    return layout.geometric_tables(cells, dictionary.from_rows(spark, _GRID_FIELDS)[0]).select("page", "row_no", "keyword", "value")


_TEXT_FIELDS = [("part", [], "text"), ("flag", [], "text"), ("quantity", [], "text")]


@query("select table_no as doc_id, 1 as table_no, row_no, (['part', 'flag', 'quantity'])[col_no + 1] as keyword, text as value from v_grid where row_no > 0", "v_grid")
def text_tables(spark, sf):
    """Item tables written cell by cell, each on a line, under a line per caption."""
    written = v_grid(spark, sf).select(F.col("table_no").alias("doc_id"), (F.col("row_no") * 3 + F.col("col_no")).alias("line_no"), F.col("text").alias("line"))
    return layout.text_tables(written, dictionary.from_rows(spark, _TEXT_FIELDS)[0])


@query("select table_no as page, (['Part', 'Flag', 'Quantity'])[col_no + 1] as keyword, text as value from v_grid where row_no = 1", "v_grid")
def column_values(spark, sf):
    cells = v_grid(spark, sf).select(F.col("table_no").alias("page"), "row_no", (F.col("col_no") * 100.0).alias("x0"), (F.col("col_no") * 100.0 + 80).alias("x1"), "text")
    return layout.values_below(cells, "page", cells.where("row_no = 0").withColumn("keyword", F.col("text")))


_REPEATED = "select doc_id, line_no, case when line_no = 8 then 'ORDER DATE: again' else line end as line from v_form"
_LABEL = r"trim(regexp_extract(line, '^([^:]{2,}?)\s*:', 1), ' .:;,-–—_•*%/')"


@query(
    f"""select doc_id, line_no, label, case when count(*) over (partition by doc_id, label) > 1 then above else '' end as context from (select *, coalesce(
      case when length(lag(line, 1) over w) >= 8 and lag(label, 1) over w <> label then trim(lag(line, 1) over w) end, case when length(lag(line, 2) over w) >= 8 and lag(label, 2) over w <> label then trim(lag(line, 2) over w) end,
      case when length(lag(line, 3) over w) >= 8 and lag(label, 3) over w <> label then trim(lag(line, 3) over w) end, '') as above
      from (select *, {_LABEL} as label from ({_REPEATED})) window w as (partition by doc_id order by line_no)) where label <> ''""",
    "v_form",
)
def label_fields(spark, sf):
    form = v_form(spark, sf).withColumn("line", F.when(F.col("line_no") == 8, "ORDER DATE: again").otherwise(F.col("line")))
    return schema.label_fields(form)


@query(
    """select label, case when n = 1 then name else name || n::varchar end as field from (select *, row_number() over (partition by name order by o, label) as n from (
      select p_type as label, string_split(p_type, ' ')[1] as name, min(p_partkey) as o from part group by 1, 2))"""
)
def unique_names(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_type").alias("label"), F.substring_index("p_type", " ", 1).alias("name"), "p_partkey")
    return schema.unique_names(p, "label", "name", "p_partkey")


@query(
    """select p_partkey, array_to_string(list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: upper(y)), upper(x)) = i), '|') as aliases from (
      select p_partkey, [p_brand, p_type || '/' || p_brand, upper(p_brand), p_brand, p_type, p_brand, upper(p_brand)] as l from part)"""
)
def column_aliases(spark, sf):
    parts = F.array(F.col("p_brand"), F.concat_ws("/", "p_type", "p_brand"), F.upper("p_brand"), F.lit("12.50"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(schema.column_aliases(parts), "|").alias("aliases"))


@query("select table_no, 'Part,Flag,Quantity' as columns, max(row_no)::int as n_rows, max(row_no) >= 2 as accepted from v_grid group by 1", "v_grid")
def table_schemas(spark, sf):
    s = schema.table_schemas(tables.header_rows(v_grid(spark, sf), ["table_no"]), ["table_no"], 2, 2)
    return s.withColumn("columns", F.array_join("columns", ","))


@query("select p_partkey, 0 as row_no, case when p_partkey % 3 = 0 then p_name else p_brand end as label from part where p_partkey % 3 < 2")
def rejected_table_fields(spark, sf):
    k, cell = F.col("p_partkey") % 3, lambda n, c: F.struct(F.lit(n).alias("col_no"), c.cast("string").alias("text"))
    made = F.when(k == 0, F.array(cell(0, F.concat("p_name", F.lit(" : "))))).when(k == 1, F.array(cell(0, F.col("p_brand")), cell(1, F.col("p_size")))).otherwise(F.array(cell(0, F.col("p_brand")), cell(1, F.col("p_name"))))
    cells = table(spark, sf, "part").select("p_partkey", F.lit(0).alias("row_no"), F.explode(made).alias("c")).select("p_partkey", "row_no", "c.*")
    return schema.fields_of_rejected(cells, ["p_partkey"])


_BOXES = "select p_partkey // 16 as page, p_partkey as box_id, p_size * 10.0::double as x0, (p_partkey % 37) * 20.0::double as y0, p_size * 10.0::double + (p_partkey % 7) * 20 + 20 as x1, (p_partkey % 37) * 20.0::double + 40 as y1 from part"
_BLOCKS = "select c_custkey // 16 as page, c_name as text, (c_custkey % 60) * 10.0::double as x0, (c_custkey % 41) * 20.0::double as y0, (c_custkey % 60) * 10.0::double + 100 as x1, (c_custkey % 41) * 20.0::double + 20 as y1, case when c_custkey % 3 = 0 then 0.97 else 0.5 end as score from customer"
_KEPT = f"""select * from ({_BOXES}) b where (x1 - x0) * (y1 - y0) / 1000000 >= 0.005 and not exists (select 1 from ({_BLOCKS}) t where t.page = b.page and t.score >= 0.95
  and greatest(0, least(b.x1, t.x1) - greatest(b.x0, t.x0)) * greatest(0, least(b.y1, t.y1) - greatest(b.y0, t.y0))
    >= 0.2 * greatest(1, (b.x1 - b.x0) * (b.y1 - b.y0) + (t.x1 - t.x0) * (t.y1 - t.y0) - greatest(0, least(b.x1, t.x1) - greatest(b.x0, t.x0)) * greatest(0, least(b.y1, t.y1) - greatest(b.y0, t.y0))))"""
_SLUG = "regexp_replace(replace({}, ' ', '_'), '[^a-zA-Z0-9_]', '', 'g')"
_SIGNED = f"""select b.page, b.box_id, b.x0, b.y0, coalesce(t.signer, 'Unknown_Signer') as signer from ({_KEPT}) b left join (select page, box_id, signer from (select b.page, b.box_id, {_SLUG.format('t.text')} as signer,
  row_number() over (partition by b.page, b.box_id order by sqrt(((t.x0 + t.x1) / 2 - (b.x0 + b.x1) / 2) ** 2 + (t.y0 - b.y1) ** 2), t.text) as r
  from ({_BOXES}) b join ({_BLOCKS}) t on t.page = b.page and t.y0 >= b.y0 - 30 and t.y0 <= b.y1 + 250 and abs((t.x0 + t.x1) / 2 - (b.x0 + b.x1) / 2) < 400) where r = 1) t on t.page = b.page and t.box_id = b.box_id"""


def _boxes(spark, sf):
    x, y, k = F.col("p_size") * 10.0, (F.col("p_partkey") % 37) * 20.0, F.col("p_partkey")
    return table(spark, sf, "part").select(F.floor(k / 16).alias("page"), k.alias("box_id"), x.alias("x0"), y.alias("y0"), (x + (k % 7) * 20 + 20).alias("x1"), (y + 40).alias("y1"), F.lit(1000.0).alias("page_width"), F.lit(1000.0).alias("page_height"))


def _blocks(spark, sf):
    k = F.col("c_custkey")
    x, y = (k % 60) * 10.0, (k % 41) * 20.0
    return table(spark, sf, "customer").select(F.floor(k / 16).alias("page"), F.col("c_name").alias("text"), x.alias("x0"), y.alias("y0"), (x + 100).alias("x1"), (y + 20).alias("y1"), F.when(k % 3 == 0, 0.97).otherwise(0.5).alias("score"))


@query(f"select page, box_id from ({_KEPT})")
def signature_boxes(spark, sf):
    return signatures.not_printed(signatures.large_enough(_boxes(spark, sf)), _blocks(spark, sf), ["page"]).select("page", "box_id")


@query(f"select page, box_id, signer from ({_SIGNED})")
def signature_signers(spark, sf):
    kept = signatures.not_printed(signatures.large_enough(_boxes(spark, sf)), _blocks(spark, sf), ["page"])
    return signatures.signers(kept, _blocks(spark, sf), ["page"])


_TITLES = """select page, coalesce(arg_min(substr(regexp_replace(replace(text, ' ', '_'), '[^A-Za-z0-9_]', '', 'g'), 1, 25), r) filter (length(text) > 4 and not regexp_matches(text, '^\\d+$')), 'Untitled') as title
  from (select c_custkey // 16 as page, c_name as text, row_number() over (partition by c_custkey // 16 order by (c_custkey % 41) * 20, c_name) as r from customer) where r <= 3 group by 1"""


@query(_TITLES)
def page_titles(spark, sf):
    return signatures.titles(_blocks(spark, sf), ["page"])


@query(f"select s.page, box_id, title || '_p' || s.page::varchar || '_' || signer || '_sig' || (row_number() over (partition by s.page order by box_id))::varchar || '.png' as file_name from ({_SIGNED}) s join ({_TITLES}) t on t.page = s.page")
def signature_files(spark, sf):
    blocks = _blocks(spark, sf)
    kept = signatures.not_printed(signatures.large_enough(_boxes(spark, sf)), blocks, ["page"])
    signed = kept.join(signatures.signers(kept, blocks, ["page"]), ["page", "box_id"]).join(signatures.titles(blocks, ["page"]), "page")
    return signatures.file_names(signed, ["page"]).select("page", "box_id", "file_name")


@query(f"""select doc_id, '{{' || string_agg('"' || keyword || '":"' || value || '"', ',' order by keyword) || '}}' as payload from ({_SCORED}) group by 1""", "v_form v_dict v_kinds")
def field_json(spark, sf):
    return render.field_json(_values(spark, sf))


@query(
    f"""select f.doc_id, c_name || chr(10) || chr(10) || body as body from (select doc_id, string_agg('- ' || keyword || ': ' || case when trim(value) = '' then 'NOT FOUND' else value end, chr(10) order by keyword) as body from ({_SCORED}) group by 1) f
    join orders on o_orderkey = f.doc_id join customer on c_custkey = o_custkey""",
    "v_form v_dict v_kinds",
)
def content_markdown(spark, sf):
    docs = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("doc_id"), "c_name")
    return render.content_markdown(docs, _values(spark, sf), "c_name")


@query(
    f"""select doc_id, '## Fields' || chr(10) || coalesce(string_agg('- **' || keyword || '**: ' || replace(value, '|', '\\|'), chr(10) order by keyword) filter (value <> ''), 'No field was found.')
      || coalesce(chr(10) || '## Details' || chr(10) || '| Field | Value | Confidence |' || chr(10) || '| --- | --- | --- |' || chr(10)
        || string_agg('| ' || keyword || ' | ' || replace(value, '|', '\\|') || ' | ' || printf('%.2f', confidence) || ' |', chr(10) order by keyword) filter (value <> '' and confidence >= 0.7), '')
      || coalesce(chr(10) || '## Unmatched' || chr(10) || string_agg(keyword, ', ' order by keyword) filter (value = ''), '') as body from ({_SCORED}) group by 1""",
    "v_form v_dict v_kinds",
)
def field_markdown(spark, sf):
    return render.field_markdown(_values(spark, sf))


@query(
    f"""select doc_id, '<table>' || coalesce(string_agg('<tr><th>' || keyword || '</th><td>' || replace(replace(replace(replace(replace(value, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') || '</td></tr>', '' order by keyword) filter (value <> ''), '') || '</table>' as body
    from ({_SCORED}) group by 1""",
    "v_form v_dict v_kinds",
)
def field_html(spark, sf):
    return render.field_html(_values(spark, sf))


@query(
    """select table_no, '| Part | Flag | Quantity |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg(line, chr(10) order by row_no) as body from (
      select table_no, row_no, '| ' || string_agg(text, ' | ' order by col_no) || ' |' as line from v_grid where row_no > 0 group by 1, 2) group by 1""",
    "v_grid",
)
def table_markdown(spark, sf):
    return render.table_markdown(v_grid(spark, sf), ["table_no"])


@query("select doc_id, lines.line_no, origin, line from (select doc_id, line_no, 0 as origin, line from v_form union all select doc_id, line_no, 1, upper(line) from v_form) lines", "v_form")
def page_text(spark, sf):
    """Layout lines and then recognised lines of a page: a bag, repeated lines stay."""
    form = v_form(spark, sf)
    return lines.all_lines(form, form.withColumn("line", F.upper("line")))
