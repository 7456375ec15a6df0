"""Registered queries of words with boxes: lines, cells, answers and fields of marks. Results are stated by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formweave.operators import geometry, layout, words
from formweave.plans.registry import query
from formweave.session import table

_DOCS = "select c_custkey as doc_id, c_custkey % 6 as k, c_name from customer"


def _docs(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), (F.col("c_custkey") % 6).alias("k"), "c_name")


def _words(docs: DataFrame, rows: list[tuple[int, float, Column | str]]) -> DataFrame:
    """Words of page rows, a tenth of the page wide and a fiftieth high; every second one is printed a little lower."""
    made = F.array(*(F.struct(F.lit(p).alias("page_no"), F.lit(y).alias("y"), F.lit(i * 100).alias("o"), (F.lit(t) if isinstance(t, str) else t).alias("t")) for i, (p, y, t) in enumerate(rows)))
    held = docs.select("doc_id", F.explode(made).alias("r")).select("doc_id", "r.*", F.posexplode(F.split("r.t", " ")).alias("i", "text"))
    x0, low = F.col("i") * 0.1 + 0.02, F.col("y") + (F.col("i") % 2) * 0.002
    return held.select("doc_id", "page_no", (F.col("o") + F.col("i")).alias("word_no"), "text", x0.alias("x0"), (low - 0.01).alias("y0"), (x0 + 0.08).alias("x1"), (low + 0.01).alias("y1"))


def _marks(docs: DataFrame, rows: list[tuple[int, float, float, Column | None]]) -> DataFrame:
    """Marks (page, centre) where the condition holds."""
    made = F.array(*(F.when(F.lit(True) if on is None else on, F.struct(F.lit(p).alias("page_no"), F.lit(i).alias("mark_no"), F.lit(x).alias("cx"), F.lit(y).alias("cy"))) for i, (p, x, y, on) in enumerate(rows)))
    return docs.select("doc_id", F.explode(F.filter(made, lambda m: m.isNotNull())).alias("m")).select("doc_id", "m.*")


def _form_words(spark, sf) -> DataFrame:
    return _words(_docs(spark, sf), [(1, 0.30, "left and right"), (1, 0.10, "* NAME OF BORROWER/"), (1, 0.14, F.col("c_name")), (2, 0.10, "last")])


@query(
    f"""select doc_id, unnest([1, 1, 1, 2]) as page_no, unnest([0, 1, 2, 0]) as line_no, unnest(['* NAME OF BORROWER/', c_name, 'left and right', 'last']) as line, 0.02::double as median_h,
      unnest([0.101, 0.14, 0.300667, 0.1])::double as cy from ({_DOCS})"""
)
def page_line_index(spark, sf):
    """Lines of all pages from their words; words without a text or a box do not count."""
    held, even = _form_words(spark, sf), F.col("word_no") % 2 == 0
    no_text = held.where(even).withColumn("text", F.lit(" "))
    no_box = held.where(~even).withColumn("y0", F.lit(None).cast("double"))
    lines = words.page_lines(held.unionByName(no_text).unionByName(no_box), ["doc_id", "page_no"])
    return lines.select("doc_id", "page_no", "line_no", "line", F.round("median_h", 6).alias("median_h"), F.round("cy", 6).alias("cy"))


@query(f"select doc_id, 7 as cell_no, unnest([0, 1]) as line_no, unnest(['NAME OF BORROWER/', c_name]) as line from ({_DOCS})")
def cell_text_lines(spark, sf):
    docs = _docs(spark, sf)
    cells = docs.select("doc_id", F.lit(1).alias("page_no"), F.lit(7).alias("cell_no"), F.lit(0.0).alias("x0"), F.lit(0.05).alias("y0"), F.lit(1.0).alias("x1"), F.lit(0.2).alias("y1"))
    return words.cell_lines(cells, _form_words(spark, sf), ["doc_id", "page_no"]).select("doc_id", "cell_no", "line_no", "line")


@query(f"select doc_id, unnest(['left', 'last']) as outside, unnest(['and', 'right']) as inside from ({_DOCS})")
def words_by_region(spark, sf):
    """Words within and without two regions of a page, edges included; regions of one page say nothing of another."""
    docs, page = _docs(spark, sf), ["doc_id", "page_no"]
    regions = docs.select("doc_id", F.lit(1).alias("page_no"), F.explode(F.expr("array(struct(0d as x0, 0d as y0, 1d as x1, 0.2d as y1), struct(0.16d as x0, 0.2d as y0, 0.9d as x1, 1d as y1))")).alias("r")).select(*page, "r.*")
    held = words.page_words(_form_words(spark, sf), page)
    out = geometry.inside(held, regions, page, False).select("doc_id", F.when(F.col("page_no") == 1, 0).otherwise(1).alias("n"), F.col("text").alias("outside"))
    within = geometry.inside(held, regions, page).where("word_no < 100 and page_no = 1").select("doc_id", (F.col("word_no") - 1).alias("n"), F.col("text").alias("inside"))
    return out.join(within, ["doc_id", "n"]).select("doc_id", "outside", "inside")


_RULES = [
    words.MarkRule("wants_mail", ("RECEIVE MAIL",)), words.MarkRule("exposed", ("EXPOSED", "PERSON"), "YES"),
    words.MarkRule("document", ("FORM A",), "FORM A"), words.MarkRule("document", ("FORM B",), "FORM B"),
]


@query(
    f"""select doc_id, 'wants_mail' as keyword, case when k % 2 = 0 then 'YES' else 'NO' end as value from ({_DOCS}) union all select doc_id, 'exposed', 'YES' from ({_DOCS}) where k % 3 = 0
    union all select doc_id, 'document', case when k % 3 = 1 then 'FORM A' else 'FORM B' end from ({_DOCS}) where k % 3 > 0"""
)
def box_answers(spark, sf):
    """Ticked boxes answer by the words beside them or by what is printed around; one box is far from all lines."""
    docs, k = _docs(spark, sf), F.col("k")
    rows = [(1, 0.10, "Do you want to receive mail"), (1, 0.14, "YES"), (1, 0.18, "NO"), (1, 0.4, "one"), (1, 0.5, "two"), (1, 0.6, "three"), (1, 0.7, "Politically exposed"), (1, 0.74, "person here")]
    rows += [(2, 0.1, "Form A"), (2, 0.3, "x"), (2, 0.5, "x"), (2, 0.7, "x"), (2, 0.9, "Form B")]
    ticks = [(1, 0.01, 0.141, k % 2 == 0), (1, 0.01, 0.181, k % 2 == 1), (1, 0.01, 0.74, k % 3 == 0), (1, 0.01, 0.82, None), (2, 0.01, 0.1, k % 3 > 0), (2, 0.01, 0.9, k % 3 == 2)]
    return words.mark_answers(_marks(docs, ticks), _words(docs, rows), _RULES, ["doc_id"], limit=0.05)


@query(
    f"""select doc_id, unnest(['OwnACard', 'AgreeAllTheseTerms', 'ColourOfCardPlastic', 'OwnACard2', 'Other']) as field, unnest(['yesno', 'checkbox', 'option', 'yesno', 'checkbox']) as kind,
      unnest(['Own a card', 'I agree to all of these terms', 'Colour of card/plastic|Colour of card', 'Own a card:', 'OTHER']) as aliases, unnest([null, null, 'RED GREEN|GREEN', null, null]) as options from ({_DOCS})"""
)
def blank_mark_fields(spark, sf):
    """Fields of a blank form's marks: a question, a statement, options, a repeated question, one of another caption, and a short label."""
    docs = _docs(spark, sf)
    rows = [(1, 0.1, "Own a card"), (1, 0.14, "YES NO"), (1, 0.3, "I agree to all of these terms"), (1, 0.5, "Colour of card/plastic"), (1, 0.54, "Red Green")]
    rows += [(2, 0.1, "Own a card"), (2, 0.14, "YES NO"), (2, 0.4, "Own a card:"), (2, 0.44, "NO YES"), (2, 0.8, "Other")]
    marks = [(p, x, y, None) for p, y, n in ((1, 0.14, 2), (1, 0.3, 1), (1, 0.54, 2), (2, 0.14, 2), (2, 0.44, 2), (2, 0.8, 1)) for x in (0.01, 0.11)[:n]]
    fields = words.mark_fields(_marks(docs, marks), words.page_lines(_words(docs, rows), ["doc_id", "page_no"]), ["doc_id"])
    return fields.select("doc_id", "field", "kind", F.array_join("aliases", "|").alias("aliases"), F.array_join("options", "|").alias("options"))


@query(f"select doc_id, 'a' as keyword, case when k % 2 = 0 then 0 else 50 end::double as x0, case when k % 2 = 0 then 20 else 60 end::double as x1 from ({_DOCS}) union all select doc_id, 'b', 4, 5 from ({_DOCS})")
def dominant_clusters(spark, sf):
    """Of a caption's matches the overlapping ones with the greatest coverage in all; of equal ones the narrower."""
    rows = "array(struct('a', 0d, 10d, 0.5d), struct('a', 8d, 20d, 0.4d), struct('a', 50d, 60d, if(k % 2 = 0, 0.8d, 1d)), struct('b', 0d, 2d, 1d), struct('b', 4d, 5d, 1d))"
    made = F.expr(rows).cast("array<struct<keyword:string,x0:double,x1:double,coverage:double>>")
    hits = _docs(spark, sf).select("doc_id", F.posexplode(made).alias("o", "h")).select("doc_id", "o", "h.*")
    return layout.dominant_cluster(hits, ["doc_id", "keyword"], "o")
