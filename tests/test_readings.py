"""Pages read by a walk over their lines give what joins of all texts with the dictionary give."""

import random

from formweave.operators import pages
from formweave.sources import dictionary

FIELDS = [("name", ["Customer Name", "Name of Client"], "text"), ("total", ["Total Amount"], "number"), ("accepted", ["Accepted", "Terms Accepted"], "yesno"), ("day", [], "date"), ("branch", ["Date of the Branch Visit"], "text")]
ANCHORED = [("day", "date", "principalsignature", 5000), ("other_day", "date", "jointsignature", 6000), ("held", "totalamount", "jointaccount", 7000)]
PARTS = [
    "Customer Name", "CUST0MER NAME", "Name of Client", "Total Amount", "TOTAL AM0UNT", "Accepted", "Terms Accepted", "Date", "DATE", "PRINCIPAL SIGNATURE", "JOINT SIGNATURE", "J0INT SIGNATURE", "joint account", "Date of the Branch Visit",
    "Ann Lee", "12", "7 of 9", "YES", "no", "as agreed", "(mandatory)", "", "  ", "　", "Is this so?", "one two three four five six seven eight", "it ends here at last.", "ÉTÉ ET HIVER", "straße", "\x1c", "٠١", "•", "RM 1,200", "K", "İ", "ABC DEF GHI 1",
]


def _pages(n):
    draw = random.Random(7)
    rows = []
    for d in range(n):
        for i in range(draw.randint(0, 14)):
            text = draw.choice((" ", ": ", " : ", ":", "\t")).join(draw.choice(PARTS) for _ in range(draw.choice((1, 1, 1, 2, 2, 3))))
            rows.append((d if d % 50 else None, draw.choice("ab"), i, None if draw.random() < 0.02 else text))
    return rows


def test_a_walk_agrees_with_joins(spark):
    plain, kinds = dictionary.from_rows(spark, FIELDS)
    contextual = spark.createDataFrame(ANCHORED, "keyword string, label_norm string, context_norm string, ord int")
    lines = spark.createDataFrame([r for r in _pages(600) if r[0] is not None], "doc_id bigint, sheet string, line_no int, line string")
    read = lambda df: sorted(map(tuple, df.select("doc_id", "sheet", "keyword", "value").collect()))
    asked = read(pages.joined_line_fields(lines, plain, contextual, kinds, ["doc_id", "sheet"]))
    assert len(asked) > 300 and {k for _, _, k, _ in asked} >= {"name", "total", "accepted", "day", "other_day", "branch"}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in (before, "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = read(pages.line_fields(lines, plain, contextual, kinds, ["doc_id", "sheet"]))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        assert got == asked


def test_pages_are_dealt_once(spark):
    plain, kinds = dictionary.from_rows(spark, FIELDS)
    contextual = spark.createDataFrame(ANCHORED, "keyword string, label_norm string, context_norm string, ord int")
    lines = spark.range(5).selectExpr("id as doc_id", "0 as line_no", "'Customer Name: Ann' as line")
    fields = pages.line_fields(lines, plain, contextual, kinds, ["doc_id"])
    assert fields.count() == 5 and "Join" not in fields._jdf.queryExecution().optimizedPlan().toString()
    empty = pages.line_fields(lines.limit(0), plain, contextual, kinds, ["doc_id"])
    assert empty.count() == 0 and pages.line_fields(lines, plain.limit(0), contextual.limit(0), kinds, ["doc_id"]).count() == 0
