"""Rules applied to texts that tell right from wrong; the results are stated by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from formweave.functions import text
from formweave.operators import lines, schema
from formweave.plans.registry import query

#: rule, text, kind of field, result.
CASES = [
    ("strip", "-- •12.50 %", "", "12.50"), ("strip", ", x /", "", ", x /"), ("strip", "─ a;b ─", "", "a;b"),
    ("token", "✓ done", "", "- [x] done"), ("token", "● yes", "", "- (●) yes"), ("token", "a [V] b", "", "a [x] b"), ("token", "[    ] c", "", "[ ] c"), ("token", "( ◯ ) e", "", "( ) e"),
    ("token", "(○)", "", "- ( )"), ("token", "[/]", "", "- [x]"), ("token", "plain [x] text", "", "plain [x] text"), ("token", "□  wide", "", "- [ ] wide"),
    ("camel", "please do not if we are to be at my place", "", "Place"), ("camel", "TAX IDENTIFICATION NUMBER (TIN)", "", "TaxIdentificationNumber"), ("camel", "name/user-name", "", "NameUserName"),
    ("camel", "to be or not to be and", "", "ToBeOrNotToBe"),
    ("slash", "Name/User/Login/Id", "", "Name|User|Login|Id"), ("slash", "HEAD OF BRANCH/DIVISION", "", "HEAD OF BRANCH/DIVISION|HEAD OF BRANCH"), ("slash", "plain", "", "plain"),
    ("value", "SGD 12.50", "", "true"), ("value", "rm 12", "", "true"), ("value", ": 7881288", "", "true"), ("value", "EUR 5", "", "false"), ("value", "Name", "", "false"), ("value", " : ", "", "true"),
    ("type", "DATE OF ISSUE", "", "date"), ("type", "DD-MM-YYYY", "", "date"), ("type", "Place of birth", "", "date"), ("type", "Post code", "", "number"), ("type", "NO. OF SHARES", "", "number"),
    ("type", "NO", "", "text"), ("type", "Day", "", "text"), ("type", "Qty", "", "text"), ("type", "Signed", "", "text"), ("type", "Your signature", "", "signature"), ("type", "Limit (RM)", "", "number"),
    ("checked", "[✓] I agree", "", "true"), ("checked", "[/]", "", "true"), ("checked", "• [X] x", "", "true"), ("checked", "[ ] no", "", "false"), ("checked", "see [x]", "", "false"),
    ("answer", "[X] NOT now", "", "NO"), ("answer", "[x] YES [X] NO", "", "BOTH"), ("answer", "YES [☑] / NO [ ]", "", "YES"), ("answer", "YES", "", ""),
    ("noise", "YES / NO", "", "true"), ("noise", "..a:", "", "true"), ("noise", "Yes please", "", "false"),
    ("tick", ":selected:", "", "true"), ("tick", " :unselected: ", "", "true"), ("tick", "selected", "", "false"),
    ("date", "on 3 March 24 or later", "", "3 March 24"), ("date", "4 Sept 2024", "", ""), ("date", "due 4/5/2024", "", "4/5/2024"),
    ("score", "BOTH", "yesno", "0.5 non-standard checkbox value"), ("score", "selected", "checkbox", "0.9 checkbox selection"), ("score", "- [x]", "option", "0.9 checkbox symbol"),
    ("score", "23 June 2026", "date", "0.3 date format not recognized"), ("score", "2026-06-23", "date", "0.95 valid date format"), ("score", "112/5/20245", "date", "0.3 date format not recognized"),
    ("score", "x1", "number", "0.3 numeric format not recognized"), ("score", "RM 1,200", "number", "0.9 valid numeric format"), ("score", "A", "signature", "0.2 signature too short"),
    ("score", "ab", "text", "0.4 text value too short"), ("score", "", "text", "0.0 not found"),
    ("strict", "abc-123", "identifier", "0.9 alphanumeric identifier pattern"), ("strict", "both", "yesno", "0.35 ambiguous yes/no selection"), ("strict", "Date", "text", "0.2 looks like a label/option instead of a value"),
    ("strict", "Form A", "document", "0.85 selected document option"), ("strict", "Form A", "text", "0.2 looks like a label/option instead of a value"), ("strict", "3 March 24", "date", "0.95 valid date format"),
    ("strict", "40%", "percent", "0.2 percent format not recognized"), ("strict", "anything", "other", "0.75 captured from matched label"),
    ("label", "Total    SGD 12.50", "", "Total"), ("label", "Total    twelve", "", ""),
]


def _values(rows: list[tuple]) -> str:
    one = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


@query(f"select * from (values {_values(CASES)}) t(rule, text, kind, result)")
def rule_cases(spark, sf):
    c, kind = F.col("text"), F.col("kind")
    scored = lambda a: F.concat_ws(" ", a["confidence"].cast("string"), a["reason"])
    by_rule = {
        "strip": text.strip_edges(c), "token": text.task_tokens(c), "camel": text.camel_name(c), "slash": F.array_join(text.slash_aliases(c), "|"), "value": text.value_like(c).cast("string"),
        "type": text.text_type(c), "checked": text.checked_statement(c).cast("string"), "answer": text.yes_no(c), "noise": text.option_noise(c).cast("string"), "tick": text.selection_value(c).cast("string"),
        "date": text.date(c), "score": scored(text.assess_value(c, kind)), "strict": scored(text.assess_strict(c, kind, ("FORM A",))), "label": schema.label_of(c),
    }
    out = None
    for rule, value in by_rule.items():
        out = F.when(F.col("rule") == rule, value) if out is None else out.when(F.col("rule") == rule, value)
    rows = spark.createDataFrame([r[:3] for r in CASES], "rule string, text string, kind string")
    return rows.select("rule", "text", "kind", out.alias("result"))


#: form, line, text, whether it is a caption, the value that follows.
LINES = [
    (1, 0, "Price", 1, "12.50 only"), (1, 1, "12.50 only", 0, ""), (1, 2, "1) first item", 0, ""), (1, 3, "ADDRESS:", 0, ""),
    (2, 0, "Name", 1, "Ann"), (2, 1, "2. terms apply", 0, "Ann"), (2, 2, "Segment", 1, "Ann"), (2, 3, "# note", 0, "Ann"), (2, 4, "Ann", 0, ""),
    (3, 0, "Far", 1, ""), (3, 1, "a: b", 0, "too far"), (3, 2, "", 0, "too far"), (3, 3, "[ ]", 0, "too far"), (3, 4, "Yes/No", 0, "too far"), (3, 5, "too far", 0, ""),
]


@query(f"select doc_id, line_no, value from (values {_values(LINES)}) t(doc_id, line_no, line, caption, value)")
def next_value_cases(spark, sf):
    rows = spark.createDataFrame([r[:4] for r in LINES], "doc_id int, line_no int, line string, caption int")
    return lines.next_value(rows, label=F.col("caption") == 1).select("doc_id", "line_no", "value")


AHEAD = [(1, 0, "[✓] own", "[✓] own for me alone"), (1, 4, "see [/] this", "see [/] this")]


@query(f"select * from (values {_values(AHEAD)}) t(doc_id, line_no, line, ahead)")
def ticked_ahead(spark, sf):
    rows = [(1, 0, "[✓] own"), (1, 1, "for me"), (1, 2, "alone"), (1, 3, "[ ] joint"), (1, 4, "see [/] this")]
    df = spark.createDataFrame(rows, "doc_id int, line_no int, line string")
    return lines.ticked_ahead(df).join(df, ["doc_id", "line_no"]).select("doc_id", "line_no", "line", "ahead")
