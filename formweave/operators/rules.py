"""Caption rules as data: what a scope must contain, and how the value is taken from it.

All rules of a pass are compiled into one projection over the lines, so a rule costs no join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formweave.functions import text
from formweave.operators import lines as L


@dataclass(frozen=True)
class Rule:
    """`captions` must all be in the upper-cased scope: the line, its context, or the section of that number."""

    keyword: str
    captions: tuple[str, ...]
    extractor: str
    scope: str | int = "line"
    argument: str = ""


def _value(rule: Rule, line: Column, scope: Column) -> Column:
    after = text.clean_value(text.after_colon(line))
    found = {
        "percent": lambda: text.percent(line),
        "date": lambda: text.date(line),
        "after_colon": lambda: F.when(text.informative(after), after).otherwise(""),
        "identifier": lambda: F.regexp_extract(F.upper(line), rule.argument + r"\s*[:\-]?\s*([A-Z0-9\-]{6,})", 1),
        "yes_no": lambda: text.yes_no(scope),
        "checked": lambda: F.when(text.checked_statement(line), "YES").otherwise(""),
        "option": lambda: F.when(F.upper(line).rlike(rf"\[X\]\s*{rule.argument}\b"), rule.argument).otherwise(""),
    }
    return found[rule.extractor]()


def _candidates(rules: list[Rule], scope_of) -> Column:
    tried = []
    for i, rule in enumerate(rules):
        line, scope = scope_of(rule)
        fits = scope.isNotNull()
        for caption in rule.captions:
            fits = fits & F.upper(scope).contains(caption)
        tried.append(F.struct(F.lit(rule.keyword).alias("keyword"), F.lit(i).alias("rule"), F.when(fits, _value(rule, line, scope)).otherwise("").alias("value")))
    return F.explode(F.filter(F.array(*tried), lambda r: r["value"] != ""))


def line_rules(lines: DataFrame, rules: list[Rule], key: str = "doc_id") -> DataFrame:
    """key, keyword, value of the rules on lines and on contexts of one line around; the last line, then the last rule wins."""
    near = L.context_window(lines, 1, key)
    got = near.select(key, "line_no", _candidates(rules, lambda r: (F.col("line"), F.col("line") if r.scope == "line" else F.col("context"))).alias("c"))
    return got.groupBy(key, F.col("c.keyword").alias("keyword")).agg(F.max_by("c.value", F.struct("line_no", "c.rule")).alias("value"))


def section_texts(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, section, body: the lines from a numbered header to the next, joined; of equal numbers the last one counts."""
    header = F.nullif(F.regexp_extract("line", r"^\s*#?\s*(\d{1,2})[.)\- ]", 1), F.lit(""))
    w = Window.partitionBy(key).orderBy("line_no")
    start = F.when(header.isNotNull(), F.struct(header.cast("int").alias("section"), F.col("line_no").alias("first")))
    inside = lines.withColumn("_s", F.last(start, True).over(w)).where("_s is not null")
    packed = inside.groupBy(key, "_s").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_l"))
    body = F.array_join(F.transform("_l", lambda x: x["line"]), "\n")
    return packed.groupBy(key, F.col("_s.section").alias("section")).agg(F.max_by(body, "_s.first").alias("body"))


def section_rules(lines: DataFrame, rules: list[Rule], key: str = "doc_id") -> DataFrame:
    """key, keyword, value of the rules on whole sections; the last rule wins, and an empty value overwrites none."""
    texts = section_texts(lines, key)
    got = texts.select(key, "section", _candidates(rules, lambda r: (F.col("body"), F.when(F.col("section") == r.scope, F.col("body")))).alias("c"))
    return got.groupBy(key, F.col("c.keyword").alias("keyword")).agg(F.max_by("c.value", F.col("c.rule")).alias("value"))


def sanitize(values: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """Values that fit a pattern of their keyword become empty."""
    bad = F.lit(False)
    for keyword, pattern in patterns:
        bad = bad | ((F.col("keyword") == keyword) & F.col("value").rlike(pattern))
    return values.withColumn("value", F.when(bad, "").otherwise(text.clean_value(F.col("value"))))


def exclusive(values: DataFrame, pair: tuple[str, str], single: tuple[str, ...] = (), key: str = "doc_id") -> DataFrame:
    """Two exclusive flags that are both YES become empty, as does BOTH of a field that takes one answer."""
    w = Window.partitionBy(key)
    both = F.count_if(F.col("keyword").isin(*pair) & (F.col("value") == "YES")).over(w) == 2
    blank = (both & F.col("keyword").isin(*pair)) | (F.col("keyword").isin(*single) & (F.col("value") == "BOTH"))
    return values.withColumn("_b", blank).withColumn("value", F.when(F.col("_b"), "").otherwise(F.col("value"))).drop("_b")


def lookback(lines: DataFrame, phrases: list[str], most: int = 4, key: str = "doc_id") -> DataFrame:
    """Adds `context`: 1 to `most` lines before, the fewest that hold a context phrase, else all of them."""
    w = Window.partitionBy(key).orderBy("line_no")
    windows = [F.array_join(F.collect_list("line").over(w.rowsBetween(-k, -1)), " ") for k in range(1, most + 1)]
    held = lines.select("*", *[c.alias(f"_w{k}") for k, c in enumerate(windows, 1)])
    out = F.lit(None).cast("string")
    for k in range(most, 0, -1):
        norm = text.normalize_label(F.col(f"_w{k}"))
        hit = F.lit(False)
        for p in phrases:
            hit = hit | text.has_context(norm, F.lit(p))
        out = F.when(hit, F.col(f"_w{k}")).otherwise(out)
    return held.withColumn("context", F.coalesce(out, F.col(f"_w{most}"))).drop(*[f"_w{k}" for k in range(1, most + 1)])


def continuation(lines: DataFrame, accept: Column, most: int = 4, key: str = "doc_id") -> DataFrame:
    """Adds `value`: the acceptable lines that follow without a gap, at most `most`, joined by blanks."""
    w = Window.partitionBy(key).orderBy("line_no")
    marked = lines.withColumn("_ok", F.when(accept & (text.clean_value(F.col("line")) != ""), text.clean_value(F.col("line"))))
    ahead = F.array(*(F.lead("_ok", i).over(w) for i in range(1, most + 1)))
    stop = F.array_position(F.transform(F.col("_a"), lambda v: v.isNull()), True)
    run = F.when(stop > 0, F.slice("_a", 1, (stop - 1).cast("int"))).otherwise(F.col("_a"))
    return marked.withColumn("_a", ahead).withColumn("value", F.array_join(run, " ")).drop("_ok", "_a")
