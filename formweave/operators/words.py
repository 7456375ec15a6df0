"""Words with boxes: lines of a page or a cell, words beside marks, answers and fields that marks announce."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formweave.functions import text
from formweave.operators import geometry

# Least heights and tolerances, in units of the page, and their shares of the median height of words.
LEAST_HEIGHT, LEAST_TOLERANCE, TOLERANCE = 0.001, 0.01, 0.6
LEAST_SIDE, SIDE, LEAST_SPAN, SPAN, LEAST_ROW, ROW = 0.005, 0.2, 0.05, 4.0, 0.01, 1.5
STATEMENT_WORDS = 28


def _placed(words: DataFrame) -> DataFrame:
    """Words (word_no, text, x0, y0, x1, y1) with a text and a box, with their centre and their height `_h`."""
    said = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    held = words.withColumn("text", said).where("text <> '' and x0 + y0 + x1 + y1 is not null")
    height = F.greatest(F.lit(LEAST_HEIGHT), F.col("y1") - F.col("y0"))
    return held.withColumn("cx", (F.col("x0") + F.col("x1")) / 2).withColumn("cy", (F.col("y0") + F.col("y1")) / 2).withColumn("_h", height)


def page_words(words: DataFrame, page: list[str]) -> DataFrame:
    """Words (word_no, text, x0, y0, x1, y1) with a text and a box, with their centre and the page's median height of words."""
    return _placed(words).withColumn("median_h", F.greatest(F.lit(LEAST_HEIGHT), F.median("_h").over(Window.partitionBy(*page)))).drop("_h")


def _gathered(words: DataFrame, marks: DataFrame, page: list[str]) -> DataFrame:
    """A row per page with words and marks: words `_w`, in order of their centres and from left to right, `median_h`, marks `_m`.

    Words and marks meet in one exchange; what follows works on the arrays of a page, which are bounded by what
    a page can show, and needs no sort of words or lines, of which each would hold and spill them once more.
    """
    rows = _placed(words).select(*page, F.struct("cy", "x0", "word_no", "text", F.col("_h").alias("h")).alias("_c"))
    rows = rows.unionByName(marks.select(*page, F.struct("mark_no", "cx", "cy").alias("_n")), allowMissingColumns=True)
    held = rows.groupBy(*page).agg(F.array_sort(F.collect_list("_c")).alias("_w"), F.collect_list("_n").alias("_m")).where("size(_w) > 0 and size(_m) > 0")
    high, n = F.array_sort(F.transform("_w", lambda c: c["h"])), F.size("_w")
    low, up = F.get("_s", ((n - 1) / 2).cast("int")), F.get("_s", (n / 2).cast("int"))
    median = F.greatest(F.lit(LEAST_HEIGHT), F.when(low == up, low).otherwise(low * 0.5 + up * 0.5))
    return held.withColumn("_s", high).withColumn("median_h", median).drop("_s")


def _folded(groups: DataFrame) -> DataFrame:
    """Adds `lines` (cy, line, words), those of `group_lines`, to pages of words `_w` with their `median_h`."""
    tolerance = F.greatest(F.lit(LEAST_TOLERANCE), F.col("median_h") * TOLERANCE)
    numbers = geometry.row_numbers(F.transform("_w", lambda c: F.struct(c["cy"].cast("double").alias("y"), tolerance.alias("tol"))))
    first = lambda k: F.array_position("_r", k).cast("int")
    behind = lambda k: F.when(k < F.element_at("_r", -1), first(k + 1)).otherwise(F.size("_r") + 1)
    parts = F.transform(F.sequence(F.lit(1), F.element_at("_r", -1)), lambda k: F.slice("_w", first(k), behind(k) - first(k)))
    across = lambda p: F.array_sort(F.transform(p, lambda c, i: F.struct(c["x0"].alias("x"), i.alias("i"), c["text"].alias("text"))))
    centre = lambda p: F.aggregate(p, F.lit(0.0), lambda s, c: s + c["cy"]) / F.size(p)
    made = F.transform(parts, lambda p: F.struct(centre(p).alias("cy"), F.transform(across(p), lambda c: F.struct(c["x"].alias("x"), c["text"].alias("text"))).alias("words")))
    line = lambda x: F.array_join(F.transform(x["words"], lambda c: c["text"]), " ")
    held = groups.withColumn("_r", numbers).withColumn("_l", made)
    return held.withColumn("lines", F.transform("_l", lambda x: F.struct(x["cy"].alias("cy"), line(x).alias("line"), x["words"].alias("words")))).drop("_r", "_l")


def group_lines(words: DataFrame, group: list[str]) -> DataFrame:
    """group, line_no, cy, line, words (x, text), median_h: words of `page_words` in lines, by centre and from left to right.

    All steps need the rows of a group together, so that one exchange serves them.
    """
    tolerance = F.greatest(F.lit(LEAST_TOLERANCE), F.col("median_h") * TOLERANCE)
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("cy", "x0", "word_no"))
    ranked = words.select(*group, rank.alias("_k"), "cy", "x0", "text", "median_h", tolerance.alias("_tol"))
    rows = geometry.cluster_rows(ranked, group, "cy", "_k", "_tol", ("x0", "text", "median_h"))
    parts = F.array_sort(F.collect_list(F.struct(F.col("x0").alias("x"), "_k", "text")))
    lines = rows.groupBy(*group, "row_no").agg(F.avg("cy").alias("cy"), F.transform(parts, lambda p: F.struct(p["x"].alias("x"), p["text"].alias("text"))).alias("words"), F.first("median_h").alias("median_h"))
    line = F.array_join(F.transform("words", lambda p: p["text"]), " ")
    return lines.select(*group, (F.col("row_no") - 1).alias("line_no"), "cy", line.alias("line"), "words", "median_h")


def page_lines(words: DataFrame, page: list[str]) -> DataFrame:
    return group_lines(page_words(words, page), page)


def cell_lines(cells: DataFrame, words: DataFrame, page: list[str], cell: str = "cell_no") -> DataFrame:
    """page, cell, line_no, line: the lines printed in a cell (x0, y0, x1, y1), without leading asterisks; by the page's scale."""
    box = cells.select(*page, cell, *(F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")))
    on = F.col("cx").between(F.col("_x0"), F.col("_x1")) & F.col("cy").between(F.col("_y0"), F.col("_y1"))
    inside = page_words(words, page).join(box, page).where(on)
    line = F.trim(F.regexp_replace(text.clean_value(F.col("line")), r"^\*+\s*", ""))
    return group_lines(inside, [*page, cell]).select(*page, cell, "line_no", line.alias("line")).where("line <> ''")


def beside(marks: DataFrame, lines: DataFrame, page: list[str], back: Column | float, limit: float | None = None) -> DataFrame:
    """Marks (mark_no, cx, cy) that have a line, with that line's columns and its texts at the `left` and `right` of the mark.

    `back` is how far before the mark's centre a word of the right side may begin; it may refer to `median_h`.
    Lines come along with the marks and are not joined: their estimated size is far below their real one, and
    a broadcast of them would fill the driver.
    """
    at = marks.select(*page, "mark_no", F.col("cx").alias("mark_x"), F.col("cy").alias("mark_y"))
    carry = tuple(c for c in lines.columns if c not in (*page, "line_no"))
    near = geometry.nearest_line(at, lines, page, "mark_no", "mark_y", "line_no", "cy", limit, carry)
    read = near.dropna(subset=[*page, "line_no"]).drop("distance")
    edge = F.col("mark_x") - back
    texts = lambda keep: F.transform(F.filter("words", keep), lambda w: w["text"])
    return read.withColumn("left", texts(lambda w: w["x"] < edge)).withColumn("right", texts(lambda w: w["x"] >= edge))


def _last(words: str, n: int) -> Column:
    return F.slice(words, F.greatest(F.size(words) - n + 1, F.lit(1)), F.lit(n))


@dataclass(frozen=True)
class MarkRule:
    """A mark whose surrounding lines hold all `parts` (upper case) answers for the keyword: `answer`, or YES or NO of the words beside it."""

    keyword: str
    parts: tuple[str, ...]
    answer: str | None = None


def mark_answers(marks: DataFrame, words: DataFrame, rules: list[MarkRule], key: list[str], page_no: str = "page_no", back: float = 0.02, limit: float | None = None) -> DataFrame:
    """key, keyword, value: what selected marks answer, by the six words before and the eight behind them and the lines up to two away.

    A mark lies on the nearest line of its page's words, the upper of equally near ones; beyond `limit` on none.
    YES is looked for before NO. Of several answers the last page's last mark's last rule counts.
    """
    page = [*key, page_no]
    pages = _folded(_gathered(words, marks, page).dropna(subset=page))
    nearest = lambda m: F.array_min(F.transform("lines", lambda x, i: F.struct(F.abs(x["cy"] - m["cy"]).alias("d"), i.alias("i"))))
    around = lambda i: F.slice("lines", F.greatest(i - 1, F.lit(1)), F.least(i + 3, F.lit(5)))
    context = lambda i: F.upper(F.array_join(F.transform(around(i), lambda x: x["line"]), " "))
    at_line = lambda m, n: F.struct(m["mark_no"].alias("mark_no"), m["cx"].alias("cx"), F.get("lines", n["i"])["words"].alias("words"), context(n["i"]).alias("context"))
    kept = lambda n: n["d"].isNotNull() if limit is None else n["d"] <= limit
    placed = F.zip_with("_m", "_n", lambda m, n: F.when(kept(n), at_line(m, n)))
    read = pages.withColumn("_n", F.transform("_m", nearest)).select(*page, F.explode(F.filter(placed, lambda x: x.isNotNull())).alias("_m")).select(*page, "_m.*")
    edge = F.col("cx") - back
    texts = lambda keep: F.transform(F.filter("words", keep), lambda w: w["text"])
    read = read.withColumn("left", texts(lambda w: w["x"] < edge)).withColumn("right", texts(lambda w: w["x"] >= edge))
    local = F.upper(F.array_join(F.concat(_last("left", 6), F.slice("right", 1, 8)), " "))
    said = F.when(F.col("_local").contains("YES"), "YES").when(F.col("_local").contains("NO"), "NO")
    found = []
    for i, r in enumerate(rules):
        fits = F.lit(True)
        for part in r.parts:
            fits = fits & F.col("context").contains(part)
        found.append(F.when(fits, F.struct(F.lit(i).alias("rule"), F.lit(r.keyword).alias("keyword"), (said if r.answer is None else F.lit(r.answer)).alias("value"))))
    got = read.withColumn("_local", local).select(*page, "mark_no", F.explode(F.filter(F.array(*found), lambda x: x["value"].isNotNull())).alias("_f"))
    return got.groupBy(*key, F.col("_f.keyword").alias("keyword")).agg(F.max_by("_f.value", F.struct(page_no, "mark_no", "_f.rule")).alias("value"))


def mark_fields(marks: DataFrame, lines: DataFrame, key: list[str], page_no: str = "page_no") -> DataFrame:
    """key, field, kind, label, aliases, options: the fields of a blank form's marks, selected or not.

    Marks on neighbouring lines are a group. One with a YES and a NO asks the question printed above it, a single
    mark stands for the statement beside it if that has five words, any other group offers its labels as options.
    A label that gives the same name as an earlier other one takes a number.
    """
    from formweave.operators import marks as M

    page = [*key, page_no]
    w = Window.partitionBy(*page).orderBy("line_no")
    clean = text.clean_value(F.col("line"))
    asks = F.when(~text.option_noise(F.col("line")), F.struct("cy", clean.alias("t")))
    above = F.last(asks, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    span = F.greatest(F.lit(LEAST_SPAN), F.col("median_h") * SPAN)
    held = lines.withColumn("_above", above).withColumn("_context", F.when(F.col("cy") - F.col("_above.cy") <= span, F.col("_above.t")).otherwise("")).drop("_above")
    read = beside(marks, held, page, F.greatest(F.lit(LEAST_SIDE), F.col("median_h") * SIDE))
    joined = lambda words: F.array_join(words, " ")
    right = F.trim(joined(F.slice("right", 1, 5)))
    read = read.withColumn("_local", F.upper(F.when(right != "", right).otherwise(F.trim(joined(_last("left", 3))))))
    read = read.withColumn("_said", text.clean_value(joined(F.slice("right", 1, STATEMENT_WORDS))))
    read = read.withColumn("_k", F.row_number().over(Window.partitionBy(*page).orderBy("cy", "mark_x", "mark_no")).cast("bigint"))
    read = read.withColumn("_tol", F.greatest(F.lit(LEAST_ROW), F.col("median_h") * ROW))
    grouped = M.group_marks(read, page, "cy", "_k", "_tol", ("_local", "_said", "_context"))
    member = F.struct("_k", F.col("_local").alias("local"), F.col("_said").alias("said"), F.col("_context").alias("context"))
    groups = grouped.groupBy(*page, "group_no").agg(F.array_sort(F.collect_list(member)).alias("_m"))
    locals_ = F.transform("_m", lambda m: m["local"])
    has = lambda word: F.exists(locals_, lambda x: x.rlike(rf"\b{word}\b"))
    kind = F.when(has("YES") & has("NO"), "yesno").when(F.size("_m") == 1, "checkbox").otherwise("option")
    context, said = F.col("_m")[0]["context"], F.col("_m")[0]["said"]
    bare = F.trim(F.regexp_replace(context, r"(?i)\bYES\b|\bNO\b", ""))
    lone = F.when(text.word_count(said) >= 5, said).when(context != "", context).otherwise(F.col("_m")[0]["local"])
    label = F.when(F.col("kind") == "yesno", F.when(bare != "", bare).otherwise(context)).when(F.col("kind") == "checkbox", lone).otherwise(context)
    options = F.when(F.col("kind") == "option", F.filter(locals_, lambda x: x != ""))
    named = groups.withColumn("kind", kind).withColumn("label", label).withColumn("options", options).withColumn("_name", text.camel_name(F.col("label"))).where("_name <> ''")
    order = F.struct(page_no, "group_no")
    first = named.groupBy(*key, "_name", "label").agg(F.min(F.struct(order.alias("o"), "kind", "options")).alias("_f"))
    n = F.row_number().over(Window.partitionBy(*key, "_name").orderBy("_f.o"))
    field = F.when(F.col("_n") == 1, F.col("_name")).otherwise(F.concat("_name", F.col("_n").cast("string")))
    return first.withColumn("_n", n).select(*key, field.alias("field"), "_f.kind", "label", text.slash_aliases(F.col("label")).alias("aliases"), "_f.options")
