"""Selection marks and checkboxes: their lines, labels, groups and values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formweave.functions import text
from formweave.operators import geometry
from formweave.operators import lines as L


def selection_values(marks: DataFrame, lines: DataFrame, captions: dict[str, str], page: str = "doc_id") -> DataFrame:
    """page, keyword, value: a selected mark's nearest line answers for the captions within two lines around it.

    YES is looked for before NO, both as parts of the line. The last mark of a keyword wins.
    """
    near = geometry.nearest_line(marks.where("selected"), lines.select(page, "line_no", "cy"), [page], "mark_id", "mark_y", "line_no", "cy")
    read = near.join(L.context_window(lines, 2, page).select(page, "line_no", "line", "context"), [page, "line_no"])
    up = F.upper("line")
    answer = F.when(up.contains("YES"), "YES").when(up.contains("NO"), "NO").otherwise("")
    found = F.filter(F.array(*(F.when(F.upper("context").contains(caption), F.lit(k)) for k, caption in captions.items())), lambda k: k.isNotNull())
    got = read.withColumn("value", answer).where("value <> ''").select(page, "mark_id", "value", F.explode(found).alias("keyword"))
    return got.groupBy(page, "keyword").agg(F.max_by("value", "mark_id").alias("value"))


def box_labels(boxes: DataFrame, cells: DataFrame, row: list[str]) -> DataFrame:
    """Adds `label`: the texts of a row from a box to the next box, in order of x.

    Boxes and cells of a row are sorted together and each cell takes the last box before it, so no pair is emitted.
    """
    b = boxes.select(*row, F.col("x").alias("_x"), F.lit(0).alias("_k"), F.col("x").alias("_b"), F.lit(None).cast("string").alias("_t"))
    c = cells.select(*row, F.col("x0").alias("_x"), F.lit(1).alias("_k"), F.lit(None).cast("double").alias("_b"), F.col("text").alias("_t"))
    w = Window.partitionBy(*row).orderBy("_x", "_k").rowsBetween(Window.unboundedPreceding, 0)
    held = b.unionByName(c).withColumn("x", F.last("_b", True).over(w)).where("x is not null")
    parts = F.array_sort(F.collect_list(F.when(F.col("_k") == 1, F.struct("_x", "_t"))))
    labels = held.groupBy(*row, "x").agg(F.array_join(F.transform(parts, lambda p: p["_t"]), " ").alias("label"))
    return boxes.join(labels, [*row, "x"], "left").withColumn("label", F.coalesce("label", F.lit("")))


def box_values(labelled: DataFrame) -> DataFrame:
    """Adds `value` to ticked boxes: YES or NO of the label, an option of up to three words, else YES."""
    label = text.clean_value(F.col("label"))
    option = F.when(F.upper(label).isin("YES", "NO"), F.upper(label)).when((label != "") & (text.word_count(label) <= 3), label).otherwise("YES")
    return labelled.withColumn("value", F.when(F.col("ticked"), option).otherwise(""))


def clear_unticked(values: DataFrame, labels: str, value: str = "value", least: int = 4) -> DataFrame:
    """Values of which less than two characters are left without the labels of unticked boxes become empty."""
    long = F.filter(labels, lambda x: F.length(x) >= least)
    left = F.aggregate(long, F.col(value), lambda v, x: F.replace(v, x, F.lit("")))
    return values.withColumn(value, F.when(F.length(text.clean_value(left)) < 2, "").otherwise(F.col(value)))


def group_marks(marks: DataFrame, page: list[str], y: str, order: str, tolerance: float | str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Adds `group_no`: each mark, in order, joins the first group whose first member is nearer than the tolerance, a number or a column.

    Columns to `carry` come through the fold, so that they need no join.
    """
    state = "struct<lead:array<double>,out:array<int>>"
    start = F.from_json(F.lit('{"lead":[],"out":[]}'), state)

    def step(acc, c):
        at = F.array_position(F.transform(acc["lead"], lambda m: F.abs(m - c["y"]) < c["t"]), True).cast("int")
        lead = F.when(at > 0, acc["lead"]).otherwise(F.concat(acc["lead"], F.array(c["y"])))
        g = F.when(at > 0, at).otherwise(F.size(acc["lead"]) + 1)
        return F.struct(lead.alias("lead"), F.concat(acc["out"], F.array(g)).alias("out"))

    limit = (F.col(tolerance) if isinstance(tolerance, str) else F.lit(tolerance)).cast("double")
    fold = F.struct(F.col(order).cast("bigint").alias("o"), F.col(y).cast("double").alias("y"), limit.alias("t"), *carry)
    held = marks.groupBy(*page).agg(F.array_sort(F.collect_list(fold)).alias("_r"))
    zipped = F.zip_with("_r", F.aggregate("_r", start, step, lambda a: a["out"]), lambda c, g: F.struct(c.alias("c"), g.alias("g")))
    flat = held.select(*page, F.explode(zipped).alias("_c"))
    return flat.select(*page, F.col("_c.c.o").alias(order), F.col("_c.g").alias("group_no"), *(F.col(f"_c.c.{x}") for x in carry))


def caption_gaps(captions: DataFrame, values: DataFrame, key: list[str], caption_row: str = "row_no", value_row: str = "row_no") -> DataFrame:
    """key, gap: the fewest rows between a caption row and a value row, 0 if one side is missing.

    Rows of a key are sorted together; the nearest row of the other side is a neighbour in that order.
    """
    a = captions.select(*key, F.col(caption_row).alias("_r"), F.lit(0).alias("_k"))
    b = values.select(*key, F.col(value_row).alias("_r"), F.lit(1).alias("_k"))
    w = Window.partitionBy(*key).orderBy("_r", "_k").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b)
    other = F.last(F.when(F.col("_k") == 0, F.col("_r")), True).over(w), F.last(F.when(F.col("_k") == 1, F.col("_r")), True).over(w)
    gap = F.when(F.col("_k") == 1, F.col("_r") - other[0]).otherwise(F.col("_r") - other[1])
    return both.withColumn("_g", gap).groupBy(*key).agg(F.coalesce(F.min("_g"), F.lit(0)).cast("int").alias("gap"))
