"""Tables from geometry and from text order, and block segmentation of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formweave.functions import text
from formweave.operators import geometry, matching


def center_clusters(cells: DataFrame, page: list[str], x: str, tie: str, tolerance: float) -> DataFrame:
    """page, center_no, center: a position above the last centre by more than the tolerance opens one, else both are averaged."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(tie).alias("t"))))

    def step(acc, c):
        last = F.try_element_at(acc, F.lit(-1))
        fresh = F.concat(acc, F.array(c["x"]))
        averaged = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array((last + c["x"]) / 2))
        return F.when(F.size(acc) == 0, F.array(c["x"])).when(c["x"] - last > tolerance, fresh).otherwise(averaged)

    folded = cells.groupBy(*page).agg(F.aggregate(rows, F.array().cast("array<double>"), step).alias("_c"))
    return folded.select(*page, F.posexplode("_c").alias("center_no", "center"))


def row_blocks(rows: DataFrame, page: list[str], order: str, n: str, start: int = 3, least: int = 2) -> DataFrame:
    """Rows in blocks, with `block`: a row of `start` cells opens one, rows of `least` cells continue it."""
    w = Window.partitionBy(*page).orderBy(order)
    cut = rows.withColumn("_g", F.sum((F.col(n) < least).cast("int")).over(w))
    inside = cut.withColumn("_s", F.max((F.col(n) >= start).cast("int")).over(Window.partitionBy(*page, "_g").orderBy(order)))
    return inside.where((F.col("_s") == 1) & (F.col(n) >= least)).withColumn("block", F.dense_rank().over(Window.partitionBy(*page).orderBy("_g"))).drop("_g", "_s")


def spans(words: DataFrame, page: list[str], order: list[str], word: str) -> DataFrame:
    """Adds `offset`: where the word begins when a page's words are joined by blanks."""
    w = Window.partitionBy(*page).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return words.withColumn("offset", F.coalesce(F.sum(F.length(word) + 1).over(w), F.lit(0)).cast("int"))


def numbered_terms(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, term_no, term: numbered lines with the lines that continue them."""
    w = Window.partitionBy(key).orderBy("line_no")
    starts = F.col("line").rlike(r"^\s*\d{1,2}[.)]\s").cast("int")
    held = lines.where("trim(line) <> ''").withColumn("term_no", F.sum(starts).over(w).cast("int")).where("term_no > 0")
    packed = F.array_sort(F.collect_list(F.struct("line_no", F.trim("line").alias("t"))))
    return held.groupBy(key, "term_no").agg(F.array_join(F.transform(packed, lambda x: x["t"]), " ").alias("term"))


def gap_bands(hits: DataFrame, page: list[str], y: str, tie: str, limit: Column | float) -> DataFrame:
    """Adds `band`: a new one where y lies more than the limit below the previous match."""
    return geometry.gap_segments(hits, page, [y, tie], y, y, limit).withColumnRenamed("segment", "band")


def best_band(hits: DataFrame, page: list[str]) -> DataFrame:
    """Hits of each page's band with the most keywords, the first of equal ones."""
    score = hits.groupBy(*page, "band").agg(F.count_distinct("keyword").alias("_n"))
    best = score.groupBy(*page).agg(F.max_by("band", F.struct("_n", -F.col("band"))).alias("band"))
    return hits.join(best, [*page, "band"])


def dominant_cluster(matches: DataFrame, group: list[str], order: str, low: str = "x0", high: str = "x1", weight: str = "coverage") -> DataFrame:
    """group, low, high: of a caption's matches that overlap in x, those of the greatest weight in all, the narrower and then the left one of equal ones."""
    held = geometry.overlap_clusters(matches, group, [low, order], low, high)
    span = held.groupBy(*group, "cluster").agg(F.sum(weight).alias("_w"), F.min(low).alias(low), F.max(high).alias(high))
    best = F.max_by(F.struct(low, high), F.struct("_w", F.col(low) - F.col(high), -F.col("cluster")))
    return span.groupBy(*group).agg(best.alias("_b")).select(*group, f"_b.{low}", f"_b.{high}")


def until_gap(rows: DataFrame, page: list[str], y: str, typical: str, start: str, times: float = 2.0) -> DataFrame:
    """Accepted rows up to the first that lies more than `times` the typical height below the one before it.

    Rows that are not accepted must be gone already: the gap runs from the last accepted row.
    """
    w = Window.partitionBy(*page).orderBy(y)
    gap = F.col(y) - F.coalesce(F.lag(y).over(w), F.col(start))
    cut = rows.withColumn("_far", (gap > times * F.col(typical)).cast("int"))
    return cut.withColumn("_stop", F.max("_far").over(w)).where("_stop = 0").drop("_far", "_stop")


def geometric_tables(cells: DataFrame, dictionary: DataFrame, page: str = "page", least_columns: int = 2, least_values: int = 2) -> DataFrame:
    """page, row_no, keyword, value of the table under each page's best header band.

    Headers are cells that cover an alias; bands split where captions lie far apart. Columns are the headers'
    ranges, padded; cells below go to the column they overlap most. Row labels like `a)`, row numbers left of
    the first column, short texts, captions, prose and cells much wider than their column go. Rows need
    `least_values` values, and the table ends at a gap of twice the typical row height.

    All steps up to the columns are windows of one partitioning by page; the columns then ride along as an array.
    """
    sheet = Window.partitionBy(page)
    w = sheet.orderBy("cy", "cell_id")
    cy, is_hit = F.col("cy"), F.col("keyword").isNotNull()
    c = matching.covering(cells.withColumn("cy", (F.col("y0") + F.col("y1")) / 2), "text", dictionary)
    c = c.withColumn("_g", cy - F.lag("cy").over(w)).withColumn("_above", F.last(F.when(is_hit, cy), True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    c = c.withColumn("typical", F.coalesce(F.median(F.when((F.col("_g") > 5) & (F.col("_g") < 300), F.col("_g"))).over(sheet), F.lit(30.0)))
    new = F.coalesce((is_hit & (cy - F.col("_above") > F.greatest(3 * F.col("typical"), F.lit(60.0)))).cast("int"), F.lit(0))
    c = c.withColumn("_new", new).withColumn("band", F.when(is_hit, F.sum("_new").over(w)))
    pad = F.greatest(F.lit(10.0), (F.col("x1") - F.col("x0")) * 0.05)
    heads = best_band(c.where(is_hit), [page]).groupBy(page, "keyword").agg(
        F.min(F.col("x0") - pad).alias("cx0"), F.max(F.col("x1") + pad).alias("cx1"), F.min("x0").alias("hx0"), F.max("x1").alias("hx1"), F.max("cy").alias("hy")
    )
    columns = heads.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("cx0", "keyword", "cx1", (F.col("hx1") - F.col("hx0")).alias("w")))).alias("_cols"), F.max("hy").alias("_foot"), F.min("hx0").alias("_left"))
    clean = F.regexp_replace(text.clean_value(F.col("text")), r"^[a-z]\)\s+", "")
    below = c.where(~is_hit).drop("keyword").join(columns.where(F.size("_cols") >= least_columns), page).withColumn("text", clean)
    gutter = F.col("text").rlike(r"^\d{1,3}$") & (F.col("x1") <= F.col("_left"))
    data = (cy > F.col("_foot") + 0.5 * F.col("typical")) & (F.length("text") >= 2) & ~F.lower("text").rlike(r"^[a-z]\)$") & ~gutter & ~text.prose(F.col("text"))
    met = F.transform("_cols", lambda k, i: F.struct((F.least("x1", k["cx1"]) - F.greatest("x0", k["cx0"])).alias("o"), (-i).alias("i"), k["keyword"].alias("keyword"), (F.col("x1") - F.col("x0") <= 2.5 * F.greatest(k["w"], F.lit(1.0))).alias("fits")))
    body = below.where(data).withColumn("_b", F.array_max(F.filter(met, lambda k: k["o"] > 0))).withColumn("_tol", F.greatest(F.lit(8.0), 0.65 * (F.col("y1") - F.col("y0"))))
    placed = geometry.cluster_rows(body, [page], "cy", "cell_id", "_tol", ("text", "x0", "typical", "_foot", "_b")).where("_b.fits")
    joined = placed.groupBy(page, "row_no", "typical", "_foot", F.col("_b.keyword").alias("keyword")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ").alias("value"), F.min("cy").alias("cy"))
    by_row = joined.groupBy(page, "row_no", "typical", "_foot").agg(F.min("cy").alias("cy"), F.collect_list(F.struct("keyword", "value")).alias("_v")).where(F.size("_v") >= least_values)
    kept = until_gap(by_row, [page], "cy", "typical", "_foot").withColumn("row_no", F.row_number().over(sheet.orderBy("cy")))
    return kept.select(page, "row_no", F.inline("_v"))


def text_tables(lines: DataFrame, dictionary: DataFrame, key: str = "doc_id", least: int = 2) -> DataFrame:
    """key, table_no, row_no, keyword, value: runs of caption lines with distinct keywords, then rows of as many lines.

    Blank lines do not count; a last row that is not whole is left out. Window functions alone.
    """
    known = matching.exact(lines.where("trim(line) <> ''"), "line", dictionary).withColumn("_h", F.col("keyword").isNotNull())
    w = Window.partitionBy(key).orderBy("line_no")
    run = known.withColumn("_new", (F.col("_h") & ~F.coalesce(F.lag("_h").over(w), F.lit(False))).cast("int")).withColumn("table_no", F.sum("_new").over(w).cast("int")).where("table_no > 0")
    whole = Window.partitionBy(key, "table_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    named = run.withColumn("_names", F.collect_list("keyword").over(whole))
    n = F.size("_names")
    body = named.where((n >= least) & (F.size(F.array_distinct("_names")) == n)).where("not _h")
    numbered = body.withColumn("_p", F.row_number().over(Window.partitionBy(key, "table_no").orderBy("line_no")) - 1).withColumn("_all", F.count("*").over(Window.partitionBy(key, "table_no")))
    placed = numbered.withColumn("row_no", F.floor(F.col("_p") / n).cast("int") + 1).where(F.col("row_no") * n <= F.col("_all"))
    return placed.select(key, "table_no", "row_no", F.get("_names", (F.col("_p") % n).cast("int")).alias("keyword"), F.trim("line").alias("value"))


def values_below(cells: DataFrame, page: str, captions: DataFrame, rows: int = 2, least: int = 2) -> DataFrame:
    """page, keyword, value: in rows of `least` captions or more, the first cell of the next rows that overlaps in x.

    `captions` are cells with a keyword. The next rows are met by an equi-join on their number.
    """
    many = captions.withColumn("_n", F.count("*").over(Window.partitionBy(page, "row_no"))).where(F.col("_n") >= least)
    wanted = many.select(page, "keyword", F.col("row_no").alias("_cr"), F.col("x0").alias("_a"), F.col("x1").alias("_b"), F.explode(F.sequence(F.col("row_no") + 1, F.col("row_no") + rows)).alias("row_no"))
    free = cells.join(captions.select(page, "row_no", "x0"), [page, "row_no", "x0"], "left_anti").where("trim(text) <> ''")
    met = wanted.join(free, [page, "row_no"]).where("x0 < _b and x1 > _a")
    return met.groupBy(page, "keyword").agg(F.min_by("text", F.struct("_cr", "row_no", "x0")).alias("value"))
