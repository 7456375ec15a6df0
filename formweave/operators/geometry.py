"""Operators on boxes: row clustering, segments, bands, overlap clusters, nearest and overlap joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_numbers(cells: Column) -> Column:
    """Numbers from 1 for an array of cells (y, tol): a cell joins the row whose running mean is within the tolerance, or begins the next."""
    state = "struct<m:double,n:int,r:int,out:array<int>>"
    start = F.from_json(F.lit('{"m":0.0,"n":0,"r":0,"out":[]}'), state)

    def step(acc, c):
        near = (acc["n"] > 0) & (F.abs(c["y"] - acc["m"]) <= c["tol"])
        n = F.when(near, acc["n"] + 1).otherwise(1)
        m = F.when(near, (acc["m"] * acc["n"] + c["y"]) / n).otherwise(c["y"])
        r = F.when(near, acc["r"]).otherwise(acc["r"] + 1).cast("int")
        return F.struct(m.alias("m"), n.cast("int").alias("n"), r.alias("r"), F.concat(acc["out"], F.array(r)).alias("out"))

    return F.aggregate(cells, start, step, lambda a: a["out"])


def cluster_rows(cells: DataFrame, page: list[str], y: str, tie: str, tolerance: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Greedy 1-D clustering per page: a cell joins the row whose running mean is within the tolerance.

    A page's cells are folded in order of (y, tie); pages are bounded by what a page can show. Columns to
    `carry` come through the fold, so that they need no join.
    """
    fold = F.struct(F.col(y).cast("double").alias("y"), F.col(tie).cast("bigint").alias("tie"), F.col(tolerance).cast("double").alias("tol"), *carry)
    held = cells.groupBy(*page).agg(F.array_sort(F.collect_list(fold)).alias("_r"))
    zipped = F.zip_with("_r", row_numbers(F.col("_r")), lambda c, r: F.struct(c.alias("c"), r.alias("row_no")))
    flat = held.select(*page, F.explode(zipped).alias("_c"))
    return flat.select(*page, F.col("_c.c.tie").alias(tie), F.col("_c.c.y").alias(y), "_c.row_no", *(F.col(f"_c.c.{x}") for x in carry))


def gap_segments(df: DataFrame, group: list[str], order: list[str], low: str, high: str, gap) -> DataFrame:
    """Adds `segment`: a new one where `low` lies more than `gap` behind the previous row's `high`."""
    w = Window.partitionBy(*group).orderBy(*order)
    new = F.coalesce((F.col(low) - F.lag(high).over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn("_new", new).withColumn("segment", F.sum("_new").over(w).cast("int")).drop("_new")


def overlap_clusters(df: DataFrame, group: list[str], order: list[str], low: str, high: str) -> DataFrame:
    """Adds `cluster`: intervals merged while they begin before all earlier ones have ended."""
    w = Window.partitionBy(*group).orderBy(*order)
    reach = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col(low) > reach).cast("int"), F.lit(0))
    return df.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w).cast("int")).drop("_new")


def comb_runs(boxes: DataFrame, group: list[str], x: str, tie: str, side, least: int = 3) -> DataFrame:
    """Boxes that stand in no run of `least` or more neighbours closer than 1.8 sides: character combs go."""
    w = Window.partitionBy(*group).orderBy(x, tie)
    new = F.coalesce((F.col(x) - F.lag(x).over(w) > 1.8 * side).cast("int"), F.lit(0))
    runs = boxes.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return runs.withColumn("_n", F.count("*").over(Window.partitionBy(*group, "_run"))).where(F.col("_n") < least).drop("_new", "_run", "_n")


def nearest_line(marks: DataFrame, lines: DataFrame, page: list[str], mark: str, mark_y: str, line: str, line_y: str, limit=None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each mark's nearest line on its page, the one of the smallest number of equally near ones; beyond `limit` none.

    Marks and lines of a page are sorted together; the lines above and below a mark are running extremes of both
    directions, so no pair is emitted and no page is copied. Lines without a place count for no mark. Columns of the
    lines to `carry` come along, so that they need no join.
    """
    cols = marks.columns
    at = F.col(line_y).cast("double")
    kinds = {c: lines.schema[c].dataType for c in (line, *carry)}
    rest = {f"_c{i}": c for i, c in enumerate(carry)}
    a = marks.select(*cols, F.col(mark_y).cast("double").alias("_y"), F.lit(1).alias("_k"), F.lit(None).cast(kinds[line]).alias("_l"), *(F.lit(None).cast(kinds[c]).alias(n) for n, c in rest.items()))
    b = lines.where(at.isNotNull()).select(*(F.col(c) if c in page else F.lit(None).cast(marks.schema[c].dataType).alias(c) for c in cols), at.alias("_y"), F.lit(0).alias("_k"), F.col(line).alias("_l"), *(F.col(c).alias(n) for n, c in rest.items()))
    both = a.unionByName(b).withColumn("_s", F.when(F.col("_k") == 0, F.struct(F.col("_y").alias("y"), F.col("_l").alias("l"), *rest))).drop(*rest)
    seen = lambda y: F.last("_s", True).over(Window.partitionBy(*page).orderBy(y, "_k", F.desc("_l")).rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("_up", seen(F.asc("_y"))).withColumn("_down", seen(F.desc("_y")))
    far = lambda s: F.when(F.col(s).isNotNull() & F.col("_y").isNotNull(), F.struct(F.abs(F.col(f"{s}.y") - F.col("_y")).alias("d"), F.col(f"{s}.l").alias("l"), *(F.col(f"{s}.{n}").alias(n) for n in rest)))
    out = both.where("_k = 1").withColumn("_n", F.least(far("_up"), far("_down")))
    keep = F.lit(True) if limit is None else F.col("_n.d") <= limit
    return out.select(*cols, F.when(keep, F.col("_n.l")).alias(line), F.when(keep, F.col("_n.d")).alias("distance"), *(F.when(keep, F.col(f"_n.{n}")).alias(c) for n, c in rest.items()))


def inside(points: DataFrame, regions: DataFrame, page: list[str], keep: bool = True) -> DataFrame:
    """Rows whose centre (cx, cy) lies in a region (x0, y0, x1, y1) of their page, edges included; with `keep` off the others."""
    r = regions.select(*(F.col(c).alias(f"_{c}") for c in [*page, "x0", "y0", "x1", "y1"]))
    on = F.col("cx").between(F.col("_x0"), F.col("_x1")) & F.col("cy").between(F.col("_y0"), F.col("_y1"))
    for c in page:
        on = on & (F.col(c) == F.col(f"_{c}"))
    return points.join(r, on, "left_semi" if keep else "left_anti")


def assign_columns(cells: DataFrame, columns: DataFrame, table: list[str], cell: list[str]) -> DataFrame:
    """Each cell's column with the greatest positive overlap in x, the first on a tie. Columns of a table are few."""
    overlap = F.least("x1", "cx1") - F.greatest("x0", "cx0")
    pairs = cells.join(columns, table).withColumn("_o", overlap).where("_o > 0")
    return pairs.groupBy(*table, *cell).agg(F.max_by("col_no", F.struct("_o", -F.col("col_no"))).alias("col_no"))


def iou(a: tuple, b: tuple):
    """Intersection over union of two boxes (x0, y0, x1, y1); areas are at least 1."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda r: F.greatest(F.lit(1.0), (r[2] - r[0]) * (r[3] - r[1]))
    return w * h / F.greatest(F.lit(1.0), area(a) + area(b) - w * h)


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, right_at: str, value: str) -> DataFrame:
    """Adds the `value` of the last row of `right` at or before `at`, per group: one sort of both sides, no pairs."""
    cols = left.columns
    a = left.select(*cols, F.col(at).alias("_t"), F.lit(1).alias("_k"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    b = right.select(*[F.col(c) if c in by else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols], F.col(right_at).alias("_t"), F.lit(0).alias("_k"), F.col(value).alias("_v"))
    w = Window.partitionBy(*by).orderBy("_t", "_k", F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn(value, F.last("_v", True).over(w)).where("_k = 1").select(*cols, value)
