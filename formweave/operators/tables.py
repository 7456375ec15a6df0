"""Table operators: header rows, records, subsumption, HTML grids, dense matrices."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formweave.functions import text
from formweave.operators import matching


def header_rows(cells: DataFrame, table: list[str], most: int = 5, whole: bool = False, first: bool = True) -> DataFrame:
    """Adds `is_header`: leading rows, at most `most`, before the first in which half of the filled cells hold a digit.

    `whole`: cells count if all of them is a number. `first`: the first row is a header whatever it holds. Where a
    table's cells are tagged (column `kind`), the rows with a tagged cell are its headers instead. One window by table.
    """
    numeric = F.col("text").rlike(r"^\s*\d+(?:[.,]\d+)?\s*$" if whole else r"\d")
    filled = F.trim("text") != ""
    sheet = Window.partitionBy(*table)
    row = Window.partitionBy(*table, "row_no")
    stop = F.coalesce(F.avg(F.when(filled, numeric.cast("double"))).over(row), F.lit(0.0)) >= 0.5
    end = F.min(F.when(F.col("_stop"), F.col("row_no"))).over(sheet)
    lead = (F.col("row_no") < F.least(F.coalesce("_end", F.lit(most)), F.lit(most)))
    if first:
        lead = lead | (F.col("row_no") == 0)
    out = cells.withColumn("_stop", stop).withColumn("_end", end).withColumn("is_header", lead).drop("_stop", "_end")
    if "kind" in cells.columns:
        tagged = F.max((F.col("kind") == "columnHeader").cast("int"))
        out = out.withColumn("_t", F.coalesce(tagged.over(row), F.lit(0)) == 1).withColumn("is_header", F.when(F.coalesce(tagged.over(sheet), F.lit(0)) == 1, F.col("_t")).otherwise(F.col("is_header"))).drop("_t")
    return out


def header_map(cells: DataFrame, table: list[str], dictionary: DataFrame, contextual: DataFrame, dotted: bool = False, threshold: float = 0.82) -> DataFrame:
    """table, col_no, keyword: what the header cells of a column mean, each alone in order, then (if `dotted`) joined by slashes, then by blanks.

    `dotted`: only keywords of table columns count. `cells` carry is_header.
    """
    part = F.trim(F.regexp_replace(F.regexp_replace(text.clean_value(F.col("text")), r"^\*+\s*", ""), r"/+$", ""))
    heads = cells.where("is_header").withColumn("_t", part).where("_t <> ''")
    parts = heads.groupBy(*table, "col_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "_t"))), lambda x: x["_t"]).alias("_p"))
    joined = [F.array_join("_p", "/")] * dotted + [F.array_join("_p", " ")]
    tried = parts.select(*table, "col_no", F.posexplode(F.concat("_p", F.array(*joined))).alias("_o", "label")).withColumn("_c", F.lit(""))
    met = matching.match(tried, "label", "_c", matching.lookup(tried, "label", dictionary, contextual, threshold)).where("keyword is not null")
    met = met.where(F.col("keyword").contains(".")) if dotted else met
    return met.groupBy(*table, "col_no").agg(F.min_by("keyword", "_o").alias("keyword"))


def keyword_records(cells: DataFrame, table: list[str], columns: DataFrame, keep_empty: bool = False) -> DataFrame:
    """table, row_no, record: data rows as maps from keyword to text, by a header map; of columns with one keyword the last one counts.

    Empty values and rows without values go, unless `keep_empty`.
    """
    body = cells.where("not is_header").join(columns, [*table, "col_no"]).withColumn("_v", text.clean_value(F.col("text")))
    body = body if keep_empty else body.where("_v <> ''")
    one = body.groupBy(*table, "row_no", "keyword").agg(F.max_by(F.struct("col_no", F.col("_v").alias("v")), "col_no").alias("c"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("c.col_no", "keyword", "c.v"))), lambda x: F.struct(x["keyword"], x["v"]))
    return one.groupBy(*table, "row_no").agg(F.map_from_entries(packed).alias("record"))


def dense(cells: DataFrame, table: list[str]) -> DataFrame:
    """table, header, rows: each table as a matrix without holes; the first of several rows is the header, line feeds become blanks."""
    wide = F.max("col_no").over(Window.partitionBy(*table))
    text_ = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" "))
    rows = cells.withColumn("_n", wide).groupBy(*table, "row_no", "_n").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("col_no", text_.alias("t"))))).alias("_c"))
    line = F.transform(F.sequence(F.lit(0), F.col("_n")), lambda i: F.coalesce(F.try_element_at("_c", i), F.lit("")))
    packed = rows.groupBy(*table).agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", line.alias("l")))), lambda x: x["l"]).alias("_r"))
    many = F.size("_r") > 1
    return packed.select(*table, F.when(many, F.col("_r")[0]).alias("header"), F.when(many, F.slice("_r", 2, F.size("_r"))).otherwise(F.col("_r")).alias("rows"))


def records(cells: DataFrame, table: list[str]) -> DataFrame:
    """Data rows as maps from column caption to text; empty values and rows without values are left out."""
    names = cells.where("is_header").groupBy(*table, "col_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "text"))), lambda x: x["text"]), " ").alias("name"))
    body = cells.where("not is_header and text <> ''").join(names, [*table, "col_no"])
    # of columns with one name the first one counts
    body = body.groupBy(*table, "row_no", "name").agg(F.min(F.struct("col_no", "text")).alias("_c")).select(*table, "row_no", "name", "_c.col_no", "_c.text")
    packed = F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "name", "text"))), lambda x: F.struct(x["name"], x["text"])))
    return body.groupBy(*table, "row_no").agg(packed.alias("record"))


def subsumed(tables: pd.DataFrame) -> pd.DataFrame:
    """Names of tables whose columns and rows are all part of a kept table, by number of rows, stable."""
    kept: list[tuple[set, list[set]]] = []
    gone = []
    for _, t in tables.sort_values("n_rows", ascending=False, kind="stable").iterrows():
        cols, rows = set(t["columns"]), [set(map(tuple, r.items())) for r in t["rows"]]
        wide = [r for r in rows if len(r) >= 2]
        if wide and any(cols <= c and all(any(r <= k for k in ks) for r in wide) for c, ks in kept):
            gone.append(t["name"])
        else:
            kept.append((cols, rows))
    return pd.DataFrame({"name": gone})


#: Columns or rows that one cell fills at most, as browsers bound it.
MOST_SPAN = 1000


class _Grid(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[tuple[str, int, int]]] = []
        self.text: list[str] | None = None
        self.span = (1, 1)
        self.depth, self.done = 0, False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.depth += tag == "table"
        if self.done:
            return
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            got = dict(attrs)
            number = lambda k: min(MOST_SPAN, max(1, int(got[k]))) if (got.get(k) or "").isdecimal() else 1
            self.text, self.span = [], (number("rowspan"), number("colspan"))

    def handle_data(self, data: str) -> None:
        if self.text is not None:
            self.text.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag == "table":
            self.depth -= 1
            self.done = self.done or self.depth <= 0
        if tag in ("td", "th") and self.text is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append((" ".join("".join(self.text).split()), *self.span))
            self.text = None


def grid(html: str) -> list[list[str]]:
    """The first table's text with row and column spans filled in; rows are padded to one width."""
    parser = _Grid()
    parser.feed(html or "")
    filled: dict[tuple[int, int], str] = {}
    for r, row in enumerate(parser.rows):
        c = 0
        for content, down, right in row:
            while (r, c) in filled:
                c += 1
            for i in range(min(down, len(parser.rows) - r)):
                for j in range(right):
                    filled.setdefault((r + i, c + j), content)
            c += right
    width = max((c for _, c in filled), default=-1) + 1
    return [[filled.get((r, c), "") for c in range(width)] for r in range(len(parser.rows))]


def html_cells(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, row_no, col_no, text of the expanded grid of each row's table."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(k, r, c, t) for k, h in zip(batch[key], batch[html], strict=True) for r, row in enumerate(grid(h)) for c, t in enumerate(row)]
            yield pd.DataFrame(out, columns=[key, "row_no", "col_no", "text"])

    return pages.select(key, html).mapInPandas(rows, f"{key} bigint, row_no int, col_no int, text string")
