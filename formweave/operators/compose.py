"""Whole extractions composed from the single operators: priorities among extractors, tables, columns, and plausibility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formweave.functions import text
from formweave.operators import fields, marks, matching

#: Texts that only a selection may hold, and the kinds of field that are selections.
SELECTION_TOKENS = ("YES", "NO", "TRUE", "FALSE", "SELECTED", "UNSELECTED", "- [X]", "- [ ]", "- (●)", "- ( )")
SELECTION_KINDS = ("yesno", "checkbox", "option")


def promoted(cells: DataFrame, kinds: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, keyword, value: the first non-empty cell of each keyword by table and row; a selection's word only for selections.

    `cells` have key, table_no, row_no, keyword and value.
    """
    known = cells.where(F.trim("value") != "").join(matching.small(kinds), "keyword")
    fits = ~F.upper(F.trim("value")).isin(*SELECTION_TOKENS) | F.col("kind").isin(*SELECTION_KINDS)
    return known.where(fits).groupBy(key, "keyword").agg(F.min_by("value", F.struct("table_no", "row_no", "value")).alias("value"))


def by_priority(sources: list[tuple[str, DataFrame]], docs: DataFrame, keywords: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, keyword, value, source of every keyword of every document: the first source, in the order given, that has a value."""
    every = None
    for i, (name, values) in enumerate(sources):
        part = values.select(key, "keyword", "value", F.lit(i).alias("_p"), F.lit(name).alias("source"))
        every = part if every is None else every.unionByName(part)
    best = every.where("value <> ''").groupBy(key, "keyword").agg(F.min_by(F.struct("value", "source"), F.struct("_p", "value")).alias("_b"))
    flat = best.select(key, "keyword", "_b.value", "_b.source")
    return fields.canonical(flat, docs, keywords, key).withColumn("source", F.coalesce("source", F.lit("not-found")))


def claim_columns(values: DataFrame, claims: DataFrame, order: list[str], key: str = "doc_id") -> DataFrame:
    """Values after captions standing over a value have claimed it, in the order of the keywords.

    A claim fills an empty field only, and other fields with the very same text become empty. The fold runs
    over the fields of one document, whose number is that of the dictionary.
    """
    place = F.array_position(F.array(*map(F.lit, order)), F.col("keyword")).cast("int")
    held = values.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("keyword", "value"))).alias("_v"))
    wanted = claims.where("value <> ''").withColumn("_o", place).where("_o > 0").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_o", "keyword", "value"))).alias("_c"))
    both = held.join(wanted, key, "left").withColumn("_c", F.coalesce("_c", F.array().cast("array<struct<_o:int,keyword:string,value:string>>")))

    def step(fields_, claim):
        empty = F.exists(fields_, lambda f: (f["keyword"] == claim["keyword"]) & (f["value"] == ""))

        def settle(f):
            taken = F.when(f["keyword"] == claim["keyword"], claim["value"]).when(f["value"] == claim["value"], "").otherwise(f["value"])
            return F.struct(f["keyword"].alias("keyword"), taken.alias("value"))

        return F.when(empty, F.transform(fields_, settle)).otherwise(fields_)

    return both.select(key, F.explode(F.aggregate("_c", F.col("_v"), step)).alias("_f")).select(key, "_f.keyword", "_f.value")


def plausible(values: DataFrame, lines: DataFrame, dictionary: DataFrame, protected: tuple[str, ...] = (), most: int = 2, key: str = "doc_id") -> DataFrame:
    """Values that are another field's caption, or stand more than `most` lines from their own caption, become empty.

    Distances are 0 where the caption or the value is on no line. Protected keywords keep what they have.
    """
    open_ = values.where((F.col("value") != "") & ~F.col("keyword").isin(*protected))
    named = matching.exact(open_.withColumnRenamed("keyword", "_own").withColumn("_head", text.before_colon(F.col("value"))), "_head", dictionary)
    caption = named.where("keyword is not null and keyword <> _own").select(key, F.col("_own").alias("keyword"), F.lit(True).alias("_other"))
    own = matching.exact(lines.withColumn("_head", text.before_colon(F.col("line"))), "_head", dictionary).where("keyword is not null").select(key, "keyword", F.col("line_no").alias("row_no"))
    # a document's lines meet its values, whose number is that of the dictionary
    wanted = open_.select(key, "keyword", text.normalize_label(F.col("value")).alias("_n")).where("_n <> ''")
    seen = lines.select(key, "line_no", text.normalize_label(F.col("line")).alias("_l")).join(wanted, key).where(F.col("_l").contains(F.col("_n"))).select(key, "keyword", F.col("line_no").alias("row_no"))
    far = marks.caption_gaps(own, seen, [key, "keyword"]).where(F.col("gap") > most).select(key, "keyword", F.lit(True).alias("_far"))
    open_keys = open_.select(key, "keyword", F.lit(True).alias("_open"))
    judged = values.join(caption, [key, "keyword"], "left").join(far.join(open_keys, [key, "keyword"]), [key, "keyword"], "left")
    gone = F.coalesce(F.col("_other"), F.col("_far"), F.lit(False))
    return judged.withColumn("value", F.when(gone, "").otherwise(F.col("value"))).drop("_other", "_far", "_open")


#: Order in which a blank form's fields are named; captions found by layout count only without key-value pairs.
STAGES = ("key_value", "mark", "layout", "rejected_table")


def form_schema(candidates: DataFrame, columns: DataFrame, key: str = "doc_id", most_words: int = 28) -> DataFrame:
    """key, field_no, field, label, kind, stage of a blank form: named fields first, then `table.column` of its tables.

    `candidates` have key, stage, ord, label and context. A repeated caption is named by its context. Prose is no
    field unless it is a mark's statement; captions that a table column owns are none either. Of equal names the
    first stays. `columns` have key, table_name, ord, column and label.
    """
    stage = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage")).cast("int")
    name = text.camel_name(F.when(F.col("context") != "", F.concat_ws(" ", "context", "label")).otherwise(F.col("label")))
    staged = candidates.withColumn("_s", stage).withColumn("field", name).where((F.col("label") != "") & (F.col("field") != ""))
    pairs = staged.where("stage = 'key_value'").select(key).distinct().withColumn("_kv", F.lit(True))
    fits = (text.word_count(F.col("label")) <= most_words) & (~text.prose(F.col("label")) | (F.col("stage") == "mark"))
    owned = columns.select(key, F.upper(F.trim("label")).alias("_up")).where("_up <> ''").distinct()
    open_ = staged.join(pairs, key, "left").where(fits & ((F.col("stage") != "layout") | F.col("_kv").isNull()))
    open_ = open_.withColumn("_up", F.upper(F.trim("label"))).join(owned, [key, "_up"], "left_anti")
    first = open_.groupBy(key, "field").agg(F.min(F.struct("_s", "ord", "label", "stage")).alias("_f"))
    singles = first.select(key, "field", F.col("_f._s").alias("_s"), F.col("_f.ord").cast("bigint").alias("ord"), F.col("_f.label").alias("label"), text.text_type(F.col("_f.label")).alias("kind"), F.col("_f.stage").alias("stage"))
    dotted = columns.select(key, F.concat_ws(".", "table_name", "column").alias("field"), F.lit(len(STAGES) + 1).alias("_s"), F.col("ord").cast("bigint").alias("ord"), "label", F.lit("text").alias("kind"), F.lit("table").alias("stage"))
    dotted = dotted.groupBy(key, "field").agg(F.min(F.struct("_s", "ord", "label", "kind", "stage")).alias("_f")).select(key, "field", "_f.*")
    every = singles.unionByName(dotted).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_s", "ord", "field", "label", "kind", "stage"))).alias("_a"))
    return every.select(key, F.posexplode("_a").alias("field_no", "_f")).select(key, "field_no", "_f.field", "_f.label", "_f.kind", "_f.stage")
