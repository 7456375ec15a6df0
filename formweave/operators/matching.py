"""Joins of captions with the field dictionary.

A dictionary is configuration and small, but its size is not assumed: `small` adds a broadcast hint only
below a checked number of rows, and equi-joins need none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formweave.functions import similarity, text

BROADCAST_ROWS = 100_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the table has at most `most` rows; counting stops there."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def exact(labels: DataFrame, label: str, dictionary: DataFrame) -> DataFrame:
    """Adds `keyword`: the first in configured order whose alias equals the normalised label, else null."""
    first = dictionary.groupBy(F.col("alias_norm").alias("_a")).agg(F.min_by("keyword", "ord").alias("keyword"))
    return labels.join(first, text.normalize_label(F.col(label)) == F.col("_a"), "left").drop("_a")


def _similar(norm: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """label_norm, alias_norm, score of the pairs that reach `least`; lengths, then letters, rule out most before any is compared."""
    la, an = F.col("label_norm"), F.col("alias_norm")
    left = norm.withColumn("_lc", similarity.letter_counts(la))
    right = small(names.withColumn("_ac", similarity.letter_counts(an)))
    pairs = left.join(right, similarity.upper_bound(la, an) >= least).where(similarity.letter_bound(la, an, F.col("_lc"), F.col("_ac")) >= least)
    return pairs.select("label_norm", "alias_norm").withColumn("score", similarity.ratio("label_norm", "alias_norm")).where(F.col("score") >= least)


def _asked(alias: Column, threshold: float, tolerant: bool) -> Column:
    return text.tolerant_threshold(F.length(alias), threshold) if tolerant else F.lit(threshold)


def fuzzy(labels: DataFrame, label: str, dictionary: DataFrame, threshold: float = 0.82, tolerant: bool = True) -> DataFrame:
    """Distinct labels with the keyword and score of the most similar alias, where that alias passes.

    Pairs are pruned with the least threshold that any alias may have, so that the winner is the winner over all aliases.
    """
    norm = labels.select(text.normalize_label(F.col(label)).alias("label_norm")).distinct()
    least = min(threshold, 0.88) if tolerant else threshold
    scored = _similar(norm, dictionary.select("alias_norm").distinct(), least).join(small(dictionary), "alias_norm")
    best = scored.groupBy("label_norm").agg(F.max_by(F.struct("keyword", "alias_norm", "score"), F.struct("score", -F.col("ord"))).alias("b"))
    return best.where(F.col("b.score") >= _asked(F.col("b.alias_norm"), threshold, tolerant)).select("label_norm", "b.keyword", F.col("b.score").alias("score"))


def lookup(labels: DataFrame, label: str, dictionary: DataFrame, contextual: DataFrame, threshold: float = 0.82, tolerant: bool = True) -> DataFrame:
    """label_norm, plain, anchored: what each distinct label can mean, with and without a context.

    `plain` is the keyword of the most similar alias, `anchored` the contextual aliases near the label, at most as many as the dictionary has.
    """
    norm = labels.select(text.normalize_label(F.col(label)).alias("label_norm")).where("label_norm <> ''").distinct()
    least = min(threshold, 0.88) if tolerant else threshold
    plain = dictionary.select("alias_norm", "keyword", "ord", F.lit(None).cast("string").alias("context_norm"))
    every = plain.unionByName(contextual.select(F.col("label_norm").alias("alias_norm"), "keyword", "ord", "context_norm"))
    scored = _similar(norm, every.select("alias_norm").distinct(), least).join(small(every), "alias_norm")
    entry = F.struct("score", (-F.col("ord")).alias("o"), "keyword", (F.col("score") >= _asked(F.col("alias_norm"), threshold, tolerant)).alias("passes"), "context_norm")
    best = F.max(F.when(F.col("context_norm").isNull(), entry))
    got = scored.groupBy("label_norm").agg(best.alias("_b"), F.collect_list(F.when(F.col("context_norm").isNotNull(), entry)).alias("anchored"))
    return got.select("label_norm", F.when(F.col("_b.passes"), F.col("_b.keyword")).alias("plain"), "anchored").where("plain is not null or size(anchored) > 0")


def match(rows: DataFrame, label: str, context: str, looked: DataFrame, into: str = "keyword", tolerant: bool = True) -> DataFrame:
    """Adds `into`: the keyword that a label means in its context, an anchored one before a plain one, else null.

    The context must hold the anchor's phrase, or, if `tolerant`, the greater part of it.
    """
    near = F.col("_near")
    held = text.has_context if tolerant else lambda hay, phrase: (phrase != "") & hay.contains(phrase)
    best = F.array_max(F.filter("anchored", lambda c: held(near, c["context_norm"])))
    joined = rows.withColumn("_norm", text.normalize_label(F.col(label))).withColumn("_near", text.normalize_label(F.coalesce(F.col(context), F.lit(""))))
    joined = joined.join(looked, F.col("_norm") == F.col("label_norm"), "left").withColumn("_best", best)
    return joined.withColumn(into, F.coalesce(F.when(F.col("_best.passes"), F.col("_best.keyword")), F.col("plain"))).drop("_norm", "_near", "_best", "label_norm", "plain", "anchored")


def match_variants(rows: DataFrame, label: str, context: str, key: list[str], dictionary: DataFrame, contextual: DataFrame, threshold: float = 0.82, tolerant: bool = False) -> DataFrame:
    """Adds `keyword`: that of the first variant of a label (see `label_variants`) that means one. `key` names a row."""
    tried = rows.select(*key, F.col(context).alias("_c"), F.posexplode(text.label_variants(F.col(label))).alias("_v", "_l"))
    met = match(tried, "_l", "_c", lookup(tried, "_l", dictionary, contextual, threshold, tolerant), tolerant=tolerant).where("keyword is not null")
    first = met.groupBy(*key).agg(F.min_by("keyword", "_v").alias("keyword"))
    return rows.join(first, key, "left")


def contained(labels: DataFrame, label: str, dictionary: DataFrame, least: int = 6) -> DataFrame:
    """Label, keyword and longest alias of the keyword that the label contains."""
    d = small(dictionary.where(F.length("alias_norm") >= least))
    norm = labels.withColumn("label_norm", text.normalize_label(F.col(label)))
    hits = norm.join(d, F.col("label_norm").contains(F.col("alias_norm")))
    return hits.groupBy(*labels.columns, "keyword").agg(F.max(F.length("alias_norm")).cast("int").alias("alias_length"))


def covered(labels: DataFrame, label: str, dictionary: DataFrame, least: int = 6, share: float = 0.5) -> DataFrame:
    """Label and the keyword of the longest alias that contains it or is contained, at half its length or more."""
    d = small(dictionary.where(F.length("alias_norm") >= least))
    norm = labels.withColumn("label_norm", text.normalize_label(F.col(label))).where(F.length("label_norm") >= least)
    ln, an = F.col("label_norm"), F.col("alias_norm")
    cover = F.least(F.length(ln), F.length(an)) / F.greatest(F.length(ln), F.length(an))
    hits = norm.join(d, (ln.contains(an) | an.contains(ln)) & (cover >= share))
    return hits.groupBy(*labels.columns).agg(F.max_by("keyword", F.struct(F.length("alias_norm"), -F.col("ord"))).alias("keyword"))


def _listed(dictionary: DataFrame, *columns: str) -> list | None:
    """The distinct rows of a dictionary up to BROADCAST_ROWS, to ride along as an array; None for a larger one."""
    rows = dictionary.select(*columns).distinct().orderBy(*columns).limit(BROADCAST_ROWS + 1).collect()
    return None if len(rows) > BROADCAST_ROWS else rows


def covering(labels: DataFrame, label: str, dictionary: DataFrame, least: int = 6, share: float = 0.5) -> DataFrame:
    """Adds `keyword` as `covered` finds it, else null.

    The aliases ride along as an array, in one projection; a dictionary too large for that is joined with the distinct labels.
    """
    rows = _listed(dictionary.where(F.length("alias_norm") >= least), "ord", "alias_norm", "keyword")
    if rows is None:
        norm = labels.withColumn("_n", text.normalize_label(F.col(label)))
        found = covered(norm.select("_n").distinct(), "_n", dictionary, least, share).withColumnRenamed("_n", "_m")
        return norm.join(found, F.col("_n") == F.col("_m"), "left").drop("_n", "_m")
    if not rows:
        return labels.withColumn("keyword", F.lit(None).cast("string"))
    aliases = F.array(*(F.struct(F.lit(r["alias_norm"]).alias("a"), F.lit(r["keyword"]).alias("k"), F.lit(int(r["ord"])).alias("o")) for r in rows))
    n = F.col("_n")

    def hit(x):
        cover = F.least(F.length(n), F.length(x["a"])) / F.greatest(F.length(n), F.length(x["a"]))
        return (n.contains(x["a"]) | x["a"].contains(n)) & (cover >= share)

    best = F.array_max(F.transform(F.filter(aliases, hit), lambda x: F.struct(F.length(x["a"]).alias("l"), (-x["o"]).alias("o"), x["k"].alias("k"))))
    return labels.withColumn("_n", text.normalize_label(F.col(label))).withColumn("keyword", F.when(F.length("_n") >= least, best["k"])).drop("_n")


def furniture(labels: DataFrame, label: str, dictionary: DataFrame, least: int = 6, share: float = 0.5, fragment: int = 8) -> DataFrame:
    """Adds `furniture`: in parentheses, an alias, half filled by an alias, or an 8-character part of one.

    The aliases ride along as one array, so lines are neither joined nor multiplied; a dictionary too large
    for that is joined with the distinct labels.
    """
    rows = _listed(dictionary, "alias_norm")
    norm = text.normalize_label(F.col(label))
    paren = text.clean_value(F.col(label)).rlike(r"^\(.*\)$")

    def near(n: Column, a: Column) -> Column:
        return (a == n) | ((F.length(a) >= least) & n.contains(a) & (F.length(a) >= share * F.length(n))) | ((F.length(n) >= fragment) & a.contains(n))

    if rows is None:
        held = labels.withColumn("_n", norm)
        hits = held.select(F.col("_n").alias("_m")).distinct().join(dictionary.select("alias_norm").distinct(), near(F.col("_m"), F.col("alias_norm"))).select("_m").distinct()
        joined = held.join(hits, F.col("_n") == F.col("_m"), "left")
        return joined.withColumn("furniture", (F.col("_n") != "") & (paren | F.col("_m").isNotNull())).drop("_n", "_m")
    aliases = F.array(*(F.lit(r[0]) for r in rows)) if rows else F.array().cast("array<string>")
    return labels.withColumn("furniture", (norm != "") & (paren | F.exists(aliases, lambda a: near(norm, a))))
