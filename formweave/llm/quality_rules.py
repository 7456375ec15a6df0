"""Quality rules: a threshold table compiled into one projection over length, symbol, stop-word and line ratios.

Every measure is a built-in expression over the whole text, so the verdict is one Spark projection
without user functions and without a shuffle.

Defined cases: null and empty texts have no words, every measure is 0 and they fail on length.
Ratios over nothing are 0. A measure that equals its bound passes. Very long texts are measured whole.
Repeated rows are judged each, with null doc_ids as with others. An empty table gives an empty result.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to a in is that for it was on with be as by this are at from "
    "de la le et les des un du une que pour est qui dans par pas au sur avec "
    "der die und den von zu das sich mit auf für ist nicht im dem ein eine als "
    "el los se del las por no con su es para al y en"
).split()


@dataclass(frozen=True)
class Threshold:
    """A text passes if `low <= measure <= high`; an absent bound is open."""

    measure: str
    low: float | None = None
    high: float | None = None


#: Lenient bounds: they reject symbol soup, shouting, tables of contents and texts without function words.
THRESHOLDS = (
    Threshold("mean_word_length", 2.0, 18.0),
    Threshold("symbol_ratio", None, 0.2),
    Threshold("stop_word_ratio", 0.02, None),
    Threshold("dup_line_ratio", None, 0.5),
    Threshold("upper_ratio", None, 0.6),
    Threshold("bang_ratio", None, 0.4),
)

_WS = "\\x20\\x09-\\x0D"


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def window_hashes(words: Column, k: int) -> Column:
    """64-bit hashes of all k-word windows: each word is hashed once, and neighbouring windows are combined by doubling."""

    def combine(h: Column, shift: int) -> Column:
        n = F.greatest(F.size(h) - shift, F.lit(0))
        return F.zip_with(F.slice(h, 1, n), F.slice(h, 1 + shift, n), lambda x, y: F.xxhash64(x, y))

    def grow(h: Column, width: int) -> Column:
        if width == k:
            return h
        # two overlapping windows that cover k words name them as well
        shift = min(width, k - width)
        return _let(combine(h, shift), lambda g: grow(g, width + shift))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: grow(h, 1))


def repeated_words(words: Column, k: int = 8) -> Column:
    """Words inside k-word windows that occur twice or more in the array, the first included.

    Windows are compared by their 64-bit hash: two different windows of one text of n words collide
    with a chance below n*n/2^64. Where all windows differ, which is the usual case, nothing is sorted.
    """

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.zip_with(h, F.sequence(F.lit(0), F.size(h) - 1), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            size = F.size(s)
            at = F.filter(
                F.sequence(F.lit(0), size - 1),
                lambda i: ((i > 0) & (F.get(s, i - 1)["h"] == F.get(s, i)["h"])) | ((i < size - 1) & (F.get(s, i + 1)["h"] == F.get(s, i)["h"])),
            )
            return F.sort_array(F.transform(at, lambda i: F.get(s, i)["i"]))

        def length(b: Column) -> Column:
            gaps = F.zip_with(F.slice(b, 2, F.greatest(F.size(b), F.lit(1))), b, lambda y, x: F.when(y.isNotNull(), F.least(y - x, F.lit(k))).otherwise(F.lit(k)))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, x: acc + x)

        return _let(_let(pairs, starts), length)

    # with k words there is one window
    return F.when(F.size(words) <= k, F.lit(0).cast("long")).otherwise(
        _let(window_hashes(words, k), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    )


def _let(value: Column, body) -> Column:
    """Evaluates `value` once and passes it to `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def measures(text: Column) -> Column:
    """All counts and ratios of a text as one struct."""
    text = F.coalesce(text, F.lit(""))

    def of(words: Column) -> Column:
        n = F.size(words).cast("long")
        chars = F.aggregate(words, F.lit(0).cast("long"), lambda acc, w: acc + F.length(w))
        symbols = F.regexp_count(text, F.lit("[" + SYMBOLS.replace("&", "\\&") + "]")).cast("long")
        lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{_WS}]"))
        stop = F.size(F.filter(words, lambda w: F.rtrim(F.lower(w), F.lit(".,;:!?#*$%&")).isin(*STOP_WORDS)))

        def with_lines(ls: Column) -> Column:
            dup = (F.size(ls) - F.size(F.array_distinct(ls))).cast("long")
            upper = F.regexp_count(text, F.lit("[A-Z]"))
            bang = F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))
            return F.struct(
                n.alias("n_words"),
                chars.alias("word_chars"),
                symbols.alias("n_symbols"),
                dup.alias("n_dup_lines"),
                repeated_words(words).alias("n_repeat_words"),
                _ratio(chars, n).alias("mean_word_length"),
                _ratio(symbols, chars).alias("symbol_ratio"),
                _ratio(stop, n).alias("stop_word_ratio"),
                _ratio(dup, F.size(ls)).alias("dup_line_ratio"),
                _ratio(upper, chars).alias("upper_ratio"),
                _ratio(bang, n).alias("bang_ratio"),
            )

        return _let(lines, with_lines)

    # the split leaves an empty string before a leading and after a trailing separator
    return _let(F.filter(F.split(text, f"[{_WS}]+"), lambda w: w != ""), of)


def compile_table(thresholds: tuple[Threshold, ...], m: Column) -> Column:
    """One boolean expression: all thresholds hold on the struct of measures."""
    ok = F.lit(True)
    for t in thresholds:
        if t.low is not None:
            ok = ok & (m[t.measure] >= t.low)
        if t.high is not None:
            ok = ok & (m[t.measure] <= t.high)
    return ok


def judge(docs: DataFrame, thresholds: tuple[Threshold, ...] = THRESHOLDS, min_words: int = 20, repeat_percent: int = 30) -> DataFrame:
    """doc_id, measures, base_failed and kept of every document."""
    m = F.col("_qr")
    base = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > repeat_percent * m["n_words"])
    return docs.select("doc_id", measures(F.col("text")).alias("_qr")).select(
        "doc_id", "_qr.*", base.alias("base_failed"), (~base & compile_table(thresholds, m)).alias("kept")
    )
