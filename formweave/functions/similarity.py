"""Sequence similarity, which has no built-in: an Arrow-batched function over distinct pairs."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all characters; the order of the arguments matters."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def upper_bound(a: Column, b: Column) -> Column:
    """No ratio exceeds it: twice the shorter length over both lengths."""
    la, lb = F.length(a), F.length(b)
    return F.when(la + lb > 0, 2 * F.least(la, lb) / (la + lb)).otherwise(1.0)


def letter_counts(c: Column, alphabet: str = "abcdefghijklmnopqrstuvwxyz0123456789") -> Column:
    """How often each letter of the alphabet is in a text."""
    return F.transform(F.array(*map(F.lit, alphabet)), lambda x: F.length(c) - F.length(F.replace(c, x, F.lit(""))))


def letter_bound(a: Column, b: Column, counts_a: Column, counts_b: Column) -> Column:
    """No ratio of texts in that alphabet exceeds it: twice the letters that both have, in any order, over both lengths."""
    shared = F.aggregate(F.zip_with(counts_a, counts_b, lambda x, y: F.least(x, y)), F.lit(0), lambda n, x: n + x)
    both = F.length(a) + F.length(b)
    return F.when(both > 0, 2 * shared / both).otherwise(1.0)
