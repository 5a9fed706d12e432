"""Indel similarity of strings: 200 * LCS / (|a| + |b|).

A pair of labels can reach a threshold t only if the shorter has t / (200 - t) of the longer one's length, which joins use
before the exact value. That comes from an Arrow UDF, since Spark has Levenshtein (where a replacement costs 1, not 2) but no LCS."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence; the bits of a number are the characters of a."""
    masks: dict[str, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        if m := masks.get(x):
            u = v & m
            v = (v + u) | (v - u)
    return len(a) - (v & full).bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def ratio_of(a: Column, b: Column) -> Column:
    return F.pandas_udf(_ratio, DoubleType())(a, b)


def lengths_allow(a: Column, b: Column, threshold: float) -> Column:
    """Whether the lengths leave the threshold in reach; cheap, and never wrong."""
    return F.least(F.length(a), F.length(b)) * (200 - threshold) >= threshold * F.greatest(F.length(a), F.length(b)) - 1e-6
