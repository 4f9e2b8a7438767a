"""Similarity of names; the only functions here that run Python, in Arrow batches."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


@pandas_udf(DoubleType())
def ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff/Obershelp similarity of two columns of strings; null if either is."""
    for left, right in pairs:
        yield pd.Series([None if a is None or b is None else difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)], dtype="float64")


def can_reach(left: Column, right: Column, least: float) -> Column:
    """Whether the lengths alone allow a ratio of ``least``: at best twice the shorter over the sum."""
    from pyspark.sql import functions as F

    return F.least(F.length(left), F.length(right)) * 2 >= (F.length(left) + F.length(right)) * least
