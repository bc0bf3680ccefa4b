"""Evaluate-once helpers.

The optimizer pushes a filter below the projection that computes its input and
copies the expression while doing so. For costly expressions that means
evaluating them several times per row. A lambda variable is a bound value, and
a generator is a boundary filters do not cross; both keep the work single.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def select_where(df: DataFrame, keep: list, computed: Column, condition: Callable[[Column], Column]) -> DataFrame:
    """``keep`` plus the fields of the struct ``computed``, for rows where ``condition`` holds on it."""
    return df.select(*keep, F.inline(F.filter(F.array(computed), condition)))
