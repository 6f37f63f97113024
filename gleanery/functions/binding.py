"""Evaluate an expression once and use the value many times.

Catalyst inlines a derived column into every filter that is pushed below it.  For regular
expressions and parsers that turns one evaluation into dozens, so costly values are bound.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated a single time."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """Add or replace columns through a one-row generator, which filters are not pushed through."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))
