"""Long-to-wide category sums, and regex column selection.

Category columns are numbered while they are worked on and named last, so any
spelling of a category can be a column (see :mod:`pozo.operators.names`).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pozo.functions.nulls import strict_sum
from pozo.operators.names import unique_names

# Column name a NULL category gets (as R names it).
NULL_CATEGORY_NAME = "NA"


def category_names(categories: Sequence[str | None], null_name: str = NULL_CATEGORY_NAME) -> list[str]:
    return [null_name if c is None else c for c in categories]


def is_category(category: str, cat: str | None) -> Column:
    """Whether a row is of one category, letter for letter (None: no category)."""
    return F.col(category).isNull() if cat is None else F.col(category) == F.lit(cat)


def pivot_sums(df: DataFrame, key: str, category: str, value: str,
               categories: Sequence[str | None], extra_aggs: Sequence[Column] = (),
               null_name: str = NULL_CATEGORY_NAME) -> DataFrame:
    """One row per ``key`` and one strict-sum column per category.

    Equivalent to summing per (key, category) and pivoting wider: a cell is
    NULL when the key has no row of that category, or when any contributing
    value is NULL. Written as conditional aggregates, it is one partial +
    final aggregation with one shuffle on ``key`` (the generic pivot needs
    two), and the category list fixes the schema even for an empty input.
    Categories that differ in case are columns of their own; two columns of
    the very same name raise an error.
    """
    names = unique_names([key, *category_names(categories, null_name)])
    cols = [strict_sum(value, where=is_category(category, c)).alias(f"_c{i}") for i, c in enumerate(categories)]
    out = df.groupBy(key).agg(*cols, *extra_aggs)
    return out.toDF(*names, *out.columns[len(names):])


def pivot_grain(grain: DataFrame, key: str, category: str, cell: Column,
                categories: Sequence[str | None]) -> DataFrame:
    """``grain`` (one row per key and category) made wide: ``key`` and ``_c0``, ``_c1``, ... with each category's ``cell``."""
    return grain.groupBy(key).agg(*[F.max(F.when(is_category(category, c), cell)).alias(f"_c{i}")
                                    for i, c in enumerate(categories)])


def matching(names: Sequence[str], pattern: str, ignore_case: bool = True) -> list[str]:
    """Those of ``names`` that contain a match of ``pattern``; may be none."""
    rx = re.compile(pattern, re.IGNORECASE if ignore_case else 0)
    return [n for n in names if rx.search(n)]


def select_matching(df: DataFrame, pattern: str, ignore_case: bool = True) -> list[str]:
    """Names of the columns whose name contains a match of ``pattern``.

    Unanchored and case-insensitive by default; may return no column.
    """
    return matching(df.columns, pattern, ignore_case)
