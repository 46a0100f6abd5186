"""The two NULL rules for sums the reports use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lenient_sum(c) -> Column:
    """Sum ignoring NULLs; a group of only NULLs sums to 0 (R ``na.rm=TRUE``)."""
    col = F.col(c) if isinstance(c, str) else c
    # The literal 0 widens to the sum's decimal type; the scale is kept.
    return F.coalesce(F.sum(col), F.lit(0))


def strict_sum(c, where: Column | None = None) -> Column:
    """Sum that is NULL when any contributing value is NULL (R ``sum`` default).

    With ``where``, only rows satisfying it contribute, and a group with no
    such row gives NULL too (a missing pivot cell). Stays a plain partial
    aggregate: three counters and a sum, merged map-side.
    """
    col = F.col(c) if isinstance(c, str) else c
    if where is None:
        return F.when(F.count(col) == F.count(F.lit(1)), F.sum(col))
    v = F.when(where, col)
    n_rows = F.count(F.when(where, F.lit(1)))
    return F.when((n_rows > 0) & (F.count(v) == n_rows), F.sum(v))
