"""Search, sort and paging for report tables, with the interactive table's rules.

Search: a row is kept when any column matches the query. Numbers match when
their printed text starts with the query; every other type matches when its
lower-cased text contains the lower-cased query. The query is literal text,
never a pattern.

Sort: text compares lower-cased; NULL is the smallest value (first going up,
last going down); extra tie-break columns make the order total.

Paging: every page, shallow or deep, is cut from one total order (the sort
columns, then a hash of the row), so pages never overlap, and only the rows
around the page are sorted (see :func:`page_rows`).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pozo.functions.text import js_number_text
from pozo.operators.names import Exact
from pozo.operators.ranking import positions

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
            T.FloatType, T.DoubleType, T.DecimalType)


def _number_text(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        # Plain notation (no exponent), like the browser for ordinary amounts;
        # values beyond the decimal range keep Spark's own text.
        return F.coalesce(js_number_text(c.try_cast("decimal(38,9)")), c.cast("string"))
    return js_number_text(c)


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def search_rows(df: DataFrame, query: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of ``df`` where any of ``columns`` (default: all) matches ``query``."""
    if query is None or query == "":
        return df
    q = query.lower()
    x = Exact(df)
    conds = []
    for i in range(len(x.names)) if columns is None else map(x.index, columns):
        c = x.at(i)
        if isinstance(x.types[i], _NUMERIC):
            conds.append(F.lower(_number_text(c, x.types[i])).startswith(F.lit(q)))
        else:
            conds.append(F.lower(c.cast("string")).contains(F.lit(q)))
    hit = reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conds])
    return x.named(x.df.where(hit))


@dataclass(frozen=True)
class By:
    """One sort key: an expression, its direction and where NULL stands."""

    column: Column
    descending: bool = False
    nulls_first: bool = True

    @property
    def sort(self) -> Column:
        c = self.column
        if self.descending:
            return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()


def table_order(df: DataFrame, by: str, descending: bool = False,
                tiebreak: Sequence[str] = ()) -> list[By]:
    """Sort keys for a click on ``by``: text lower-cased, NULL smallest.

    Tie-break columns compare raw values ("Ana" before "ana"), so that with a
    unique tie-break the order is total and positions are reproducible.
    """
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    text = isinstance(types[by], T.StringType)
    out = [By(F.lower(_c(by)) if text else _c(by), descending, not descending)]
    if text and by not in tiebreak:
        out.append(By(_c(by)))   # case variants of one text
    return out + [By(_c(t)) for t in tiebreak]


def sort_rows(df: DataFrame, by: str, descending: bool = False,
              tiebreak: Sequence[str] = (), name: str = "pos") -> DataFrame:
    """``df`` ordered by ``by`` with a 1-based position column ``name``."""
    order = [b.sort for b in table_order(df, by, descending, tiebreak)]
    # positions() leaves rows range-partitioned in this order; sorting inside
    # each partition completes the global order without another exchange.
    return positions(df, order, name=name).sortWithinPartitions(name)


# -- pages --------------------------------------------------------------------

TOP = 100          # pages that end within so many rows come from one bounded heap per task
KEEP = 100_000     # rows that may be sorted to cut a page out of them
SAMPLE = 8_192     # values sampled to choose the ranges of one step
RANGES = 32        # ranges counted in one step


@dataclass(frozen=True)
class _Stretch:
    """Rows that are consecutive in the order: those under ``rows``, ``count`` of them after
    ``before`` others. The page takes ``size`` of them from ``skip`` on. ``level`` is the
    first sort key on which they may differ."""

    rows: DataFrame
    before: int
    count: int
    skip: int
    size: int
    level: int = 0


def _bounds(s: _Stretch, key: By) -> list:
    """Up to RANGES values that cut the stretch into ranges of similar size, from a bounded sample."""
    part = s.rows.sample(min(1.0, SAMPLE / s.count), 7) if s.count > SAMPLE else s.rows
    got = sorted(r[0] for r in part.select(key.column).collect() if r[0] is not None)
    step = max(1, len(got) // RANGES)
    return sorted(set(got[step // 2::step]))


def _narrow(s: _Stretch, order: Sequence[By]) -> list[_Stretch]:
    """Stretches of at most KEEP rows (or rows equal in every key) that hold the page."""
    if s.count <= KEEP or s.level == len(order):
        return [s]
    key = order[s.level]
    v, bounds = key.column, _bounds(s, key)
    if not bounds:      # only NULLs, or too few values to be sampled
        return _narrow(_replace(s, level=s.level + 1), order) if s.rows.where(v.isNotNull()).isEmpty() else [s]
    # Odd classes are the values of the bounds, even ones the ranges between them.
    above = reduce(lambda a, b: a + b, [(v > F.lit(b)).cast("int") for b in bounds])
    kind = F.when(v.isNull(), F.lit(-1)).otherwise(2 * above + v.isin(bounds).cast("int"))
    rows = s.rows.withColumn("_pz_kind", kind)
    counts = {r[0]: r[1] for r in rows.groupBy("_pz_kind").count().collect()}
    kinds = sorted((k for k in counts if k >= 0), reverse=key.descending)
    if -1 in counts:
        kinds.insert(0 if key.nulls_first else len(kinds), -1)
    at, runs = 0, []     # (class, rows before it in the stretch)
    for k in kinds:
        if at < s.skip + s.size and at + counts[k] > s.skip:
            runs.append((k, at))
        at += counts[k]
    out = []
    # Classes wholly inside the page hold fewer rows than it; the first and last are cut again.
    for k, at in runs:
        skip = max(0, s.skip - at)
        same = k % 2 == 1       # one value (or NULL): the next key decides
        inner = _Stretch(rows.where(F.col("_pz_kind") == k).drop("_pz_kind"), s.before + at, counts[k], skip,
                         min(counts[k], s.skip + s.size - at) - skip, s.level + int(same))
        shrunk = same or counts[k] < s.count
        out += _narrow(inner, order) if shrunk else [inner]
    return out


def _replace(s: _Stretch, **changes) -> _Stretch:
    return _Stretch(**{**s.__dict__, **changes})


def page_rows(df: DataFrame, order: Sequence[By | Column], page: int, page_size: int = 10,
              name: str = "pos") -> DataFrame:
    """Rows of 1-based ``page`` in ``order``, with their position ``name``.

    A page that ends within the first TOP rows is the end of a top-k: every task
    keeps that many rows and nothing is sorted or shuffled beyond them. For a
    deeper page the rows are counted per range of the first sort key, the ranges
    chosen from a bounded sample; only the ranges that hold the page are kept,
    and cut further (by the next key where all values are equal) until at most
    KEEP rows are left to sort. Each step is a count without a shuffle of rows, run
    when the page is asked for; ``df`` is read once more per step, so a costly
    one should be written first. Both ways cut one total order: ``order``, then a
    hash of the row.

    Keys given as plain sort columns cannot be compared with bounds; their deep
    pages are cut from a numbering of the whole table.
    """
    if page < 1 or page_size < 1:
        raise ValueError("page and page_size start at 1")
    skip = (page - 1) * page_size
    tie = F.xxhash64(*[_c(c) for c in df.columns])
    sorts = [*(b.sort if isinstance(b, By) else b for b in order), tie]

    def cut(rows: DataFrame, at: int, n: int, before: int) -> DataFrame:
        few = rows.orderBy(*sorts).offset(at).limit(n)
        return few.withColumn(name, F.row_number().over(Window.orderBy(*sorts)).cast("long") + F.lit(before + at))

    if skip + page_size <= TOP:
        return cut(df, skip, page_size, 0)
    if not all(isinstance(b, By) for b in order):
        numbered = positions(df, sorts[:-1], name=name)
        return numbered.where(F.col(name).between(skip + 1, skip + page_size)).sortWithinPartitions(name)
    total = df.count()
    if skip >= total:
        return df.withColumn(name, F.lit(0).cast("long")).where("false")
    found = _narrow(_Stretch(df, 0, total, skip, min(page_size, total - skip)), [*order, By(tie)])
    return reduce(lambda a, b: a.unionByName(b), [cut(s.rows, s.skip, s.size, s.before) for s in found]).orderBy(name)
