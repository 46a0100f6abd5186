"""Columns told apart by their exact names.

A category becomes a column, and people type "Aporte" beside "aporte", or names
with dots and backticks. Spark may read column names without regard to case, so
wide tables carry numbered columns inside and get their names at the edge,
where nothing refers to them any more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Exact:
    """A frame with numbered columns, looked up by the exact names it had."""

    def __init__(self, df: DataFrame):
        self.names = list(df.columns)
        self.types = [f.dataType for f in df.schema.fields]
        self.df = df.toDF(*[f"_n{i}" for i in range(len(self.names))])

    def at(self, i: int) -> Column:
        return F.col(f"_n{i}")

    def index(self, name: str) -> int:
        """Place of the column of that very name, else of the only one that differs in case."""
        if name in self.names:
            return self.names.index(name)
        close = [i for i, n in enumerate(self.names) if n.lower() == name.lower()]
        if len(close) != 1:
            raise ValueError(f"no column {name!r} among {', '.join(self.names)}")
        return close[0]

    def __getitem__(self, name: str) -> Column:
        return self.at(self.index(name))

    def named(self, df: DataFrame, *more: str) -> DataFrame:
        """``df`` (the numbered columns, then ``more``) under the old names."""
        return df.toDF(*self.names, *more)


def unique_names(names: Sequence[str], hint: str = "") -> list[str]:
    """``names``, or an error naming those that occur twice, letter for letter."""
    twice = sorted({n for n in names if list(names).count(n) > 1})
    if twice:
        raise ValueError(f"two columns would be named {', '.join(map(repr, twice))}{hint}")
    return list(names)


def apart_without_case(names: Sequence[str]) -> list[str]:
    """``names`` with ``_2``, ``_3`` after those that differ from an earlier one in case only."""
    out: list[str] = []
    taken = {n.lower() for n in names}
    seen: set[str] = set()
    for n in names:
        name, k = n, 1
        while name.lower() in seen or (k > 1 and name.lower() in taken):
            k += 1
            name = f"{n}_{k}"
        seen.add(name.lower())
        out.append(name)
    return out
