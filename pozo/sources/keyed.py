"""A ledger given as payments carrying a payer key, plus the payer table.

This is the shape a warehouse usually holds (a fact table and a dimension).
Reports that only aggregate do not need the join row by row: they aggregate
the payments per payer key first (partial aggregation, so even a payer with a
third of all payments is a handful of rows per task), attach member names to
those key-grain rows, and merge per member. The payments are never shuffled
by key, and the join runs on one row per key instead of one per payment.
Reports that list payments use :meth:`KeyedLedger.flat`, the row-level join.

Results equal those on the flat join in every case: payments whose key has
no payer (or a NULL key) are left out, and a key listed twice among payers
counts for each listing.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pozo.functions.text import title_case
from pozo.session import cut_lineage
from pozo.sources.strict import Formats, conform


MAX_EXCEPTIONS = 100_000    # payer keys, some 3 MB, that may be broadcast


@dataclass(frozen=True)
class KeyedLedger:
    payments: DataFrame   # key column + fecha, aporte, concepto
    payers: DataFrame     # key column + miembro
    key: str = "id_pagador"
    # Expect payers to be one-to-one: each key listed once, each name used by
    # one key. Per-member numbering can then run per key, before the names
    # are attached (see plans.summary.member_detail). Checked by one_to_one().
    unique_names: bool = False
    # Title-case payer names when attaching them, as prepare_ledger does for a
    # flat ledger, so they match the member directory's key. Applied at key
    # grain; switch off when the payer table is already normalised.
    title_case_names: bool = True

    @classmethod
    def prepare(cls, payments: DataFrame, payers: DataFrame, key: str = "id_pagador",
                formats: Formats = Formats(), **options) -> "KeyedLedger":
        """Clean column names and declared types as ``prepare_ledger`` does.

        ``payments`` gets ``fecha`` as DATE, ``aporte`` as DECIMAL(18,2) and
        ``concepto`` as STRING next to its key; ``payers`` keeps key and name.
        """
        from pozo.sources.readers import clean_names, require
        from pozo.sources.schemas import APORTES

        pay = clean_names(payments)
        require(pay.columns, APORTES, skip=("miembro",))
        fields = [T.StructField(key, pay.schema[key].dataType), *[f for f in APORTES.fields if f.name != "miembro"]]
        named = clean_names(payers).select(F.col(f"`{key}`"), F.col("miembro").cast("string"))
        return cls(conform(pay, T.StructType(fields), formats), named, key, **options)

    def _names(self) -> DataFrame:
        name = title_case("miembro") if self.title_case_names else F.col("miembro")
        return self.payers.select(F.col(self.key).alias("_pz_key"), name.alias("miembro"))

    def flat(self) -> DataFrame:
        """The ledger rows: payments joined to their payer (inner join on the key)."""
        names = self._names()
        return (self.payments.join(names, self.payments[self.key] == names["_pz_key"], "inner")
                .select("fecha", "miembro", "aporte", "concepto"))

    def one_to_one(self) -> bool:
        """Whether numbering per key numbers every member: ``unique_names``, and it holds.

        One aggregate over the payer table; title-casing may merge names, so
        the names as reported are counted.
        """
        if not self.unique_names:
            return False
        # A NULL name is a member like any other: counted as a value of its own.
        n, keys, names = self._names().agg(
            F.count(F.lit(1)), F.count_distinct("_pz_key"),
            F.count_distinct("miembro") + F.max(F.col("miembro").isNull().cast("int"))).first()
        return n == 0 or n == keys == names

    def counted(self) -> DataFrame:
        """The payments with ``_pz_w``, the number of payers their key has: how often each
        counts in the row-level join. For reports that need no names.

        Nearly every key has one payer. The others (no payer, listed twice, NULL) are
        found at key grain, so no payment is shuffled by key; up to MAX_EXCEPTIONS of
        them are broadcast. With more, the numbers are joined by key.
        """
        keys = self.payments.select(F.col(self.key).alias("_pz_odd")).distinct()
        per = self.payers.groupBy(F.col(self.key).alias("_pz_key")).agg(F.count(F.lit(1)).alias("_pz_n"))
        odd = cut_lineage(keys.join(per, keys["_pz_odd"] == per["_pz_key"], "left")
                          .select("_pz_odd", F.coalesce("_pz_n", F.lit(0)).alias("_pz_n")).where("_pz_n <> 1"))
        found = odd.count()
        if not found:
            return self.payments.withColumn("_pz_w", F.lit(1).cast("long"))
        few = F.broadcast(odd) if found <= MAX_EXCEPTIONS else odd
        return (self.payments.join(few, self.payments[self.key].eqNullSafe(few["_pz_odd"]), "left")
                .withColumn("_pz_w", F.coalesce("_pz_n", F.lit(1))).drop("_pz_odd", "_pz_n"))

    def where(self, cond: Column) -> "KeyedLedger":
        """Filter the payments (conditions on their own columns)."""
        return replace(self, payments=self.payments.where(cond))

    def name(self, per_key: DataFrame, few: DataFrame | None = None) -> DataFrame:
        """Attach ``miembro`` to per-key rows (inner join at key grain).

        ``few`` (one column) lists the only keys in ``per_key`` when their number has a
        bound and payers are one-to-one: then their names, as many at most, are
        broadcast, and rows that were split over tasks are not brought together by key.
        """
        names = self._names()
        if few is not None:
            only = F.broadcast(few)
            names = F.broadcast(names.join(only, names["_pz_key"] == only[few.columns[0]], "left_semi"))
        return (per_key.join(names, per_key[self.key] == names["_pz_key"], "inner")
                .drop("_pz_key"))


Ledger = DataFrame | KeyedLedger


def flat(ledger: Ledger) -> DataFrame:
    """The row-level ledger of either input form."""
    return ledger.flat() if isinstance(ledger, KeyedLedger) else ledger


def counted(ledger: Ledger) -> DataFrame:
    """The payments of either form with ``_pz_w``, how often each counts."""
    return ledger.counted() if isinstance(ledger, KeyedLedger) else ledger.withColumn("_pz_w", F.lit(1).cast("long"))
