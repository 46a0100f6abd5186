"""Plain listings: expenses, fines receivable, member directory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pozo.operators.tables import By, page_rows


def _expense_order() -> list[By]:
    return [By(F.col("Fecha"), descending=True, nulls_first=False), By(F.col("Concepto")), By(F.col("Monto"))]


def _expense_rows(expenses: DataFrame) -> DataFrame:
    return expenses.select(F.col("fecha").alias("Fecha"), F.col("item").alias("Concepto"),
                           F.col("monto").alias("Monto"))


def expense_list(expenses: DataFrame) -> DataFrame:
    """``Fecha, Concepto, Monto``, newest first (ties: item, then amount)."""
    return _expense_rows(expenses).orderBy(*[b.sort for b in _expense_order()])


def expense_page(expenses: DataFrame, page: int, page_size: int = 10) -> DataFrame:
    """One page of the expense list (the table pages by 10 rows), with ``pos``."""
    return page_rows(_expense_rows(expenses), _expense_order(), page, page_size)


def fines_list(fines: DataFrame) -> DataFrame:
    """``Fecha, Deudor, Concepto, Monto`` as recorded (no reordering)."""
    return fines.select("Fecha", "Deudor", "Concepto", "Monto")


def member_directory(members: DataFrame) -> DataFrame:
    """Members that have a picture, for the member cards."""
    return (members.where(F.col("avatar_img").isNotNull())
            .select("nombre_pago", "nombre", "condicion", "fecha_inicio", "avatar_img"))
