"""The driver's TPC-H-style tables seen as the four treasury inputs.

* ``aportes``  — orders joined to their customer: the customer name pays the
  order total on the order date; the order priority gives the category
  (urgent "Técnica", high "Multa técnica", low "Donación", the rest "Aporte"). Also offered keyed (:func:`aportes_keyed`): orders by
  customer key plus the customer names, for reports that only aggregate.
* ``miembros`` — customers: FURNITURE is inactive, MACHINERY has no recorded
  condition, everyone else is active; start month from the key; customers
  with a non-negative balance have a picture.
* ``gastos``   — line items: ship date, flag+status as item, extended price.
* ``multas``   — every event: date, user, event type, value.

The join is left to the planner: the customer side is broadcast only when
adaptive execution measures it under the broadcast threshold, otherwise both
sides shuffle on the customer key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pozo.functions.text import title_case
from pozo.sources.keyed import KeyedLedger
from pozo.sources.readers import prepare_expenses, prepare_fines, prepare_ledger, prepare_members
from pozo.sources.schemas import AMOUNT

# How the driver's columns map onto ledger categories/conditions.
CATEGORY_OF_PRIORITY = {"1-URGENT": "Técnica", "2-HIGH": "Multa técnica", "5-LOW": "Donación"}
INACTIVE_SEGMENT = "FURNITURE"
UNKNOWN_SEGMENT = "MACHINERY"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def aportes_keyed(spark: SparkSession, sf_dir: str) -> KeyedLedger:
    """Payments as orders keyed by customer, payers as customers with their name.

    Names are normalised on the customer side, once per customer rather than
    once per order.
    """
    o = _read(spark, sf_dir, "orders")
    payments = o.select(
        F.col("o_custkey").alias("id_pagador"),
        F.to_date("o_orderdate").alias("fecha"),
        F.col("o_totalprice").cast(AMOUNT).alias("aporte"),
        F.coalesce(*[F.when(F.col("o_orderpriority") == F.lit(p), F.lit(c)) for p, c in CATEGORY_OF_PRIORITY.items()],
                   F.lit("Aporte")).alias("concepto"))
    c = _read(spark, sf_dir, "customer")
    payers = c.select(F.col("c_custkey").alias("id_pagador"), title_case("c_name").alias("miembro"))
    # Customer keys and names are both unique in the driver's customer table.
    return KeyedLedger(payments, payers, "id_pagador", unique_names=True, title_case_names=False)


def aportes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat ledger: every order with its customer's name."""
    return prepare_ledger(aportes_keyed(spark, sf_dir).flat(), title_case_members=False)


def miembros(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    seg = F.col("c_mktsegment")
    raw = c.select(
        F.col("c_name").alias("nombre_pago"),
        F.when(seg == F.lit(INACTIVE_SEGMENT), F.lit("Inactivo"))
         .when(seg != F.lit(UNKNOWN_SEGMENT), F.lit("Activo")).alias("condicion"),
        F.make_date(F.lit(2000), (F.col("c_custkey") % 12 + 1).cast("int"), F.lit(1)).alias("fecha_inicio"),
        F.col("c_name").alias("nombre"),
        F.when(F.col("c_acctbal") >= 0,
               F.concat(F.lit("avatars/"), F.col("c_custkey").cast("string"), F.lit(".png")))
         .alias("avatar_img"))
    return prepare_members(raw)


def gastos(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    raw = li.select(F.to_date("l_shipdate").alias("fecha"),
                    F.concat(F.col("l_returnflag"), F.col("l_linestatus")).alias("item"),
                    F.col("l_extendedprice").cast(AMOUNT).alias("monto"))
    return prepare_expenses(raw)


def multas(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _read(spark, sf_dir, "events")
    raw = (ev.select(F.to_date("ts").alias("Fecha"),
                   F.col("user_id").cast("string").alias("Deudor"),
                   F.col("event_type").alias("Concepto"),
                   F.col("value").cast(AMOUNT).alias("Monto")))
    return prepare_fines(raw)
