"""Declared schemas of the four input tables (never inferred)."""

from pyspark.sql import types as T

AMOUNT = T.DecimalType(18, 2)
# Type of a sum of amounts (Spark widens decimal(18,2) sums to 28 digits).
TOTAL = T.DecimalType(28, 2)

# Payments ledger: one row per payment.
APORTES = T.StructType([
    T.StructField("fecha", T.DateType()),
    T.StructField("miembro", T.StringType()),
    T.StructField("aporte", AMOUNT),
    T.StructField("concepto", T.StringType()),
])

# Expenses.
GASTOS = T.StructType([
    T.StructField("fecha", T.DateType()),
    T.StructField("item", T.StringType()),
    T.StructField("monto", AMOUNT),
])

# Receivables (fines); column names keep their capitals.
MULTAS = T.StructType([
    T.StructField("Fecha", T.DateType()),
    T.StructField("Deudor", T.StringType()),
    T.StructField("Concepto", T.StringType()),
    T.StructField("Monto", AMOUNT),
])

# Member directory.
MIEMBROS = T.StructType([
    T.StructField("nombre_pago", T.StringType()),
    T.StructField("condicion", T.StringType()),
    T.StructField("fecha_inicio", T.DateType()),
    T.StructField("nombre", T.StringType()),
    T.StructField("avatar_img", T.StringType()),
])
