"""Sinks: report tables are written by the executors, never collected."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pozo.operators.names import apart_without_case


def write_report(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                 partition_by: list[str] | None = None, **options) -> None:
    """Write one report table (``parquet``, ``json`` lines or ``csv``).

    The original embedded each table as JSON in a web page; here each report
    is a dataset on shared storage that any reader can page through. Files are
    mostly read without regard to case: columns that differ in case only get
    ``_2``, ``_3`` here.
    """
    df = df.toDF(*apart_without_case(df.columns))
    w = df.write.format(fmt).mode(mode).options(**options)
    if fmt == "csv":
        w = w.option("header", "true")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
