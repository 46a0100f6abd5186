"""The ledger as a stored table, partitioned by year and month.

Reports that recompute the ledger from its sources (a join, in the test
adapter) pay that cost every time and scan all of it. Written once with
:func:`write_ledger`, the ledger is laid out by ``anio``/``mes`` folders with
date-sorted files: the month reports then read one or two month folders (the
bound is a scalar subquery, applied to the partition list at run time), the
dues report one year, and every file carries min/max dates for row-group
skipping.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pozo.sources.keyed import KeyedLedger, Ledger

PARTITION_COLUMNS = ("anio", "mes")
_MARK, _PATH = "pozo.stored_ledger", "pozo.stored_path"


def write_ledger(ledger: DataFrame, path: str, num_files: int | None = None,
                 mode: str = "overwrite") -> None:
    """Write a prepared ledger (or keyed payments) partitioned by year and month.

    Columns are kept, but for an own ``anio`` or ``mes``: those names hold the
    folder, which ``fecha`` decides. Rows are
    range-partitioned on the date, then a hash of the whole row (sampled
    bounds, so a busy month, day or payer is split over several tasks rather
    than landing in one), and sorted within each task, so each task writes a
    few date-contiguous files.
    """
    spark = ledger.sparkSession
    n = num_files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [c for c in ledger.columns if c not in PARTITION_COLUMNS]
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in cols])
    out = (ledger.select(*[F.col(f"`{c}`") for c in cols])
           .withColumn("anio", F.year("fecha"))
           .withColumn("mes", F.month("fecha"))
           .repartitionByRange(n, F.col("fecha").asc_nulls_first(), row_hash)
           .sortWithinPartitions("anio", "mes", "fecha"))
    out.write.mode(mode).partitionBy(*PARTITION_COLUMNS).parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Read a stored ledger; the partition columns stay for pruning and carry a mark."""
    df = spark.read.parquet(path)
    return df.withColumns({c: F.col(c).alias(c, metadata={_MARK: True, _PATH: path}) for c in PARTITION_COLUMNS})


def is_stored(df: DataFrame) -> bool:
    """Whether ``df`` comes from :func:`read_ledger` (by its mark, not by column names)."""
    marked = {f.name for f in df.schema.fields if f.metadata.get(_MARK)}
    return marked.issuperset(PARTITION_COLUMNS)


def capped(ledger: Ledger, as_of: _dt.date | None) -> Ledger:
    """Rows dated up to ``as_of`` (None: all); on a stored ledger later folders are not read."""
    if as_of is None:
        return ledger
    cond = F.col("fecha") <= F.lit(as_of)
    if is_stored(ledger.payments if isinstance(ledger, KeyedLedger) else ledger):
        cond = cond & (month_of_partition() <= F.lit(as_of))
    return ledger.where(cond)


def month_of_partition() -> F.Column:
    """First day of the month a partition holds (partition columns only)."""
    return F.make_date(F.col("anio"), F.col("mes"), F.lit(1))


def stored_months(df: DataFrame) -> list[_dt.date]:
    """First days of the months a stored ledger has folders for, latest first; no file is opened.

    At most twelve folder names per year of the ledger come to the driver. The
    folder of rows without a date is none of them.
    """
    spark = df.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    root = fs_path(df.schema[PARTITION_COLUMNS[0]].metadata[_PATH])
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def numbers(folder, column: str) -> list[tuple[int, object]]:
        names = [(s.getPath().getName(), s.getPath()) for s in fs.listStatus(folder) if s.isDirectory()]
        return [(int(n.split("=", 1)[1]), p) for n, p in names if n.startswith(f"{column}=") and n.split("=", 1)[1].isdigit()]

    year, month = PARTITION_COLUMNS
    return sorted((_dt.date(y, m, 1) for y, p in numbers(root, year) for m, _ in numbers(p, month)), reverse=True)


def latest_month(ledger: Ledger, as_of: _dt.date | None = None) -> _dt.date | None:
    """First day of the latest month with a payment in a stored ledger (up to ``as_of``).

    The folder list gives the month; its folder is looked into, and the one before
    only if nothing there counts (no row up to ``as_of``, or none with a payer).
    """
    keyed = isinstance(ledger, KeyedLedger)
    rows = ledger.payments if keyed else ledger
    for month in stored_months(rows):
        if as_of is not None and month > as_of:
            continue
        cond = (F.col("anio") == month.year) & (F.col("mes") == month.month) & F.col("fecha").isNotNull()
        if as_of is not None:
            cond = cond & (F.col("fecha") <= F.lit(as_of))
        found = rows.where(cond)
        if keyed:
            found = ledger.name(found.select(ledger.key).distinct())
        if not found.isEmpty():
            return month
    return None
