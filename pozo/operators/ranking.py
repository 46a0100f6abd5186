"""Row positions within groups, without sending a whole group to one task.

``row_number()`` over ``Window.partitionBy(key)`` needs every row of a key in
one task; a member holding a third of the ledger would then be sorted by a
single core. Here the rows are range-partitioned on (key, order, tie-break),
so a hot key spans many partitions, and positions are stitched together from
per-partition counts:

1. range exchange on the full sort order (keys, order, row-hash tie-break);
2. per (partition, key) segment, a row count — a partial aggregate read from
   the same exchange, no sort needed. Running sums over this small table give
   each segment's first row index inside its partition (rows of smaller keys
   there) and its start within the key (rows of the key in earlier partitions);
3. sort within partitions; a row's index in its partition comes from the
   increasing id (restarting at ``partition << 33``);
4. position = start + (index - first index) + 1, joining rows to their segment
   on (partition, key), which is balanced because a hot key is split by partition.

Without keys the same steps number the whole table; then there is one segment
per partition, so the offsets table has as many rows as partitions and is
broadcast (its size is bounded by the partition count, not the data).

With keys, only hot keys need this: keys under one partition's worth of rows
are numbered with a plain window, one shuffle, see :func:`positions`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pozo.session import cut_lineage

_P, _RID, _FIRST, _N, _START = "_pz_p", "_pz_rid", "_pz_first", "_pz_n", "_pz_start"


def positions(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (),
              name: str = "pos", num_partitions: int | None = None,
              split_hot: bool = True) -> DataFrame:
    """Add ``name`` = 1-based row number within ``keys`` in ``order``.

    See :func:`position_parts`; this is the union of its parts.
    """
    parts = position_parts(df, order, keys, name, num_partitions, split_hot)
    return reduce(lambda a, b: a.unionByName(b), parts)


@dataclass(frozen=True)
class Part:
    """Numbered rows of some keys. ``hot`` lists the keys of the range-split part (at most as
    many as partitions, so tables cut down to them may be broadcast); None elsewhere."""

    rows: DataFrame
    hot: DataFrame | None = None


def position_parts(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (),
                   name: str = "pos", num_partitions: int | None = None,
                   split_hot: bool = True) -> list[DataFrame]:
    """The rows of :func:`numbered_parts`."""
    return [p.rows for p in numbered_parts(df, order, keys, name, num_partitions, split_hot)]


def hot_keys(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame | None:
    """Keys that hold more than ``rows / n`` rows, None if there are none.

    At most ``n`` keys can, so they are a small table of their own (columns
    ``_pz_h0``, ...), found once by a count per key (partial aggregates).
    """
    hk = [f"_pz_h{i}" for i in range(len(keys))]
    counts = df.groupBy(*[F.col(f"`{k}`").alias(a) for k, a in zip(keys, hk)]).agg(F.count(F.lit(1)).alias(_N))
    total = counts.select(F.sum(_N)).scalar()
    found = counts.where(F.col(_N) * F.lit(n) > total).select(*hk)
    rows = found.collect()
    return df.sparkSession.createDataFrame(rows, found.schema) if rows else None


def numbered_parts(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (),
                   name: str = "pos", num_partitions: int | None = None,
                   split_hot: bool = True) -> list[Part]:
    """Add ``name`` = 1-based row number within ``keys`` in ``order``.

    ``order`` should be a total order for deterministic numbering; rows that
    tie on every order column get distinct, arbitrary positions.

    Returns the numbered rows as parts (cold keys, then hot keys if there are
    any), so that per-key work can run on each part before they are combined.

    With keys and ``split_hot``, only hot keys take the range-split path: a
    key is hot when it holds more than ``rows / num_partitions`` rows, which
    at most ``num_partitions`` keys can do. They are looked up when the parts
    are asked for (one count per key); the list has a proven bound and is
    broadcast. Every other key is numbered by ``row_number`` over its own
    window, one hash shuffle, with no group larger than an average partition.
    """
    keys = list(keys)
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not keys or not split_hot:
        return [Part(_range_positions(df, order, keys, name, n))]

    hot = hot_keys(df, keys, n)
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    w = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*order, tie)

    def cold(rows: DataFrame) -> Part:
        return Part(rows.withColumn(name, F.row_number().over(w).cast("long")))

    if hot is None:
        return [cold(df)]
    few = F.broadcast(hot)
    match = [F.col(f"`{k}`").eqNullSafe(F.col(h)) for k, h in zip(keys, hot.columns)]
    # Hot rows hold at most n keys; range-split into n partitions sorted by key,
    # each boundary splits at most one key, so they form at most 2n segments:
    # that segment table is broadcast, and the hot rows are not shuffled again.
    split = _range_positions(df.join(few, match, "left_semi"), order, keys, name, n, few_segments=True)
    # Each key lies wholly in one part; the cold part stays hash-partitioned
    # by the keys, so per-key work after it needs no further shuffle.
    return [cold(df.join(few, match, "left_anti")), Part(split, hot)]


def _range_positions(df: DataFrame, order: Sequence[Column], keys: list[str], name: str,
                     n: int, few_segments: bool = False) -> DataFrame:
    spark = df.sparkSession
    # Final tie-break: a hash of the whole row, so rows that tie on every
    # order column still spread over range partitions unless fully identical
    # (and identical rows are interchangeable). It is written inside the
    # partitioning expression, so the exchange reads every column: the
    # segment counts and the rows below then see one identical exchange,
    # which Spark plans once and reuses. Two exchanges would each sample
    # their own range bounds and could disagree.
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    key_order = [F.col(f"`{k}`").asc_nulls_first() for k in keys]
    sort_cols = key_order + list(order) + [tie]
    ranged = df.repartitionByRange(n, *sort_cols)
    if spark.conf.get("spark.sql.exchange.reuse", "true").lower() != "true":
        # Without exchange reuse, materialise the partitioned rows once.
        ranged = cut_lineage(ranged)
    ranged = ranged.withColumn(_P, F.spark_partition_id())

    # Segment table, from the same (reused) exchange without sorting it:
    # rows per (partition, key). A segment starts, inside its partition,
    # after the rows of smaller keys there, and its key continues the count
    # of the same key in earlier partitions. Fresh names avoid an ambiguous
    # self-join.
    sk = [f"_pz_k{i}" for i in range(len(keys))]
    counts = (ranged.groupBy(F.col(_P).alias("_pz_sp"), *[F.col(f"`{k}`").alias(a) for k, a in zip(keys, sk)])
              .agg(F.count(F.lit(1)).alias(_N)))
    before = (Window.unboundedPreceding, -1)
    if keys:
        in_part = (Window.partitionBy("_pz_sp").orderBy(*[F.col(a).asc_nulls_first() for a in sk])
                   .rowsBetween(*before))
        same_key = Window.partitionBy(*sk).orderBy("_pz_sp").rowsBetween(*before)
        seg = (counts.withColumn(_FIRST, F.coalesce(F.sum(_N).over(in_part), F.lit(0)))
               .withColumn(_START, F.coalesce(F.sum(_N).over(same_key), F.lit(0))))
        if few_segments:
            seg = F.broadcast(seg)
    else:
        # One segment per partition: as many rows as partitions, so broadcast.
        seg = F.broadcast(counts.withColumn(_FIRST, F.lit(0)).withColumn(
            _START, F.coalesce(F.sum(_N).over(Window.orderBy("_pz_sp").rowsBetween(*before)), F.lit(0))))
    seg = seg.drop(_N)

    # Rows in sorted order; the increasing id restarts at partition << 33.
    t = (ranged.sortWithinPartitions(*sort_cols)
         .withColumn(_RID, F.monotonically_increasing_id()
                     - F.shiftleft(F.col(_P).cast("long"), 33)))
    cond = [F.col(_P) == F.col("_pz_sp")] + [F.col(f"`{k}`").eqNullSafe(F.col(a)) for k, a in zip(keys, sk)]
    joined = t.join(seg, cond, "inner")
    out = joined.withColumn(name, F.col(_START) + F.col(_RID) - F.col(_FIRST) + F.lit(1))
    return out.drop(_P, _RID, _FIRST, _START, "_pz_sp", *sk)
