"""Small Spark helpers shared by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pozo.session import cut_lineage as checkpointed
from pozo.session import ensure_checkpoint_dir

__all__ = ["cut_lineage", "row_key", "scratch_path", "read_table", "connected", "shuffle_tasks", "join_counted"]


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_given_back(spark: SparkSession) -> Iterator[None]:
    """Executions inside give their shuffle files back as soon as they are complete. The
    session's setting is put back after; it holds for all executions of the session meanwhile."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder; nothing reads its shuffle files again."""
    with _shuffles_given_back(df.sparkSession):
        return checkpointed(df.select("*"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def shuffle_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(*columns: str) -> list[Column]:
    """A 128-bit key of a row's values (``_k1``, ``_k2``). Unlike an id it is never
    null and differs between rows that share an id; fully equal rows share it."""
    cols = [F.col(c) for c in columns]
    nulls = [F.col(c).isNull() for c in columns]
    return [F.xxhash64(*cols, *nulls).alias("_k1"),
            F.xxhash64(F.lit(0x5bd1e995), *nulls, *reversed(cols)).alias("_k2")]


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], how: str = "inner", count: str = "c") -> DataFrame:
    """``rows`` joined with ``counted``: one row per key, ``count`` the number of ``rows`` of it.

    No task gets the rows of one key because the key is frequent. Keys with more
    than 1 / (4 x shuffle tasks) of all counted rows are fewer than four times the
    shuffle tasks, whatever the input: they are broadcast, and their rows are dealt
    by their own hash from there on. All other keys meet in a shuffle join.
    ``how`` is ``inner`` or ``left``; null keys match nothing.
    """
    counted = cut_lineage(counted)
    tasks = shuffle_tasks(rows.sparkSession)
    total = counted.agg(F.sum(count)).first()[0] or 0
    values = [c for c in counted.columns if c not in keys]
    is_heavy = F.col(count) > total / (4 * tasks)
    heavy = counted.where(is_heavy).select(*keys, *[F.col(c).alias(f"_heavy_{c}") for c in values])
    light = counted.where(~is_heavy).select(*keys, F.lit(0).alias("_salt"), *[F.col(c).alias(f"_light_{c}") for c in values])
    stays = F.col(f"_heavy_{count}").isNull() & F.col(keys[0]).isNotNull()
    spread = F.when(stays, 0).otherwise(1 + F.pmod(F.xxhash64(*rows.columns), F.lit(64 * tasks)).cast("int"))
    out = (rows.join(F.broadcast(heavy), keys, "left").withColumn("_salt", spread)
           .join(light, [*keys, "_salt"], "left")
           .select(*rows.columns, *[F.coalesce(f"_heavy_{c}", f"_light_{c}").alias(c) for c in values]))
    return out.where(F.col(count).isNotNull()) if how == "inner" else out


class Kept:
    """Tables written to the shared folder for the steps of a loop.

    Read back, a table has its true size, which the planner goes by. (A checkpoint
    carries the estimate of its plan; over the joins of a loop that is squared
    again and again.) ``drop`` deletes what is not needed any more.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.what, self.paths = spark, what, []

    def write(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, self.what)
        with _shuffles_given_back(self.spark):
            df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, keep_last: int = 0) -> None:
        gone, self.paths = self.paths[:len(self.paths) - keep_last], self.paths[len(self.paths) - keep_last:]
        for p in gone:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def with_minimum(edges: DataFrame, kept: Kept) -> DataFrame:
    """Edges (u, v) with ``m``, the smaller of u and u's smallest v.

    The minima are partial aggregates, written to the shared folder: read from
    there, both sides of the join come from a shuffle of their own, and Spark can
    split the edges of a node that has very many. (Against an aggregate on the same
    key, planned without a shuffle of its own, it could not.)
    """
    low = kept.write(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return edges.join(low, "u")


def connected(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge list: (node, root), root the smallest node.

    Alternates two star rewrites of the edge list: every node hands its
    neighbours to its smallest neighbour (first the larger ones, then the
    smaller ones), until no edge changes. Rounds grow with the logarithm of the
    longest chain. Each round's tables are written to the shared folder and
    deleted after the next. Nodes without edges are not listed.
    """
    kept = Kept(edges.sparkSession, "components")
    e = kept.write(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct())
    stamp = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = kept.write(with_minimum(both, kept).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                           .where("u != v").distinct())
        # Every v is smaller than its u here, so the minimum is the smallest v.
        e = kept.write(with_minimum(large, kept)
                       .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                                                 F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s"))
                       .select("s.u", "s.v").where("u != v").distinct())
        kept.drop(keep_last=1)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == stamp:
            out = cut_lineage(e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
            kept.drop()
            return out
        stamp = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
