"""A training-corpus pipeline: five operators of ``pozo.llm`` in a row.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. The result of
a stage is written as Parquet and read again as the next one's ``docs``; all
but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from pozo.llm.frames import read_table, scratch_path  # noqa: E402
from pozo.llm.hash_tree import shard_rows  # noqa: E402
from pozo.llm.jaccard import one_per_class  # noqa: E402
from pozo.llm.language_id import identify, learn  # noqa: E402
from pozo.llm.mixing import mix_networks, taken_rows  # noqa: E402
from pozo.llm.winnowing import clean_rows  # noqa: E402


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those rejected go.

    Rejected are null texts, texts without a letter, and texts farther from the
    nearest centroid than nearly all labelled text of that language and length.
    Without any labelled document only the first two are. Repeated rows and ids
    share one fate; columns named like a result column are carried through; an
    empty table stays empty.
    """
    model = learn(docs)
    if model is None:
        return docs.where(F.col("text").rlike("\\p{L}"))
    # The row travels as one value: its columns meet no column of the result.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = identify(docs, model, [row])
    return found.where(~F.col("rejected")).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class linked by five-word shingles at similarity 0.8: the smallest id.

    Of equal ids in a class one row stays, a null id only where no other is in the
    class. Rows without words (null, empty or blank texts) are linked with nothing
    and all stay. Columns named like a result column are carried through.
    """
    return one_per_class(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of 10 words of a benchmark item.

    Null and empty texts hold none and stay; repeated rows share one fate; an empty
    benchmark, or one of null texts, removes nothing.
    """
    return clean_rows(docs, read_table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken (at most twice).

    A null source is a source of its own, the last by name. Texts without words
    add nothing and go. Rows of equal id and text are one document of all their
    sources, which share its words by the flow; they are taken equally often.
    """
    return taken_rows(docs, mix_networks(docs, F.col("source")))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard of 40, its slot there, and its shard among 41.

    A null id is a key like any other; repeated ids share a shard and get slots of
    their own; a null text has size 16.
    """
    return shard_rows(docs, 40)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("mixture", mixture), ("sharding", sharding)]

# Fitted centroids, components and a seeded choice have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents below ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
