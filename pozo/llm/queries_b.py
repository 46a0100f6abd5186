"""Registered queries of mixing and language identification (no SQL: seeded choice, fitted centroids)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pozo.llm.frames import read_table
from pozo.llm.language_id import held_out, identify, learn
from pozo.llm.mixing import source_report


def op5_min_cost_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the sources' targets."""
    return source_report(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op10_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that aren't held out."""
    docs = read_table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out()))
    return identify(docs, model, [F.col("doc_id"), held_out().alias("held_out")])


QUERIES = {"op5_min_cost_mix": op5_min_cost_mix, "op10_centroid_language": op10_centroid_language}
ORACLE_SQL: dict[str, str] = {}
