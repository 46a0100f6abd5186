"""Registered queries of the exact shingle join, near-duplicate vectors and license scans
(no SQL: components, fitted trees, the method's own labels)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pozo.llm.frames import read_table
from pozo.llm.jaccard import classes
from pozo.llm.license_scan import scan
from pozo.llm.rp_forest import near_duplicates


def op1_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors of equal label at cosine 0.93 or more."""
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op7_diagonal_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and passages in all documents."""
    return scan(read_table(spark, sf_dir, "documents")).drop("found")


def op4_jaccard_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents whose 4-word shingles have Jaccard similarity 0.85 or more."""
    return classes(read_table(spark, sf_dir, "documents"), k=4, percent=85).drop("_k1", "_k2")


QUERIES = {"op1_projection_forest": op1_projection_forest, "op4_jaccard_regions": op4_jaccard_regions,
           "op7_diagonal_votes": op7_diagonal_votes}
ORACLE_SQL: dict[str, str] = {}
