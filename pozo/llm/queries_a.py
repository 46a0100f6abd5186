"""Registered queries of sharding, token counts and WARC, with DuckDB SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pozo.llm.frames import read_table, scratch_path
from pozo.llm.hash_tree import shard_rows
from pozo.llm.token_counts import token_counts
from pozo.llm.warc import read_archives, write_archives


def op2_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards by doc_id, and their shard among 41."""
    return shard_rows(read_table(spark, sf_dir, "documents"), 40)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document under byte_bpe_50k."""
    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records with revisits, and read back."""
    path = write_archives(read_table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type",
                                             "refers_to", "digest_ok")


def _base32(hexa: str) -> str:
    digits = [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr({hexa}, {5 * i + 1}, 5))::BIGINT >> {s}) & 31)::INT, 1)"
              for i in range(8) for s in (15, 10, 5, 0)]
    return " || ".join(digits)


ORACLE_SQL = {
    "op9_warc_revisits": f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS hexa FROM p),
d AS (SELECT page_id, payload_bytes, {_base32('hexa')} AS payload_digest FROM h),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN top IS NULL OR page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to, true AS digest_ok
FROM m""",
}

QUERIES = {"op2_hash_tree": op2_hash_tree, "op3_token_counts": op3_token_counts,
           "op9_warc_revisits": op9_warc_revisits}
