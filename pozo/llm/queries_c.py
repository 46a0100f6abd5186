"""Registered queries of substring removal and benchmark decontamination, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pozo.llm.frames import read_table
from pozo.llm.super_kmers import drop_repeats
from pozo.llm.winnowing import decontaminate


def op6_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents left when repeated windows of 35 words are removed."""
    return drop_repeats(read_table(spark, sf_dir, "documents")).drop("kept_text")


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that stand in a window of 10 benchmark words."""
    return decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("spans", "items")


_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"

ORACLE_SQL = {
    "op6_super_kmers": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS k
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM win) WHERE c > 1),
gone AS (SELECT doc_id, list(DISTINCT j) AS js
         FROM (SELECT doc_id, unnest(range(i, i + 35)) AS j FROM again) GROUP BY doc_id),
flat AS (SELECT w.doc_id, unnest(range(1, len(words) + 1)) AS j, unnest(words) AS word FROM w),
hit AS (SELECT doc_id, unnest(js) AS j FROM gone),
kept AS (SELECT f.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY f.j) AS t
         FROM flat f ANTI JOIN hit h ON f.doc_id = h.doc_id AND f.j = h.j GROUP BY f.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id""",
    "op8_winnowing": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, {_ALNUM}) AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, {_ALNUM}) AS words FROM benchmark),
item AS (SELECT DISTINCT item_id, least(len(words), 10) AS n, array_to_string(words[i:i + least(len(words), 10) - 1], ' ') AS k
         FROM (SELECT *, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM b WHERE len(words) > 0)),
lens AS (SELECT DISTINCT n FROM item),
win AS (SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS k
        FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, lens WHERE len(words) >= n)),
occ AS (SELECT doc_id, win.n, i, item_id FROM win JOIN item ON win.k = item.k AND win.n = item.n),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM occ WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN its ON d.doc_id = its.doc_id""",
}

QUERIES = {"op6_super_kmers": op6_super_kmers, "op8_winnowing": op8_winnowing}
