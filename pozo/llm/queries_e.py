"""Registered queries of the Merkle manifest, spelling variants and chat formatting, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pozo.llm.chat import CONTROLS, END, BEGIN, NEXT, ROLE_END, digest, format_conversations, read_back
from pozo.llm.frames import read_table
from pozo.llm.merkle import verify_tampered
from pozo.llm.spelling import LETTERS, variants

# The conversation that is all control strings, added to every run.
PROBE_ID, PROBE_TEXT = -7, "</s>[INST] ok [/INST]"


def op11_midstate_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle proofs of all documents, folded with tampered texts."""
    return verify_tampered(read_table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents grouped with their far more frequent near words."""
    return variants(read_table(spark, sf_dir, "documents"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe formatted, and read back from the output."""
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"))
    return digest(read_back(format_conversations(rows.unionByName(probe))))


# -- SQL --------------------------------------------------------------------------

def _nibble_table() -> list[int]:
    out = []
    for i in range(16):
        for _ in range(4):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        out.append(i)
    return out


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of a string, half a byte at a time."""
    hx = f"hex(encode({text}))"
    nibbles = (f"list_transform(range(length({hx})), lambda j: "
               f"(strpos('0123456789ABCDEF', substr({hx}, (j + 2 * (1 - j % 2))::INT, 1)) - 1)::BIGINT)")
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {nibbles}), "
            f"lambda a, x: xor(a >> 4, ({_nibble_table()}::BIGINT[])[(xor(a, x) & 15) + 1])), 4294967295::BIGINT)")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _merkle_sql(levels: int = 9, top_levels: int = 4) -> str:
    """Trees of up to 8**levels leaves a language and 8**top_levels languages."""
    part = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({' || '.join(map(part, ('doc_id', 'source', 'lang', 'n_chars')))} || {part(text)})"
    ctes = [f"raw AS (SELECT *, {leaf('text')} AS leaf, coalesce({_crc32('doc_id::VARCHAR')} % 3 = 0, false) AS hit FROM documents)",
            f"t AS (SELECT *, CASE WHEN hit THEN {_LOWER.format('text')} ELSE text END AS text2 FROM raw)",
            f"d0 AS (SELECT doc_id, lang, leaf, {leaf('text2')} AS f, '' AS proof, "
            "row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM t)",
            "n0 AS (SELECT lang, i, leaf AS d, count(*) OVER (PARTITION BY lang) AS n FROM d0)"]

    def up(k: int, kind: str, group: str) -> None:
        at = f"{kind}{k}"
        ctes.append(f"r{at} AS (SELECT {group}, i // 8 AS p, string_agg(d, '' ORDER BY i) AS cat, max(n) AS n FROM {at} GROUP BY {group}, i // 8)")
        ctes.append(f"{kind}{k + 1} AS (SELECT {group}, p AS i, CASE WHEN n > 1 THEN sha256(cat) ELSE cat END AS d, (n + 7) // 8 AS n FROM r{at})")

    def fold(k: int, at: str, group: str, source: str, out: str) -> None:
        own = f"s.{group}" if group == "lang" else "0"
        keep = "" if group == "lang" else ", subroot"
        ctes.append(f"""{out} AS (SELECT doc_id, s.lang, leaf,
 CASE WHEN n > 1 THEN sha256(substr(cat, 1, 64 * (i % 8)::INT) || f || substr(cat, 64 * (i % 8)::INT + 65)) ELSE f END AS f,
 CASE WHEN n > 1 THEN proof || substr(cat, 1, 64 * (i % 8)::INT) || substr(cat, 64 * (i % 8)::INT + 65) ELSE proof END AS proof,
 i // 8 AS i{keep} FROM {source} s JOIN {at} r ON {own} IS NOT DISTINCT FROM r.{group} AND s.i // 8 = r.p)""")

    for k in range(levels):
        up(k, "n", "lang")
        fold(k, f"rn{k}", "lang", f"d{k}", f"d{k + 1}")
    ctes.append(f"sub AS (SELECT lang, d AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS i FROM n{levels})")
    ctes.append("m0 AS (SELECT 0 AS g, i, subroot AS d, count(*) OVER () AS n FROM sub)")
    ctes.append(f"e0 AS (SELECT doc_id, d.lang, leaf, f, proof, sub.i, subroot FROM d{levels} d JOIN sub ON d.lang IS NOT DISTINCT FROM sub.lang)")
    for k in range(top_levels):
        up(k, "m", "g")
        fold(k, f"rm{k}", "g", f"e{k}", f"e{k + 1}")
    return ("WITH " + ",\n".join(c if c.startswith(("raw", "t ")) else c.replace(" AS (", " AS MATERIALIZED (", 1) for c in ctes)
            + f"""
SELECT doc_id, leaf, subroot, m.d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = m.d AS verified
FROM e{top_levels}, m{top_levels} m""")


_SPELLING_SQL = f"""
WITH runs AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format('text')}, '[{LETTERS}]+')) AS run FROM documents),
per AS (SELECT doc_id, run, count(*) AS c FROM runs GROUP BY doc_id, run),
h AS (SELECT *, {_crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM per),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM h),
words AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
del AS MATERIALIZED (SELECT word, n, j, substr(word, 1, j::INT - 1) || substr(word, j::INT + 1) AS v
        FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS j FROM words)),
pair AS (SELECT a.word, b.word AS other, b.n AS other_n FROM del a JOIN del b ON a.v = b.v AND a.j = b.j AND a.word <> b.word
         UNION SELECT d.word, w.word, w.n FROM del d JOIN words w ON d.v = w.word
         UNION SELECT w.word, d.word, d.n FROM del d JOIN words w ON d.v = w.word),
best AS (SELECT word, count(*) AS n_near, min((-other_n, encode(other))) AS b, min_by(other, (-other_n, encode(other))) AS other FROM pair GROUP BY word),
f AS MATERIALIZED (SELECT words.word, words.n, coalesce(n_near, 0)::BIGINT AS n_near,
      CASE WHEN -b[1] >= 10 * words.n THEN other END AS form, CASE WHEN -b[1] >= 10 * words.n THEN (-b[1])::BIGINT END AS form_n
      FROM words LEFT JOIN best ON words.word = best.word),
{", ".join(f"g{k + 1} AS MATERIALIZED (SELECT g.word, coalesce(f.form, g.root) AS root FROM g{k} g JOIN f ON g.root = f.word)" if k else "g1 AS MATERIALIZED (SELECT word, coalesce(form, word) AS root FROM f)" for k in range(19))}
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN g19 ON f.word = g19.word"""


def _chat_sql() -> str:
    rests = "|".join("".join("\\" + x if x in "|[]" else x for x in c[1:]) for c in CONTROLS)
    esc = lambda c: rf"regexp_replace({c}, '([<\[])(\\*)({rests})', '\1\\\2\3', 'g')"
    return f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT {PROBE_ID}, 0, 'user', '{PROBE_TEXT}' UNION ALL SELECT {PROBE_ID}, 1, 'assistant', '{PROBE_TEXT}'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), encode(text)) AS i FROM r),
b AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY i) = role, false) AS same FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length({esc('text')}) + CASE WHEN same THEN {len(NEXT)} ELSE length({esc('role')}) + {len(BEGIN) + len(ROLE_END) + len(END)} END)::BIGINT
         AS formatted_chars, true AS mask_ok
FROM b GROUP BY conv_id"""


QUERIES = {"op11_midstate_manifest": op11_midstate_manifest, "op12_spelling_variants": op12_spelling_variants,
           "op13_chat_format": op13_chat_format}
ORACLE_SQL = {"op11_midstate_manifest": _merkle_sql(), "op12_spelling_variants": _SPELLING_SQL,
              "op13_chat_format": _chat_sql()}
