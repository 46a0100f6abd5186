"""Training-data operators over documents, embeddings and pages.

Nothing outside this subpackage imports it; ``QUERIES`` and ``ORACLE_SQL``
are what the entry point registers.
"""

from pozo.llm import queries_a, queries_b, queries_c, queries_d, queries_e

QUERIES = {**queries_a.QUERIES, **queries_b.QUERIES, **queries_c.QUERIES, **queries_d.QUERIES, **queries_e.QUERIES}
ORACLE_SQL = {**queries_a.ORACLE_SQL, **queries_b.ORACLE_SQL, **queries_c.ORACLE_SQL, **queries_d.ORACLE_SQL,
              **queries_e.ORACLE_SQL}
