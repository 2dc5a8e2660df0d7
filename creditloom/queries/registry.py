"""Registry that keeps a query and its SQL counterpart side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# Shared views as common table expressions.
CTES = {
    "loan_book": """
loan_lines AS (
  SELECT l_orderkey, COUNT(*) AS n, SUM(l_extendedprice * (1 - l_discount)) AS rec,
         CAST(SUM(CAST(ROUND(l_discount * 100) AS BIGINT)) AS DOUBLE) / COUNT(*) / 100 AS disc
  FROM lineitem GROUP BY l_orderkey),
loan_book AS (
  SELECT o.o_orderkey AS id, o.o_orderstatus AS loan_status,
    CASE WHEN o.o_orderstatus = 'F' AND (o.o_orderpriority IN ('1-URGENT', '2-HIGH')
              OR o.o_totalprice > 250000) THEN 0 ELSE 1 END AS good_bad,
    o.o_orderpriority AS grade,
    CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE c.c_mktsegment END AS purpose,
    n.n_name AS addr_state, o.o_totalprice AS funded_amnt,
    CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE c.c_acctbal END AS dti,
    COALESCE(li.n, 0) AS open_acc, li.disc AS int_rate,
    COALESCE(li.rec, 0.0) AS total_rec_prncp, o.o_orderdate AS issue_d
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN loan_lines li ON li.l_orderkey = o.o_orderkey)""",
    "loan_text": """
loan_text AS (
  SELECT d.doc_id AS id, COALESCE(l.quality, 1) AS good_bad,
    d.text AS desc_, d.source AS title, d.lang
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
    "loan_text_gaps": """
loan_text_gaps AS (
  SELECT id, good_bad, CASE WHEN id % 3 = 0 THEN NULL ELSE desc_ END AS desc_, title, lang FROM loan_text)""",
    "titles": """
titles AS (SELECT p_partkey AS id, p_name AS emp_title, p_brand, p_size FROM part)""",
    "word_vectors": """
word_vectors AS (
  SELECT 'w' || vec_id AS word, CAST(embedding AS DOUBLE[]) AS vector, label FROM embeddings)""",
    "scored": """
scored AS (
  SELECT id, good_bad, 1 - good_bad AS y, grade, funded_amnt, total_rec_prncp,
    FLOOR(funded_amnt / 500) / 1000 AS pd_a,
    CAST(CASE WHEN grade IN ('1-URGENT', '2-HIGH') THEN 0.4 ELSE 0.2 END AS DOUBLE) AS pd_b
  FROM loan_book)""",
    "scored_long": """
scored_long AS (
  SELECT 'a' AS model, id, y, CAST(pd_a AS DOUBLE) AS score FROM scored UNION ALL
  SELECT 'b', id, y, CAST(pd_b AS DOUBLE) FROM scored)""",
}
_NEEDS = {"loan_text_gaps": ["loan_text"], "scored": ["loan_book"], "scored_long": ["loan_book", "scored"]}


def sql_on(*views: str, body: str) -> str:
    """SQL text with the CTEs of ``views`` in front. ``body`` may start with its own CTEs."""
    names: list[str] = []
    for view in views:
        for name in [*_NEEDS.get(view, []), view]:
            if name not in names:
                names.append(name)
    head = ",".join(CTES[n] for n in names)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[len('WITH RECURSIVE '):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
