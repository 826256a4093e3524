"""SQL for DuckDB with the same rows as the queries that SQL can express."""

from __future__ import annotations

# Every text whole; pieces between matches and the matches' lengths give the places.
_ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _spans(name: str, kind: int, pattern: str, group: int, least: int) -> str:
    return f"""
{name} AS (
  SELECT doc_id, {kind} AS kind, '{name}' AS rule, start, start + length(whole) AS stop
  FROM (
    SELECT doc_id, whole, part,
      list_sum(list_transform(gaps[:i], lambda x: length(x)))
        + coalesce(list_sum(list_transform(wholes[:i - 1], lambda x: length(x))), 0) AS start
    FROM (
      SELECT doc_id, gaps, wholes, unnest(wholes) AS whole, unnest(parts) AS part,
        unnest(range(1, len(wholes) + 1)) AS i
      FROM (
        SELECT doc_id, string_split_regex(body, '{pattern}') AS gaps,
          regexp_extract_all(body, '{pattern}', 0) AS wholes,
          regexp_extract_all(body, '{pattern}', {group}) AS parts
        FROM texts
      )
    )
  )
  WHERE length(part) >= {least}
)"""


SECRETS = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
{_spans("assign", 0, _ASSIGN, 1, 6)},
{_spans("access", 1, "AKIA[A-Z0-9]+", 0, 20)},
{_spans("hex", 2, "[0-9a-f]+", 0, 24)},
found AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
    count(*) FILTER (kind = 2) AS n_hex,
    string_agg(rule || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, kind) AS spans
  FROM (FROM assign UNION ALL FROM access UNION ALL FROM hex)
  GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
  coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN found USING (doc_id)
"""

VECTORS = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
),
scores AS (
  SELECT q.vec_id AS query_id, b.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * b.w[i])) AS BIGINT) AS score
  FROM v q JOIN v b ON q.vec_id <> b.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id, score
FROM scores
QUALIFY rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_vector_search": VECTORS, "op7_secret_scans": SECRETS}
