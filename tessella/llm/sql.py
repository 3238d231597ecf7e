"""SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from tessella.llm import quality


OP2 = """
WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.n <> q.n AND len(c.e) = len(q.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10"""

OP7 = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
w AS (SELECT k, doc_id, i, list_aggregate(words[i : i + 49], 'string_agg', ' ') AS win
  FROM d, LATERAL (SELECT unnest(range(1, len(words) - 48)) AS i)),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY win) AS first FROM w),
g AS (SELECT DISTINCT k, i + o AS pos FROM f, LATERAL (SELECT unnest(range(0, 50)) AS o) WHERE first < doc_id),
h AS (SELECT k, list(pos) AS gone FROM g GROUP BY k),
x AS (SELECT doc_id, words, coalesce(gone, []) AS gone FROM d LEFT JOIN h USING (k))
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_filter(words, lambda z, i: NOT list_contains(gone, i)), ' '), '')) AS kept_sha256 FROM x"""


def oracle_sql() -> dict[str, str]:
    return {"op2_va_topk": OP2, "op7_rlz_repeats": OP7, "op8_quality_rules": quality.verdicts_sql()}
