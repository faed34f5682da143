"""Reference SQL of the queries that SQL can express."""

from __future__ import annotations

from eventlane.llm.decontaminate import LOOSE, SHORTEST, WINDOW, masks_of

ORACLE: dict[str, str] = {}

ORACLE["op6_warc"] = """
WITH q AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS o FROM q WHERE n >= 1000 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, q.d AS payload_digest,
  CASE WHEN o <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN o <> page_id THEN o END AS refers_to
FROM q LEFT JOIN m ON q.d = m.d
"""

_MASKS = {width: masks_of(width, 0.8) for width in range(SHORTEST, WINDOW + 1)}
_ALL = list(dict.fromkeys(m for own in _MASKS.values() for m in own))


def _keys(rows: str, exact: bool) -> str:
    """The seeds of rows of words ``w``: of a benchmark window those of its width, else all that its words reach."""
    parts = []
    for m, mask in enumerate(_ALL):
        widths = ", ".join(str(w) for w, own in _MASKS.items() if mask in own)
        words = ", ".join(f"w[{i + 1}]" for i, c in enumerate(mask) if c == "1")
        fits = f"len(w) IN ({widths})" if exact else f"len(w) > {mask.rindex('1')}"
        parts.append(f"SELECT *, {m} AS m, concat_ws(' ', {words}) AS k FROM {rows} WHERE {fits}")
    return " UNION ALL ".join(parts)


_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')"
ORACLE["op8_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS t FROM documents),
dw AS (SELECT doc_id, p AS pos, t[p + 1 : p + {WINDOW}] AS w FROM (SELECT doc_id, t, unnest(range(len(t))) AS p FROM d)),
b AS (SELECT item_id, {_WORDS} AS t FROM benchmark),
bw AS (SELECT DISTINCT item_id, w FROM (
  SELECT item_id, t[p + 1 : p + {WINDOW}] AS w FROM (SELECT item_id, t, unnest(range(len(t))) AS p FROM b WHERE len(t) >= {SHORTEST})
  WHERE p + {WINDOW} <= len(t) OR (p = 0 AND len(t) < {WINDOW}))),
dk AS ({_keys("dw", False)}), bk AS ({_keys("bw", True)}),
hits AS (SELECT DISTINCT doc_id, item_id, pos, dk.w AS v, bk.w AS w FROM dk JOIN bk USING (m, k)),
same AS (SELECT doc_id, item_id, pos, len(w) AS n, len(list_filter(range(1, len(w) + 1), lambda i: v[i] = w[i])) / len(w) AS s FROM hits),
best AS (SELECT doc_id, item_id, pos, max(s) AS s FROM same WHERE s >= CASE WHEN n < {LOOSE} THEN 1 ELSE 0.8 END GROUP BY ALL)
SELECT doc_id, item_id, count(*) AS n_windows, max(s) AS similarity, min(pos) AS first_word FROM best GROUP BY doc_id, item_id
"""

ORACLE["op9_embeddings"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT a AS node, a AS reach FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reach),
c AS (SELECT node, min(reach) AS root FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN c ON vec_id = c.node
"""

ORACLE["op11_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS s
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, (row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b))::INTEGER AS rank,
  s.b AS negative_id, p.s AS positive_score, s.s AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * p.s <= 100 * s.s AND 100 * s.s <= 95 * p.s QUALIFY rank <= 3
"""
