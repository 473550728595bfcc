"""SQL of the numbered operators that SQL can express, for DuckDB."""

from __future__ import annotations

#: Exact search in SQL: every pair of a query and a candidate, then the ranks.
_TOP_K = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: Every window of every text against every window of the items.
_CONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (
    SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS t
    FROM (SELECT item, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM (SELECT *, least(10, len(w)) AS size FROM b WHERE len(w) > 0))
), dw AS (
    SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS t
    FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)
), hit AS (SELECT r, i, dw.size, item FROM dw JOIN bw ON dw.t = bw.t AND dw.size = bw.size),
marked AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hit) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (r) LEFT JOIN named USING (r)
"""


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"


def _leaf(n_chars: str) -> str:
    return f"sha256(concat({', '.join(map(_field, ('doc_id', 'source', 'lang', n_chars, 'text')))}))"


#: Bit by bit, low bits first, as the checksum is defined.
_CRC = """xor(list_reduce([CAST(4294967295 AS BIGINT)] || flatten(list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1),
    lambda i: list_transform(range(0, 8), lambda b: (CAST(ord(CAST(doc_id AS VARCHAR)[i]) AS BIGINT) >> b) & 1))),
    lambda x, b: xor(x >> 1, 3988292384 * (xor(x, b) & 1))), 4294967295)"""

_RISE = "SELECT tree, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {0}) WHERE n > 1 GROUP BY tree, level, idx // 2"
_CLIMB = """SELECT c.r, c.tree, c.level + 1, c.idx // 2, sha256(CASE WHEN s.h IS NULL THEN c.cur WHEN c.idx % 2 = 1 THEN s.h || c.cur ELSE c.cur || s.h END), c.proof || coalesce(s.h, '')
    FROM {0} c JOIN {1} t ON t.tree = c.tree AND c.level < t.level LEFT JOIN {2} s ON s.tree = c.tree AND s.level = c.level AND s.idx = xor(c.idx, 1)"""

#: All levels of the trees of groups and of the tree over them, then a climb level by level.
_MERKLE = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS tree, {_leaf("n_chars")} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_leaf("(n_chars + 1)")} END AS other FROM documents
), placed AS (
    SELECT row_number() OVER () AS r, doc_id, tree, leaf, coalesce(other, leaf) AS cur, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves
), lv AS (
    SELECT tree, 0 AS level, idx, leaf AS h FROM placed UNION ALL {_RISE.format("lv")}
), tops AS (
    SELECT tree, max(level) AS level, max_by(h, level) AS h FROM lv GROUP BY tree
), ranked AS (
    SELECT tree, row_number() OVER (ORDER BY tree) - 1 AS idx, h FROM tops
), tl AS (
    SELECT '*' AS tree, 0 AS level, idx, h FROM ranked UNION ALL {_RISE.format("tl")}
), ttop AS (
    SELECT tree, max(level) AS level, max_by(h, level) AS h FROM tl GROUP BY tree
), c1 AS (
    SELECT r, tree, 0 AS level, idx, cur, '' AS proof FROM placed UNION ALL {_CLIMB.format("c1", "tops", "lv")}
), c2 AS (
    SELECT c1.r, '*' AS tree, 0 AS level, ranked.idx, c1.cur, c1.proof FROM c1 JOIN tops ON tops.tree = c1.tree AND tops.level = c1.level JOIN ranked ON ranked.tree = c1.tree
    UNION ALL {_CLIMB.format("c2", "ttop", "tl")}
)
SELECT doc_id, leaf, tops.h AS subroot, ttop.h AS root, sha256(c2.proof) AS proof_sha256, c2.cur AS folded_root, c2.cur = ttop.h AS verified
FROM c2 JOIN ttop ON ttop.level = c2.level JOIN placed USING (r) JOIN tops ON tops.tree = placed.tree
"""

SQL = {"op3_top_k": _TOP_K, "op12_contamination": _CONTAMINATION, "op13_merkle_manifest": _MERKLE}
