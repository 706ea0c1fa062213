"""The registered queries of this subpackage that DuckDB's SQL can express."""

from __future__ import annotations


def _field(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


#: CRC-32 of a decimal number, a bit at a time: each byte is followed by seven zeros.
_CRC_BITS = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
_CRC_EVEN = f"list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_CRC_BITS}), lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))) & 1 = 1"

_MERKLE = f"""
WITH RECURSIVE
base AS (
    SELECT doc_id, source, {_leaf("text")} AS leaf,
           CASE WHEN {_CRC_EVEN} THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS shown,
           count(*) OVER (PARTITION BY source) AS n
    FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM base),
up AS (
    SELECT source, 0 AS level, pos, leaf AS h, n FROM leaves
    UNION ALL
    SELECT source, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM up WHERE n > 1 GROUP BY source, level, pos // 3, n),
subroots AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
    SELECT 0 AS level, pos, h, n FROM subroots
    UNION ALL
    SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY level, pos // 3, n),
steps AS (
    SELECT a.source, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
    FROM up a JOIN up b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL),
top_steps AS (
    SELECT a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
    FROM top a JOIN top b ON a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL),
climb AS (
    SELECT doc_id, source, leaf, pos AS leaf_pos, 0 AS level, pos, n, shown AS folded, '' AS proof FROM leaves
    UNION ALL
    SELECT c.doc_id, c.source, c.leaf, c.leaf_pos, c.level + 1, c.pos // 3, (c.n + 2) // 3, sha256(s.l || c.folded || s.r), c.proof || s.l || s.r
    FROM climb c JOIN steps s ON c.source IS NOT DISTINCT FROM s.source AND c.level = s.level AND c.pos = s.pos WHERE c.n > 1),
across AS (
    SELECT c.doc_id, c.leaf, c.leaf_pos, s.h AS subroot, 0 AS level, s.pos, s.n, c.folded, c.proof
    FROM climb c JOIN subroots s ON c.source IS NOT DISTINCT FROM s.source WHERE c.n = 1
    UNION ALL
    SELECT c.doc_id, c.leaf, c.leaf_pos, c.subroot, c.level + 1, c.pos // 3, (c.n + 2) // 3, sha256(s.l || c.folded || s.r), c.proof || s.l || s.r
    FROM across c JOIN top_steps s ON c.level = s.level AND c.pos = s.pos WHERE c.n > 1)
SELECT a.doc_id, a.leaf, a.subroot, t.h AS root, sha256(a.proof) AS proof_sha256, a.folded AS folded_root, a.folded = t.h AS verified
FROM across a, (SELECT h FROM top WHERE n = 1) t WHERE a.n = 1"""

SQL = {"op11_merkle": _MERKLE}
