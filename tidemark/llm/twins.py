"""SQL twins of corpus operators whose result is a plain question about the tables.

They compare every pair that shares a key, so they serve small tables, as checks.
"""

from __future__ import annotations

from tidemark.llm.common import LOWER, UPPER

# fixed values: the alphabet of base32, and the bits of the hexadecimal digits in order
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_NIBBLES = "".join(f"{i:04b}" for i in range(16))


def _components(nodes: str, links: str, node: str) -> str:
    """Blocks ``both`` (x, y), ``reach`` and ``least``: the least node that each one reaches by ``links`` (x, y)."""
    return (
        f"both_ways AS (SELECT x, y FROM {links} UNION ALL SELECT y, x FROM {links}), "
        f"reach AS (SELECT {node} AS a, {node} AS r FROM {nodes} UNION SELECT e.y, reach.r FROM reach JOIN both_ways e ON e.x = reach.a WHERE reach.r < e.y), "
        "least AS (SELECT a, min(r) AS component_id FROM reach GROUP BY a), "
        "degree AS (SELECT x AS a, count(*) AS n_links FROM both_ways GROUP BY x)"
    )


#: Sets of three-word shingles that reach a Jaccard similarity of 0.9.
JACCARD = (
    rf"WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents), "
    "s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] "
    "ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) END) AS g FROM w), "
    "n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY 1), "
    "pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2), "
    "links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.k + q.k - c)), "
    + _components("w", "links", "doc_id")
    + " SELECT w.doc_id, CAST(coalesce(k, 0) AS BIGINT) AS n_shingles, component_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links FROM w "
    "JOIN least ON least.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN degree ON degree.a = w.doc_id"
)

#: Vectors of cosine 0.9 and more; all of the table's must be usable.
COSINE = (
    "WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), "
    "links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) "
    "WHERE list_cosine_similarity(a.e, b.e) >= 0.9), "
    + _components("v", "links", "vec_id")
    + " SELECT v.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept FROM v "
    "JOIN least ON least.a = v.vec_id LEFT JOIN degree ON degree.a = v.vec_id"
)

_BITS = f"array_to_string(list_transform(string_split(h, ''), lambda c: substr('{_NIBBLES}', 4 * strpos('0123456789abcdef', c) - 3, 4)), '')"
_FIVE = " + ".join(f"{16 >> j} * CAST(substr(bits, CAST(5 * i + {j + 1} AS BIGINT), 1) AS INT)" for j in range(5))

#: Pages of equal payload: the one of the largest id is the response.
WARC = (
    "WITH p AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages), "
    "q AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS last_id, sha1(body) AS h FROM p), "
    f"b AS (SELECT *, {_BITS} AS bits FROM q) "
    "SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, "
    f"array_to_string(list_transform(range(32), lambda i: substr('{_BASE32}', 1 + {_FIVE}, 1)), '') AS payload_digest, "
    "CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type, "
    "CAST(CASE WHEN page_id = last_id THEN NULL ELSE last_id END AS DOUBLE) AS refers_to, url, CAST(NULL AS VARCHAR) AS problem FROM b"
)
