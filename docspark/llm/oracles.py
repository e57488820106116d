"""DuckDB SQL of the queries whose whole result SQL can express; the others are tested against brute force in tests/llm."""

from __future__ import annotations

from .itemsets import LEAST, MIN_PERCENT, PER_BASKETS


def _merkle() -> str:
    """Levels are written out: eight for documents and three for languages, which is more than 10**7 rows and 500 languages."""
    ctes = [
        """crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))) AS t)""",
        """given AS (SELECT doc_id, lang, source, n_chars, text, xor(list_reduce(list_concat([4294967295::BIGINT],
            list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM documents, crc_table)""",
    ]
    field = lambda x: f"coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda text: "sha256(" + " || ".join([*(field(c) for c in ("doc_id", "source", "lang", "n_chars")), field(text)]) + ")"
    ctes.append(f"leaves AS (SELECT doc_id, lang, {leaf('text')} AS leaf, {leaf(f'(CASE WHEN crc % 3 = 0 THEN {lower} ELSE text END)')} AS now FROM given)")
    ctes.append("placed AS (SELECT *, coalesce('+' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM leaves)")

    def tree(name: str, first: str, levels: int) -> None:
        ctes.append(f"{name}0 AS ({first})")
        for k in range(levels):
            run = "OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN"
            ctes.append(
                f"{name}s{k} AS (SELECT g, i, n, coalesce(string_agg(d, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
                f"coalesce(string_agg(d, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})"
            )
            ctes.append(
                f"{name}{k + 1} AS (SELECT g, i // 8 AS i, CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE min(d) END AS d, (n + 7) // 8 AS n FROM {name}{k} GROUP BY g, i // 8, n)"
            )

    deep, flat = 8, 3
    tree("a", "SELECT g, r AS i, leaf AS d, n FROM placed", deep)
    tree("b", f"SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, d, count(*) OVER () AS n, g AS name FROM a{deep}", flat)
    ctes.append("f0 AS (SELECT p.*, b.i AS gi, p.now AS acc, '' AS proof FROM placed p JOIN b0 b ON b.name = p.g)")
    at = 0
    for name, levels, group, index in (("a", deep, "f.g", "f.r"), ("b", flat, "''", "f.gi")):
        for k in range(levels):
            ctes.append(
                f"f{at + 1} AS (SELECT f.* REPLACE (CASE WHEN s.n > 1 THEN sha256(s.l || f.acc || s.r) ELSE f.acc END AS acc, f.proof || s.l || s.r AS proof) "
                f"FROM f{at} f JOIN {name}s{k} s ON s.g = {group} AND s.i = {index} // {8**k})"
            )
            at += 1
    return f"""WITH {", ".join(ctes)}
SELECT f.doc_id, f.leaf, a.d AS subroot, b.d AS root, sha256(f.proof) AS proof_sha256, f.acc AS folded_root, f.acc = b.d AS verified
FROM f{at} f JOIN a{deep} a ON a.g = f.g, b{flat} b"""


_WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT *, CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS kept FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN kept <> page_id THEN kept END AS refers_to FROM m"""

_ITEMSETS = f"""WITH RECURSIVE b AS (SELECT DISTINCT sale_id, item_id FROM sale_lines WHERE sale_id IS NOT NULL AND item_id IS NOT NULL),
t AS (SELECT count(DISTINCT sale_id) AS total FROM b),
f AS (SELECT sale_id, item_id FROM (SELECT *, count(*) OVER (PARTITION BY item_id) AS n FROM b), t WHERE n >= {LEAST} AND n * {PER_BASKETS} >= total),
occ AS (SELECT [item_id] AS z, item_id AS last, sale_id FROM f
  UNION ALL
  SELECT z, last, sale_id FROM (
    SELECT list_append(o.z, f.item_id) AS z, f.item_id AS last, o.sale_id, count(*) OVER (PARTITION BY list_append(o.z, f.item_id)) AS n
    FROM occ o JOIN f ON f.sale_id = o.sale_id AND f.item_id > o.last), t WHERE n >= {LEAST} AND n * {PER_BASKETS} >= total),
sets AS MATERIALIZED (SELECT z, count(*) AS s FROM occ GROUP BY z),
parts AS MATERIALIZED (SELECT z, s, unnest(z) AS c, unnest(list_transform(z, lambda x: list_filter(z, lambda y: y <> x))) AS x FROM sets WHERE len(z) > 1),
closed AS (SELECT z, s FROM sets WHERE NOT EXISTS (SELECT 1 FROM parts p WHERE p.x = sets.z AND p.s = sets.s)),
rules AS (SELECT p.z, p.c, r.s AS a, k.s AS s FROM parts p JOIN sets r ON r.z = p.x JOIN sets k ON k.z = [p.c], t
  WHERE 100 * p.s >= {MIN_PERCENT} * r.s AND p.s * total > r.s * k.s),
told AS (SELECT z, count(*) AS n, arg_min(c, (a, c)) AS best, string_agg(c || ':' || a || ':' || s, ';' ORDER BY c) AS listed FROM rules GROUP BY z)
SELECT array_to_string(z, ',') AS items, len(z)::BIGINT AS n_items, closed.s AS support, coalesce(n, 0) AS n_rules, best AS best_item, sha256(coalesce(listed, '')) AS rules_sha256
FROM closed LEFT JOIN told USING (z)"""

ORACLE_SQL: dict[str, str] = {"op11_merkle": _merkle(), "op12_warc": _WARC, "op13_itemsets": _ITEMSETS}
