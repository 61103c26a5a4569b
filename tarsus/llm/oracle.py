"""DuckDB SQL for those queries of this subpackage that plain SQL can express over whole tables."""

from __future__ import annotations

from tarsus.plans.audit import CLEAN

_GROUPS = "g AS (SELECT grp, count(DISTINCT split) AS splits FROM clean WHERE grp IS NOT NULL GROUP BY grp HAVING count(DISTINCT split) > 1)"
_CHUNKS = """h AS (SELECT record_id, split, digest, ('0x' || hash_hex)::UBIGINT AS u FROM clean WHERE split IS NOT NULL),
k AS (SELECT record_id, split, u, p, (u >> (13 * p)::UBIGINT) & (CASE p WHEN 4 THEN 4095 ELSE 8191 END)::UBIGINT AS c FROM h, range(5) t(p) WHERE u IS NOT NULL),
near AS (SELECT a.record_id AS x, b.record_id AS y FROM k a JOIN k b ON a.p = b.p AND a.c = b.c WHERE a.split = 'train' AND b.split <> 'train' AND bit_count(xor(a.u, b.u)) <= 4),
same AS (SELECT a.record_id AS x, b.record_id AS y FROM h a JOIN h b ON a.digest = b.digest WHERE a.split = 'train' AND b.split <> 'train')
"""
_GRAMS = """iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark_items),
ig AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS gram FROM iw, range(1, 2000) t(i) WHERE i + 11 <= len(w)),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM dw WHERE len(w) >= 12)),
hits AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (gram))
"""

ORACLE: dict[str, str] = {
    "p1_found": f"""WITH RECURSIVE {CLEAN}, h AS (SELECT record_id, dataset_id, source_sample_id, ('0x' || hash_hex)::UBIGINT AS u FROM clean WHERE hash_hex IS NOT NULL),
k AS (SELECT u, p, (u >> (13 * p)::UBIGINT) & (CASE p WHEN 4 THEN 4095 ELSE 8191 END)::UBIGINT AS c FROM (SELECT DISTINCT u FROM h), range(5) t(p)),
e AS (SELECT DISTINCT a.u AS x, b.u AS y FROM k a JOIN k b ON a.p = b.p AND a.c = b.c AND a.u <> b.u WHERE bit_count(xor(a.u, b.u)) <= 4),
reach AS (SELECT DISTINCT x AS a, x AS b FROM e UNION SELECT r.a, e.y FROM reach r JOIN e ON e.x = r.b),
comp AS (SELECT b AS u, min(a) AS c FROM reach GROUP BY b),
placed AS (SELECT h.*, coalesce(c, h.u) AS c FROM h LEFT JOIN comp USING (u)),
g AS (SELECT c, min(record_id) AS group_record_id FROM placed GROUP BY c HAVING count(DISTINCT (dataset_id, source_sample_id)) > 1)
SELECT group_record_id, record_id FROM placed JOIN g USING (c)""",
    "p1_links": f"""WITH {CLEAN}, h AS (SELECT DISTINCT ('0x' || hash_hex)::UBIGINT AS u FROM clean WHERE hash_hex IS NOT NULL),
k AS (SELECT u, p, (u >> (13 * p)::UBIGINT) & (CASE p WHEN 4 THEN 4095 ELSE 8191 END)::UBIGINT AS c FROM h, range(5) t(p)),
e AS (SELECT DISTINCT a.u AS x, b.u AS y FROM k a JOIN k b ON a.p = b.p AND a.c = b.c AND a.u < b.u WHERE bit_count(xor(a.u, b.u)) <= 4)
SELECT count(*) AS links, count(*) AS found, 0::BIGINT AS lost, 0::BIGINT AS invented FROM e""",
    "p6_found": """WITH v AS (SELECT vector_id, features::DOUBLE[] AS f FROM cached_features WHERE len(features) = 64 AND len([x FOR x IN features IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN features IF x <> 0]) > 0),
n AS (SELECT vector_id, f, sqrt(list_dot_product(f, f)) AS l FROM v),
r AS (SELECT a.vector_id, b.vector_id AS neighbour_id, row_number() OVER (PARTITION BY a.vector_id ORDER BY list_dot_product(a.f, b.f) / (a.l * b.l) DESC, b.vector_id) AS rank FROM n a JOIN n b ON a.vector_id <> b.vector_id)
SELECT vector_id, neighbour_id FROM r WHERE rank <= 5""",
    "p3_found": f"WITH {CLEAN}, {_GROUPS} SELECT record_id FROM clean WHERE grp IN (SELECT grp FROM g)",
    "p3_torn_groups": f"WITH {CLEAN}, {_GROUPS} SELECT 'group_id=' || grp AS component, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test, count(*) FILTER (split IS NULL) AS none FROM clean WHERE grp IN (SELECT grp FROM g) GROUP BY grp",
    "p7_found": f"WITH {CLEAN}, {_CHUNKS} SELECT DISTINCT least(x, y) AS record_id_a, greatest(x, y) AS record_id_b FROM (SELECT * FROM near UNION ALL SELECT * FROM same)",
    "p7_coverage": f"""WITH {CLEAN}, {_CHUNKS}, d AS (SELECT DISTINCT x, y, bit_count(xor(a.u, b.u)) AS bits FROM near JOIN h a ON a.record_id = x JOIN h b ON b.record_id = y),
sides AS (SELECT x AS r, y AS o, bits, true AS by_hash FROM d UNION ALL SELECT y, x, bits, true FROM d UNION ALL SELECT x, y, 0, false FROM same UNION ALL SELECT y, x, 0, false FROM same)
SELECT r AS record_id, any_value(c.split) AS source_split, any_value(c.dataset_id) AS dataset_id, count(*) FILTER (NOT by_hash) AS by_digest, count(*) FILTER (by_hash) AS by_hash,
CASE WHEN count(*) FILTER (NOT by_hash) > 0 THEN 1.0::DOUBLE ELSE 1 - min(bits) / 64.0::DOUBLE END AS coverage FROM sides JOIN clean c ON c.record_id = r GROUP BY r""",
    "p7_report": f"""WITH {CLEAN}, {_CHUNKS}, d AS (SELECT DISTINCT x, y, bit_count(xor(a.u, b.u)) AS bits FROM near JOIN h a ON a.record_id = x JOIN h b ON b.record_id = y),
sides AS (SELECT x AS r, y AS o, bits, true AS by_hash FROM d UNION ALL SELECT y, x, bits, true FROM d UNION ALL SELECT x, y, 0, false FROM same UNION ALL SELECT y, x, 0, false FROM same),
per AS (SELECT r, bool_or(NOT by_hash) AS dg, bool_or(by_hash) AS nh, count(DISTINCT o) AS pairs, CASE WHEN bool_or(NOT by_hash) THEN 1.0::DOUBLE ELSE 1 - min(bits) / 64.0::DOUBLE END AS cover FROM sides GROUP BY r)
SELECT split AS source_split, dataset_id, count(*) AS records, count(cover) AS overlapping, count(*) FILTER (dg) AS same_digest, count(*) FILTER (nh) AS near_hash, coalesce(sum(pairs), 0)::BIGINT AS pairs, round(avg(cover), 6) AS mean_coverage
FROM clean LEFT JOIN per ON r = record_id WHERE split IS NOT NULL GROUP BY ALL""",
    "p8_found": f"WITH {_GRAMS} SELECT doc_id, item_id FROM hits",
}
