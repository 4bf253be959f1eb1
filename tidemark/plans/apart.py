"""SQL of its own formulation for queries whose text both engines could share: counts from the tables instead of a graph,
correlated subqueries, set operations and list functions instead of joins and windows."""

from __future__ import annotations

APART: dict[str, str] = {
    "graph_nodes": """SELECT 'Region' AS label, count(*) AS n, count(DISTINCT r_regionkey) AS n_keys, count(r_name) AS n_named FROM region UNION ALL SELECT 'Nation', count(*), count(DISTINCT n_nationkey), count(n_name) FROM nation UNION ALL SELECT 'Customer', count(*), count(DISTINCT c_custkey), count(c_name) FROM customer
UNION ALL SELECT 'Supplier', count(*), count(DISTINCT s_suppkey), count(s_name) FROM supplier UNION ALL SELECT 'Part', count(*), count(DISTINCT p_partkey), count(p_name) FROM part UNION ALL SELECT 'Order', count(*), count(DISTINCT o_orderkey), count(o_orderstatus) FROM orders""",
    "graph_edges": """SELECT 'PART_OF' AS type, count(*) AS n, count(DISTINCT n_nationkey) AS n_src, count(DISTINCT n_regionkey) AS n_dst FROM nation UNION ALL SELECT 'PLACED', count(*), count(DISTINCT o_custkey), count(DISTINCT o_orderkey) FROM orders
UNION ALL SELECT 'LOCATED_IN', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier), (SELECT count(DISTINCT c_custkey) FROM customer) + (SELECT count(DISTINCT s_suppkey) FROM supplier), (SELECT count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier) u)
UNION ALL SELECT 'CONTAINS', count(DISTINCT (l_orderkey, l_partkey)), count(DISTINCT l_orderkey), count(DISTINCT l_partkey) FROM lineitem""",
    "degree": """WITH c AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), d AS (SELECT 'Region' AS label, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS x FROM region
UNION ALL SELECT 'Nation', 1 + (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) FROM nation UNION ALL SELECT 'Customer', 1 + (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) FROM customer UNION ALL SELECT 'Supplier', 1 FROM supplier
UNION ALL SELECT 'Part', (SELECT count(*) FROM c WHERE p = p_partkey) FROM part UNION ALL SELECT 'Order', 1 + (SELECT count(*) FROM c WHERE o = o_orderkey) FROM orders) SELECT label, count(*) AS n, sum(x)::BIGINT AS ends, max(x) AS most FROM d GROUP BY label""",
    "endpoint_shape": """SELECT 'PART_OF' AS type, 'Nation' AS src_label, 'Region' AS dst_label, count(*) AS n FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region) HAVING count(*) > 0 UNION ALL SELECT 'LOCATED_IN', 'Customer', 'Nation', count(*) FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation) HAVING count(*) > 0
UNION ALL SELECT 'LOCATED_IN', 'Supplier', 'Nation', count(*) FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation) HAVING count(*) > 0 UNION ALL SELECT 'PLACED', 'Customer', 'Order', count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) HAVING count(*) > 0
UNION ALL SELECT 'CONTAINS', 'Order', 'Part', count(DISTINCT (l_orderkey, l_partkey)) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) AND l_partkey IN (SELECT p_partkey FROM part) HAVING count(*) > 0""",
    "unevidenced_facts": "SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'",
    "fact_evidence": """SELECT l_orderkey, l_linenumber, o_orderpriority, c_name, n_name, (SELECT r_name FROM region WHERE r_regionkey = n_regionkey) AS r_name FROM lineitem, orders, customer, nation WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey""",
    "overview_topn": """WITH t AS (SELECT o_custkey, list((o_orderdate, o_orderkey, o_totalprice) ORDER BY o_orderdate DESC, o_orderkey DESC)[:3] AS best FROM orders GROUP BY o_custkey), u AS (SELECT o_custkey, unnest(best) AS b, generate_subscripts(best, 1) AS r FROM t)
SELECT o_custkey, b[2] AS o_orderkey, b[3] AS o_totalprice, r::INTEGER AS r FROM u""",
    "coverage_lattice": """WITH s AS (SELECT DISTINCT year(o_orderdate)::INTEGER AS y, quarter(o_orderdate)::INTEGER AS q FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) AND o_custkey IN (SELECT c_custkey FROM customer))
SELECT n_name, y, q, (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey AND year(o_orderdate) = y AND quarter(o_orderdate) = q AND o_orderkey IN (SELECT l_orderkey FROM lineitem))::BIGINT AS n_orders FROM nation, s""",
    "evidence_backbone": """WITH p AS (SELECT l_suppkey, l_partkey, l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL), q AS (SELECT (SELECT s_nationkey FROM supplier WHERE s_suppkey = l_suppkey) AS nk, (SELECT p_brand FROM part WHERE p_partkey = l_partkey) AS p_brand, l_orderkey, n FROM p)
SELECT n_name, p_brand, sum(n)::BIGINT AS citations, count(DISTINCT l_orderkey) AS n_orders FROM q JOIN nation ON nk = n_nationkey WHERE p_brand IS NOT NULL GROUP BY n_name, p_brand""",
    "neighbour_context": """WITH t AS (SELECT conv_id, turn, unnest([-1, 0, 1]) AS away FROM conversations WHERE role = 'assistant') SELECT t.conv_id, t.turn, (c.turn - t.turn) AS away, c.role, length(c.text)::INTEGER AS n_chars FROM t JOIN conversations c ON c.conv_id = t.conv_id AND c.turn = t.turn + t.away""",
    "previous_passage": """WITH k AS (SELECT DISTINCT conv_id, turn + 1 AS turn, turn AS previous_turn FROM conversations) SELECT c.conv_id, c.turn, (SELECT max(k.previous_turn) FROM k WHERE k.conv_id = c.conv_id AND k.turn = c.turn) AS previous_turn FROM conversations c""",
    "payload_ids": """SELECT doc_id, 'no label' AS missing FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) a UNION ALL SELECT doc_id, 'no document' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents) b""",
    "counter_evidence_scope": "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS n_open FROM customer",
    "claim_agreement": "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE NOT (l_shipdate >= o_orderdate AND l_quantity > 0 AND l_discount >= 0 AND l_discount <= 1 AND l_tax <= 0.07)",
    "forms_by_year_pivot": """SELECT o_orderpriority AS priority, year(o_orderdate)::INTEGER AS y, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'all', year(o_orderdate)::INTEGER, count(*) FROM orders GROUP BY year(o_orderdate) UNION ALL SELECT o_orderpriority, 0, count(*) FROM orders GROUP BY o_orderpriority UNION ALL SELECT 'all', 0, count(*) FROM orders""",
    "review_sample": "SELECT lang, unnest(list(doc_id ORDER BY doc_id)[:5]) AS doc_id FROM documents GROUP BY lang",
    "provenance_inventory": "SELECT source, count(*) AS n, count(*) FILTER (WHERE lang IS NOT NULL) AS n_lang, len(list_distinct(list(lang) FILTER (WHERE lang IS NOT NULL)))::BIGINT AS n_langs, count(*) FILTER (WHERE text IS NULL) AS n_missing FROM documents GROUP BY source",
    "repetition_cosine": """WITH s AS (SELECT c_nationkey AS c, list_distinct(list(l_partkey)) AS parts FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey)
SELECT a.c AS left_segment, b.c AS right_segment, round(len(list_intersect(a.parts, b.parts)) / sqrt(len(a.parts)::DOUBLE * len(b.parts)), 6) AS cosine FROM s a JOIN s b ON a.c < b.c WHERE len(list_intersect(a.parts, b.parts)) > 0""",
    "kind_sizes": "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS total, max(n_chars) AS largest, round(sum(n_chars) / count(n_chars), 4) AS mean_chars FROM documents GROUP BY lang",
}
