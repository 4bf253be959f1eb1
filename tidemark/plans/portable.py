"""Named queries in SQL that Spark and other engines read alike.

PARTS are relations that queries build on (observations, canonical points, steps between points, a property
graph); compose() puts the parts that a query names, and those they name, in front of it. Spark plans the
whole as one tree, so filters and columns reach the scans of the tables.
"""

from __future__ import annotations

import re

PARTS: dict[str, str] = {
    # observations: three readings per subject and quarter, one rounded to thousands, one to millions, and
    # for some subjects one that disagrees
    "revenue": """
SELECT n.n_name AS subject, n.n_nationkey AS subject_id, CAST(year(o.o_orderdate) AS INT) AS y, CAST(quarter(o.o_orderdate) AS INT) AS q,
       round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS value, count(DISTINCT o.o_orderkey) AS n_orders
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
GROUP BY n.n_name, n.n_nationkey, year(o.o_orderdate), quarter(o.o_orderdate)""",
    "observation": """
SELECT subject, 'revenue' AS metric, y * 4 + q - 1 AS slot, CAST(y AS STRING) || 'Q' || CAST(q AS STRING) AS period_key,
       'D' || CAST(k AS STRING) AS document, CASE k WHEN 1 THEN 'millions' ELSE 'thousands' END AS scale,
       CASE k WHEN 0 THEN round(value / 1000, 0) * 1000 WHEN 1 THEN round(value / 1000000, 0) * 1000000 ELSE round(value * 1.5 / 1000, 0) * 1000 END AS value,
       subject || ':' || CAST(y * 4 + q - 1 AS STRING) || ':' || CAST(k AS STRING) AS observation_id
FROM revenue CROSS JOIN (VALUES (0), (1), (2), (3)) AS d(k) WHERE k < 2 OR k = 2 AND (subject_id + q) % 5 = 0 OR k = 3 AND (subject_id + q + y) % 7 = 0""",
    # single linkage inside a slot: a new cluster begins where neighbours differ by more than the coarser tolerance
    "toleranced": """
SELECT *, CASE scale WHEN 'millions' THEN 1000000.0 ELSE 1000.0 END AS tolerance FROM observation""",
    "linked": """
SELECT *, CASE WHEN round(abs(value - lag(value) OVER s), 9) > greatest(tolerance, lag(tolerance) OVER s) THEN 1 ELSE 0 END AS breaks
FROM toleranced WINDOW s AS (PARTITION BY subject, metric, slot ORDER BY value, observation_id)""",
    "clustered": """
SELECT *, sum(breaks) OVER (PARTITION BY subject, metric, slot ORDER BY value, observation_id ROWS UNBOUNDED PRECEDING) AS cluster FROM linked""",
    "cluster_size": """
SELECT subject, metric, slot, period_key, cluster, count(*) AS n, count(DISTINCT document) AS n_docs, min(value) AS low, max(value) AS high,
       min(CASE scale WHEN 'thousands' THEN '0' ELSE '1' END || observation_id) AS best
FROM clustered GROUP BY subject, metric, slot, period_key, cluster""",
    "ranked_cluster": """
SELECT *, row_number() OVER (PARTITION BY subject, metric, slot ORDER BY n_docs DESC, low, cluster) AS r,
       lead(n_docs) OVER (PARTITION BY subject, metric, slot ORDER BY n_docs DESC, low, cluster) AS next_docs FROM cluster_size""",
    "point": """
SELECT c.subject, c.metric, c.slot, c.period_key, c.n_docs,
       CASE WHEN c.next_docs IS NULL THEN 'ok' WHEN c.n_docs >= 2 AND c.n_docs >= 2 * c.next_docs THEN 'resolved_by_majority' ELSE 'conflict' END AS status,
       o.value, o.tolerance, o.observation_id
FROM ranked_cluster c JOIN toleranced o ON o.observation_id = substr(c.best, 2) WHERE c.r = 1""",
    "valued": "SELECT * FROM point WHERE status <> 'conflict'",
    "step": """
SELECT *, round(value - before, 9) AS delta,
       CASE WHEN before IS NULL THEN 'SERIES_UNAVAILABLE' WHEN round(abs(value - before), 9) <= greatest(tolerance, before_tolerance) THEN 'WITHIN_PRESENTATION_TOLERANCE'
            WHEN slot - before_slot <> 1 THEN 'SERIES_GAP' ELSE 'ok' END AS verdict
FROM (SELECT *, lag(value) OVER w AS before, lag(slot) OVER w AS before_slot, lag(tolerance) OVER w AS before_tolerance FROM valued
      WINDOW w AS (PARTITION BY subject, metric ORDER BY slot)) p""",
    "floor_of": "SELECT metric, 0.1 * median(abs(value)) AS floor_value FROM valued GROUP BY metric",
    "abs_min": "SELECT metric, quantile75 AS abs_min FROM (SELECT metric, percentile_cont(0.75) WITHIN GROUP (ORDER BY abs(delta)) AS quantile75 FROM step WHERE verdict = 'ok' GROUP BY metric) a",
    "move": """
SELECT s.subject, s.metric, s.before_slot, s.slot, s.period_key, s.n_docs, s.before, s.value, s.delta, s.tolerance,
       CASE WHEN s.before = 0 OR s.before * s.value < 0 OR abs(s.before) < f.floor_value THEN NULL ELSE round(s.delta / abs(s.before) * 100, 6) END AS delta_pct, a.abs_min
FROM step s JOIN floor_of f ON s.metric = f.metric JOIN abs_min a ON s.metric = a.metric WHERE s.verdict = 'ok'""",
    "fired": """
SELECT *, CASE WHEN delta > 0 THEN 'increase' ELSE 'decrease' END AS direction,
       CASE WHEN abs(delta_pct) >= 65 AND abs(delta) >= abs_min THEN 'pct,abs' WHEN abs(delta_pct) >= 65 THEN 'pct' ELSE 'abs' END AS fired_on
FROM move WHERE abs(delta_pct) >= 65 OR abs(delta) >= abs_min""",
    "run": """
SELECT *, sum(CASE WHEN verdict = 'ok' THEN 0 ELSE 1 END) OVER (PARTITION BY subject, metric ORDER BY slot ROWS UNBOUNDED PRECEDING) AS run FROM step""",
    "run_delta": """
SELECT *, lag(delta, 1) OVER w AS d1, lag(delta, 2) OVER w AS d2, stddev_pop(delta) OVER (PARTITION BY subject, metric) AS sigma,
       count(*) OVER (PARTITION BY subject, metric) AS population
FROM run WHERE verdict = 'ok' WINDOW w AS (PARTITION BY subject, metric, run ORDER BY slot)""",
    "spread": """
SELECT subject, metric, count(*) AS n, avg(delta) AS mean_delta, stddev_pop(delta) AS sigma, percentile_cont(0.9) WITHIN GROUP (ORDER BY abs(delta)) AS p90
FROM step WHERE verdict = 'ok' GROUP BY subject, metric""",
    # candidates of all detectors; first_slot to slot are their anchors, own_z is a divergence's
    "candidate": """
SELECT 'metric_move:' || subject || ':' || CAST(slot AS STRING) AS candidate_id, 'metric_move' AS detector, subject, metric, metric AS other_metric, before_slot AS first_slot, slot, direction, delta,
       CAST(NULL AS DOUBLE) AS own_z, CASE WHEN before * value < 0 THEN 1 ELSE 0 END AS n_own_warnings FROM fired
UNION ALL SELECT 'trend_reversal:' || subject || ':' || CAST(slot AS STRING), 'trend_reversal', subject, metric, metric, slot - 3, slot, direction, delta, NULL, CASE WHEN before * value < 0 THEN 1 ELSE 0 END FROM reversal
UNION ALL SELECT 'acceleration:' || subject || ':' || CAST(slot AS STRING), 'acceleration', subject, metric, metric, slot - 3, slot, CASE WHEN delta > 0 THEN 'increase' ELSE 'decrease' END, delta, NULL, 0 FROM accelerated
UNION ALL SELECT 'cross_metric_divergence:' || subject || ':' || left_metric || ':' || right_metric || ':' || CAST(slot AS STRING), 'cross_metric_divergence', subject, left_metric, right_metric, slot, slot,
       CASE WHEN z > 0 THEN 'increase' ELSE 'decrease' END, NULL, z, CASE WHEN n_excluded + n_unresolved > 0 THEN 1 ELSE 0 END FROM divergence""",
    "anchored": """
SELECT c.*, p.metric AS anchor_metric, p.period_key, p.n_docs, p.status, p.first_negative
FROM candidate c JOIN (SELECT *, min(CASE WHEN status <> 'conflict' AND value < 0 THEN slot END) OVER (PARTITION BY subject, metric) AS first_negative FROM any_point) p
ON p.subject = c.subject AND (p.metric = c.metric OR p.metric = c.other_metric) AND p.slot >= c.first_slot AND p.slot <= c.slot""",
    # what stands behind a candidate: its weakest anchor, and a warning where an anchor overruled a minority of readings
    "backed": """
SELECT candidate_id, detector, subject, metric, other_metric, slot, direction, delta, own_z, min(n_docs) AS n_docs, n_own_warnings + max(CASE WHEN status = 'resolved_by_majority' THEN 1 ELSE 0 END) AS n_warnings,
       max(CASE WHEN first_negative = slot THEN 0.5 ELSE 0 END) AS bonus
FROM anchored GROUP BY candidate_id, detector, subject, metric, other_metric, slot, direction, delta, own_z, n_own_warnings""",
    # items of accepted posts ('metric:subject:metric', 'period:key', 'type:detector'); nothing has been accepted yet
    "accepted_item": "SELECT * FROM (VALUES ('', '')) AS a(post, item) WHERE post <> ''",
    "accepted": "SELECT post, item, count(*) OVER (PARTITION BY post) AS n FROM accepted_item",
    "described": """
SELECT candidate_id, item, count(*) OVER (PARTITION BY candidate_id) AS n FROM (
SELECT DISTINCT candidate_id, CASE k WHEN 0 THEN 'type:' || detector WHEN 1 THEN 'metric:' || subject || ':' || anchor_metric ELSE 'period:' || period_key END AS item FROM anchored CROSS JOIN (VALUES (0), (1), (2)) AS d(k)) i""",
    "repeated": """
SELECT candidate_id, max(cosine) AS repetition FROM (SELECT d.candidate_id, a.post, count(*) / sqrt(max(d.n) * max(a.n)) AS cosine
FROM described d JOIN accepted a ON d.item = a.item GROUP BY d.candidate_id, a.post) o GROUP BY candidate_id""",
    # terms of the score; a z needs eight steps and a spread, units need four steps
    "term": """
SELECT b.*, coalesce(r.repetition, 0) AS repetition, CASE WHEN b.own_z IS NOT NULL THEN abs(b.own_z) WHEN s.n >= 8 AND s.sigma > 0 THEN abs(b.delta - s.mean_delta) / s.sigma END AS z,
       CASE WHEN s.n >= 4 AND s.p90 > 0 THEN abs(b.delta) / s.p90 END AS units, row_number() OVER (PARTITION BY b.detector, b.subject, b.metric, b.other_metric ORDER BY b.slot) - 1 AS n_prior
FROM backed b LEFT JOIN spread s ON b.subject = s.subject AND b.metric = s.metric LEFT JOIN repeated r ON b.candidate_id = r.candidate_id""",
    "scored": """
SELECT candidate_id, detector, subject, slot, direction, n_docs, n_warnings, round(repetition, 6) AS repetition, round(z, 6) AS z, round(units, 6) AS units,
       round(0.40 * least(1, coalesce(z, 0) / 4) + 0.20 * least(1, coalesce(units, 0)) + 0.15 * least(1, n_docs / 5.0) + 0.10 * least(1, CAST(1 AS DOUBLE) / (1 + n_prior) + bonus)
             + 0.10 * greatest(0, least(1, 1 - (8006 - slot) / 32.0)) - 0.15 * least(4, n_warnings) - CASE WHEN n_docs = 1 THEN 0.20 ELSE 0 END - 0.25 * least(1, repetition), 6) AS score FROM term""",
    # sets of parts: a row per nation and part that its customers ordered, with the size of the nation's set
    "segment_part": """
SELECT c, p, count(*) OVER (PARTITION BY c) AS n FROM (SELECT DISTINCT c_nationkey AS c, l_partkey AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey) x""",
    "reversal": """
SELECT r.subject, r.metric, r.slot, r.delta, r.d1, r.d2, f.direction, f.before, f.value FROM run_delta r JOIN fired f ON r.subject = f.subject AND r.metric = f.metric AND r.slot = f.slot
WHERE r.population >= 8 AND r.sigma >= r.tolerance AND r.d1 <> 0 AND r.d2 <> 0 AND r.delta <> 0 AND r.d1 * r.d2 > 0 AND r.delta * r.d1 < 0 AND round(abs(r.delta) - r.sigma, 6) >= 0""",
    "accelerated": "SELECT subject, metric, slot, delta, d1, d2 FROM run_delta WHERE d2 * d1 > 0 AND d1 * delta > 0 AND abs(d1) > abs(d2) AND abs(delta) > abs(d1) AND round(abs(delta) - 1.5 * abs(d2), 9) >= 0",
    # declared pairs of metrics whose levels may be compared: signs by which they are stored, and how one relates to the other
    "metric_pair": """
SELECT * FROM (VALUES ('gross_revenue', 'revenue', 'positive', 'positive', 'component')) AS p(left_metric, right_metric, left_sign, right_sign, relation)""",
    "any_point": "SELECT * FROM point UNION ALL SELECT * FROM gross_point",
    # with the metric's formula at the last day of the slot: of versions that overlap, the one that began last
    "leveled": """
SELECT p.subject, p.metric, p.slot, p.status, p.value, p.tolerance, CAST(coalesce(max(f.valid_from), DATE '0001-01-01') AS STRING) AS formula FROM any_point p LEFT JOIN formula f ON f.metric = p.metric
AND last_day(make_date(CAST(floor(p.slot / 4) AS INT), CAST(p.slot % 4 * 3 + 3 AS INT), 1)) BETWEEN f.valid_from AND coalesce(f.valid_to, DATE '9999-12-31')
GROUP BY p.subject, p.metric, p.slot, p.status, p.value, p.tolerance""",
    # slots that both metrics of a pair have; a conflict on either side leaves the slot unresolved, without a gap
    "paired": """
SELECT *, sum(CASE WHEN unresolved THEN 1 ELSE 0 END) OVER w AS n_unresolved, sum(CASE WHEN unresolved THEN 0 ELSE 1 END) OVER w AS n_gaps FROM (
SELECT l.subject, m.left_metric, m.right_metric, m.relation, l.slot, l.status = 'conflict' OR r.status = 'conflict' AS unresolved,
       round(l.value - r.value, 9) AS gap, greatest(l.tolerance, r.tolerance) AS tolerance, l.formula || ' ' || r.formula AS formulas
FROM metric_pair m JOIN leveled l ON l.metric = m.left_metric JOIN leveled r ON r.metric = m.right_metric AND r.subject = l.subject AND r.slot = l.slot
WHERE m.left_sign = m.right_sign AND m.relation IS NOT NULL) p WINDOW w AS (PARTITION BY subject, left_metric, right_metric)""",
    # each gap against those of its own formulas, with the spread that is left without it
    "gap_population": """
SELECT *, n_gaps - n AS n_excluded, CASE WHEN n > 1 THEN sqrt(greatest(0, (n * sigma * sigma - (gap - mean_gap) * (gap - mean_gap) * n / (n - 1)) / (n - 1))) ELSE 0 END AS sigma_without FROM (
SELECT subject, left_metric, right_metric, relation, slot, gap, n_unresolved, n_gaps, count(*) OVER w AS n, avg(gap) OVER w AS mean_gap, stddev_pop(gap) OVER w AS sigma, 2 * max(tolerance) OVER w AS floor_value
FROM paired WHERE NOT unresolved WINDOW w AS (PARTITION BY subject, left_metric, right_metric, formulas)) g""",
    "divergence": """
SELECT *, (gap - mean_gap) / sigma AS z FROM gap_population WHERE n >= 8 AND sigma > 0 AND sigma >= floor_value AND sigma_without >= floor_value AND abs(gap - mean_gap) / sigma >= 1.5""",
    # a property graph over the tables
    "node": """
SELECT 'Region' AS label, 'r:' || CAST(r_regionkey AS STRING) AS key, r_name AS name FROM region
UNION ALL SELECT 'Nation', 'n:' || CAST(n_nationkey AS STRING), n_name FROM nation
UNION ALL SELECT 'Customer', 'c:' || CAST(c_custkey AS STRING), c_name FROM customer
UNION ALL SELECT 'Supplier', 's:' || CAST(s_suppkey AS STRING), s_name FROM supplier
UNION ALL SELECT 'Part', 'p:' || CAST(p_partkey AS STRING), p_name FROM part
UNION ALL SELECT 'Order', 'o:' || CAST(o_orderkey AS STRING), o_orderstatus FROM orders""",
    "edge": """
SELECT 'PART_OF' AS type, 'n:' || CAST(n_nationkey AS STRING) AS src, 'r:' || CAST(n_regionkey AS STRING) AS dst FROM nation
UNION ALL SELECT 'LOCATED_IN', 'c:' || CAST(c_custkey AS STRING), 'n:' || CAST(c_nationkey AS STRING) FROM customer
UNION ALL SELECT 'LOCATED_IN', 's:' || CAST(s_suppkey AS STRING), 'n:' || CAST(s_nationkey AS STRING) FROM supplier
UNION ALL SELECT 'PLACED', 'c:' || CAST(o_custkey AS STRING), 'o:' || CAST(o_orderkey AS STRING) FROM orders
UNION ALL SELECT DISTINCT 'CONTAINS', 'o:' || CAST(l_orderkey AS STRING), 'p:' || CAST(l_partkey AS STRING) FROM lineitem""",
    "formula": """
SELECT * FROM (VALUES ('revenue', 1, DATE '1990-01-01', DATE '1997-12-31'), ('revenue', 2, DATE '1998-01-01', CAST(NULL AS DATE)), ('revenue', 3, DATE '2000-06-01', DATE '2000-12-31'))
  AS f(metric, version, valid_from, valid_to)""",
}


#: The parts from readings to canonical points, once more for a second metric: list prices before discounts.
_SERIES = ("revenue", "observation", "toleranced", "linked", "clustered", "cluster_size", "ranked_cluster", "point")
PARTS |= {f"gross_{name}": re.sub(rf"\b(FROM|JOIN) ({'|'.join(_SERIES)})\b", r"\1 gross_\2", PARTS[name]).replace("'revenue'", "'gross_revenue'").replace(" * (1 - l.l_discount)", "") for name in _SERIES}


def metric_history(since: int | None = None, until: int | None = None) -> str:
    """Points from slot `since` to slot `until`, both included; None is no bound."""
    bounds = [f"slot {sign} {slot:d}" for sign, slot in ((">=", since), ("<=", until)) if slot is not None]
    return "SELECT subject, period_key, slot, value, status FROM point" + (f" WHERE {' AND '.join(bounds)}" if bounds else "")


QUERIES: dict[str, str] = {
    # C, Q03: series and canonical points
    "metric_history": metric_history(),
    "value_clusters": "SELECT subject, period_key, CAST(cluster AS BIGINT) AS cluster, n, n_docs, low, high FROM cluster_size",
    "canonical_points": "SELECT subject, period_key, status, n_docs, value, observation_id FROM point",
    "slot_census": "SELECT status, count(*) AS n_slots, count(DISTINCT subject) AS n_subjects, sum(CASE WHEN n_docs > 1 THEN 1 ELSE 0 END) AS n_backed FROM point GROUP BY status",
    "comparability_census": "SELECT verdict, count(*) AS n FROM step GROUP BY verdict",
    "same_reading": """SELECT a.observation_id AS a, b.observation_id AS b FROM toleranced a JOIN toleranced b ON a.subject = b.subject AND a.metric = b.metric AND a.slot = b.slot
AND a.observation_id < b.observation_id AND round(abs(a.value - b.value), 9) <= greatest(a.tolerance, b.tolerance)""",
    # D: detectors
    "metric_move": "SELECT subject || ':' || CAST(slot AS STRING) AS candidate_id, subject, metric, before_slot, slot, period_key, delta, delta_pct, fired_on, direction FROM fired",
    "trend_reversal": "SELECT subject, metric, slot, delta, d1, d2 FROM reversal",
    "acceleration": "SELECT subject, metric, slot, delta, d1, d2 FROM accelerated",
    "cross_metric_divergence": """SELECT subject, left_metric, right_metric, relation, slot, round(gap, 4) AS gap, round(z, 4) AS z, CAST(n AS BIGINT) AS n_population, CAST(n_excluded AS BIGINT) AS n_excluded,
CAST(n_unresolved AS BIGINT) AS n_unresolved FROM divergence""",
    # R: history, scores, ranks
    "delta_distribution": "SELECT subject, metric, n, round(mean_delta, 2) AS mean_delta, round(sigma, 2) AS sigma, round(p90, 2) AS p90 FROM spread",
    "candidate_scores": "SELECT candidate_id, detector, subject, slot, direction, z, units, n_docs, n_warnings, repetition, score FROM scored",
    "ranked_candidates": """SELECT candidate_id, detector, subject, slot, score, row_number() OVER (ORDER BY score DESC, candidate_id) AS place, dense_rank() OVER (ORDER BY top DESC, subject) AS cluster_rank
FROM (SELECT *, max(score) OVER (PARTITION BY subject) AS top FROM scored) t""",
    "repetition_cosine": """SELECT a.c AS left_segment, b.c AS right_segment, round(count(*) / sqrt(max(a.n) * max(b.n)), 6) AS cosine
FROM segment_part a JOIN segment_part b ON a.p = b.p AND a.c < b.c GROUP BY a.c, b.c""",
    # O: vocabulary
    # G, Q: graph
    "graph_nodes": "SELECT label, count(*) AS n, count(DISTINCT key) AS n_keys, count(name) AS n_named FROM node GROUP BY label",
    "graph_edges": "SELECT type, count(*) AS n, count(DISTINCT src) AS n_src, count(DISTINCT dst) AS n_dst FROM edge GROUP BY type",
    "degree": "SELECT n.label, count(*) AS n, sum(coalesce(d.degree, 0)) AS ends, max(coalesce(d.degree, 0)) AS most FROM node n LEFT JOIN (SELECT key, count(*) AS degree FROM (SELECT src AS key FROM edge UNION ALL SELECT dst FROM edge) e GROUP BY key) d ON n.key = d.key GROUP BY n.label",
    "unevidenced_facts": "SELECT o.o_orderkey FROM orders o LEFT ANTI JOIN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') l ON o.o_orderkey = l.l_orderkey",
    "endpoint_shape": "SELECT e.type, s.label AS src_label, d.label AS dst_label, count(*) AS n FROM edge e JOIN node s ON e.src = s.key JOIN node d ON e.dst = d.key GROUP BY e.type, s.label, d.label",
    "fact_evidence": "SELECT l.l_orderkey, l.l_linenumber, o.o_orderpriority, c.c_name, n.n_name, r.r_name FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey",
    "compare_periods": "SELECT period_key, count(*) AS n, count(DISTINCT subject) AS n_subjects, count(DISTINCT document) AS n_documents, count(DISTINCT scale) AS n_scales, sum(CASE WHEN scale = 'millions' THEN 1 ELSE 0 END) AS n_millions, min(value) AS low, max(value) AS high FROM observation GROUP BY period_key",
    "neighbour_context": "SELECT a.conv_id, a.turn, b.turn - a.turn AS away, b.role, length(b.text) AS n_chars FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1 WHERE a.role = 'assistant'",
    "previous_passage": "SELECT a.conv_id, a.turn, b.turn AS previous_turn FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1",
    "overview_topn": "SELECT o_custkey, o_orderkey, o_totalprice, r FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) t WHERE r <= 3",
    "coverage_lattice": "SELECT n.n_name, p.y, p.q, coalesce(sum(r.n_orders), 0) AS n_orders FROM nation n CROSS JOIN (SELECT DISTINCT y, q FROM revenue) p LEFT JOIN revenue r ON r.subject = n.n_name AND r.y = p.y AND r.q = p.q GROUP BY n.n_name, p.y, p.q",
    "evidence_backbone": "SELECT n.n_name, p.p_brand, count(*) AS citations, count(DISTINCT l.l_orderkey) AS n_orders FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name, p.p_brand",
    "events_in_window": "SELECT event_type, CASE WHEN ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-15 00:00:00' THEN 'inside' ELSE 'value' END AS matched, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-15 00:00:00' OR value >= 95 GROUP BY 1, 2",
    "same_fact_two_sources": "SELECT subject, period_key, count(DISTINCT document) AS n_documents, count(DISTINCT value) AS n_values FROM observation GROUP BY subject, period_key HAVING count(DISTINCT document) > 2",
    "counter_evidence_scope": "SELECT c.c_custkey, coalesce(o.n, 0) AS n_orders, coalesce(o.late, 0) AS n_open FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS late FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey",
    "conflicting_duplicates": "SELECT subject, period_key, min(value) AS low, max(value) AS high FROM observation WHERE scale = 'thousands' GROUP BY subject, period_key HAVING min(value) <> max(value)",
    "provenance_inventory": "SELECT source, count(*) AS n, count(lang) AS n_lang, count(DISTINCT lang) AS n_langs, count(*) - count(text) AS n_missing FROM documents GROUP BY source",
    # J: agreement between catalogs
    "claim_agreement": "SELECT l.l_orderkey, l.l_linenumber FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_shipdate < o.o_orderdate OR l.l_quantity <= 0 OR l.l_discount NOT BETWEEN 0 AND 1 OR l.l_tax > 0.07",
    "payload_ids": "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'no document' ELSE 'no label' END AS missing FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL",
    # F, T, X: selection, text and numbers
    "change_arithmetic": "SELECT subject, slot, delta, CASE WHEN before = 0 OR before * value < 0 THEN NULL ELSE round((value - before) / abs(before) * 100, 6) END AS pct FROM step WHERE before IS NOT NULL",
    # P, V, A: packages, derivations, reports
    "derived_facts": "SELECT a.subject, a.slot AS earlier, b.slot AS later, round(b.value - a.value, 9) AS change, CASE WHEN b.value > a.value THEN 'up' WHEN b.value < a.value THEN 'down' ELSE 'flat' END AS direction FROM valued a JOIN valued b ON a.subject = b.subject AND a.metric = b.metric AND b.slot = a.slot + 4",
    "forms_by_year_pivot": "SELECT coalesce(o_orderpriority, 'all') AS priority, CAST(coalesce(year(o_orderdate), 0) AS INT) AS y, count(*) AS n FROM orders GROUP BY CUBE (o_orderpriority, year(o_orderdate))",
    "kind_sizes": "SELECT lang, count(*) AS n, sum(n_chars) AS total, max(n_chars) AS largest, round(avg(n_chars), 4) AS mean_chars FROM documents GROUP BY lang",
    "run_report": "SELECT source, lang, count(*) AS n, sum(CASE WHEN text LIKE '%|%' THEN 1 ELSE 0 END) AS n_tables FROM documents GROUP BY source, lang",
    "review_sample": "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) s WHERE r <= 5",
}


def compose(sql: str) -> str:
    """The query with the parts it needs in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in PARTS:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN) {name}\b", text):
                visit(PARTS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    return (f"WITH {', '.join(f'{name} AS ({PARTS[name].strip()})' for name in needed)} " if needed else "") + sql
