"""Queries over packages of evidence and drafts made from the tables.

A package is a customer; its facts are the customer's orders, its passages the orders' lines, a draft is one
sentence about two of its orders, wrong in a stated way for some.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import package
from ..sources.tables import read


def _pick(c: Column, *v: object) -> Column:
    return F.element_at(F.array(*map(F.lit, v)), (c + 1).cast("int"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """package, fact_id, metric_id, period, value, unit of the orders."""
    rows = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 3
    return rows.select(
        F.col("o_custkey").alias("package"), F.col("o_orderkey").alias("fact_id"), _pick(k, "net", "gross", "rate").alias("metric_id"), (F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).alias("period"),
        (F.floor("o_totalprice").cast("long") * F.when(F.col("o_orderkey") % 5 == 0, -1).otherwise(1)).alias("value"), F.when(k == 2, "percent").otherwise("USD").alias("unit"), "o_orderpriority",
    )


def packaged_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package's facts by slots in turn, twelve at most."""
    rows = package.round_robin(facts(spark, sf_dir), ["package"], ["metric_id", "period"], [F.desc("period"), F.col("metric_id"), F.col("fact_id")], 12)
    return rows.select("package", "fact_id", "metric_id", "period", F.col("place").cast("long").alias("place"))


def concordant_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of one slot and size told as one fact, with those that bear it out."""
    rows = facts(spark, sf_dir).withColumn("size", F.floor(F.abs("value") / 100000))
    one = rows.groupBy("package", "metric_id", "period", "size").agg(F.min("fact_id").alias("fact_id"), F.sort_array(F.collect_list("fact_id")).alias("ids"))
    return one.select("package", "fact_id", F.array_join(F.array_except("ids", F.array("fact_id")), ",").alias("corroborating"))


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "supplier").withColumn("ordinal", F.explode(F.sequence(F.lit(0), F.lit(19))))
    return docs.select(F.concat("s_suppkey", F.lit("#"), "ordinal").alias("passage_id"), F.col("s_suppkey").alias("document_id"), "ordinal")


def package_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary passages of a package and their neighbours."""
    lines = read(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    primary = lines.join(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("package"), F.col("l_suppkey").alias("document_id"), (F.col("l_partkey") % 20).cast("int").alias("ordinal"))
    return package.neighbours(primary, _passages(spark, sf_dir), 1)


_SECTIONS = [("1-URGENT", 4, 4, 1), ("2-HIGH", 6, 3, 0), ("3-MEDIUM", 3, 1, 0), ("4-NOT SPECIFIED", 3, 2, 0), ("5-LOW", 20, 0, 0)]


def section_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a package's sections up to their caps, and the ledger of what was there, carried and dropped."""
    rows = facts(spark, sf_dir).withColumnRenamed("o_orderpriority", "section")
    caps = spark.createDataFrame([(s, c) for s, c, _, _ in _SECTIONS], "section string, cap int")
    held = package.sections_cut(rows, caps, [F.desc("value"), F.col("fact_id")]).groupBy("package", "section").agg(F.count(F.lit(1)).alias("carried"), F.max("fact_id").alias("last"))
    there = rows.groupBy("package", "section").agg(F.count(F.lit(1)).alias("available"))
    return there.join(held, ["package", "section"], "left").select("package", "section", "available", F.coalesce("carried", F.lit(0)).alias("carried"), (F.col("available") - F.coalesce("carried", F.lit(0))).alias("dropped"), "last")


def budget_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows dropped one at a time, by section, until a package fits; protected rows and floors stay."""
    rows = facts(spark, sf_dir).select("package", F.col("o_orderpriority").alias("section"), F.col("fact_id").alias("row_id"), F.floor(F.abs("value") / 1000).cast("long").alias("tokens"), (F.col("fact_id") % 7 == 0).alias("protected"), F.col("period").alias("rank"))
    sections = spark.createDataFrame([(s, t, f) for s, _, t, f in _SECTIONS], "section string, turn int, least int")
    return package.trimmed(rows, sections, 500).select("package", "row_id", "dropped", "fits")


def derivation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations offered on a package's facts, executed."""
    near = F.abs(F.col("a.period") - F.col("b.period")) > 2
    rows = package.offers(facts(spark, sf_dir).where("fact_id % 4 <> 0"), "package", near)
    value = package.computed(F.col("op"), F.col("a.value").cast("double"), F.col("b.value").cast("double"))
    return rows.select("package", F.col("a.fact_id").alias("from_fact"), F.col("b.fact_id").alias("to_fact"), "op", value.alias("result"))


def derivation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded results against those recomputed, some recorded wrong."""
    rows = package.offers(facts(spark, sf_dir).where("fact_id % 4 <> 0"), "package", F.abs(F.col("a.period") - F.col("b.period")) > 2)
    value = package.computed(F.col("op"), F.col("a.value").cast("double"), F.col("b.value").cast("double"))
    said = value + F.when(F.col("a.fact_id") % 6 == 1, 1.0).otherwise(0.0)
    agrees = F.round(F.abs(said - value), numbers.PLACES) == 0
    return rows.groupBy("op", F.when(agrees, "ok").otherwise("RESULT_NOT_RECOMPUTED").alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def absent_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a package has no evidence of: no fact below zero, no rate, no urgent order."""
    rows = facts(spark, sf_dir).groupBy("package").agg(F.max(F.col("value") < 0).alias("low"), F.max(F.col("metric_id") == "rate").alias("rate"), F.max(F.col("o_orderpriority").startswith("1")).alias("urgent"))
    none = F.array_compact(F.array(F.when(~F.col("low"), "no_negative"), F.when(~F.col("rate"), "no_rate"), F.when(~F.col("urgent"), "no_urgent")))
    return rows.select("package", F.explode(none).alias("absent"))


def _handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = package.round_robin(facts(spark, sf_dir), ["package"], ["metric_id", "period"], [F.desc("period"), F.col("metric_id"), F.col("fact_id")], 12)
    return rows.select("package", F.concat(F.lit("{F"), "place", F.lit("}")).alias("handle"), "fact_id", "value", F.concat(F.when(F.col("value") < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs("value"), 0)).alias("printed"))


def slot_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates with the handles of a package's facts, filled; handles that nobody has stay."""
    known = _handles(spark, sf_dir).groupBy("package").agg(F.map_from_entries(F.collect_list(F.struct("handle", "printed"))).alias("values"))
    return known.select("package", package.filled(F.lit("From {F1} to {F2}, with {F99} and {braces}."), F.col("values")).alias("text"))


def literal_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals of a text recovered as the slots of facts, where they stand once and by themselves."""
    rows = _handles(spark, sf_dir).where("handle IN ('{F1}', '{F2}', '{F3}')")
    texts = rows.groupBy("package").agg(F.concat_ws(" ", F.lit("It was"), F.max(F.when(F.col("handle") == "{F1}", F.col("printed"))), F.lit("then"), F.max(F.when(F.col("handle") == "{F2}", F.col("printed"))), F.lit("of x"), F.max(F.when(F.col("handle") == "{F3}", F.col("printed"))), F.lit("and 1,999.5 more.")).alias("text"))
    asked = rows.join(texts, "package").select(F.col("package").alias("id"), "text", "handle", F.col("printed").alias("literal"))
    return package.anchors(asked).select(F.col("id").alias("package"), "handle", F.col("end").cast("long").alias("end"))


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """draft_id, sentence, fact value, cited passage of the orders: sentences that are right, misstate, hedge, forecast or cite nothing."""
    rows = read(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey") % 8).withColumn("v", F.floor("o_totalprice").cast("long"))
    said = F.when(F.col("k") == 1, F.col("v") * 2 + 10).when(F.col("k") == 2, F.round(F.col("v") / 1000) * 1000).otherwise(F.col("v")).cast("long")
    number = F.concat(F.lit("$"), F.format_number(said, 0))
    sentence = F.when(F.col("k") == 3, F.concat(F.lit("Sales reached "), number, F.lit(" because prices rose."))).when(F.col("k") == 4, F.concat(F.lit("Sales of "), number, F.lit(" will grow."))).when(F.col("k") == 5, F.concat(F.lit("Sales were a record "), number, F.lit(".")))
    sentence = sentence.when(F.col("k") == 6, "Sales rose by 5% this year.").otherwise(F.concat(F.lit("Sales were about "), number, F.lit(".")))
    return rows.select(F.col("o_orderkey").alias("draft_id"), sentence.alias("sentence"), F.col("v").cast("double").alias("fact"), F.when(F.col("k") != 7, F.concat(F.lit("p"), "o_custkey")).alias("cited"), "o_custkey")


# Codes of findings with their severity.
SEVERITIES = [("NUMBER_NOT_THE_FACT", "refuse"), ("CAUSAL_CLAIM", "refuse"), ("FORWARD_LOOKING", "refuse"), ("UNSUPPORTED_SUPERLATIVE", "warn"), ("AMBIGUOUS_PERCENT", "refuse"), ("CITATION_MISSING", "refuse"), ("HEDGED", "annotate"), ("UNSTATED_NUMBER", "warn")]


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drafts(spark, sf_dir).withColumn("numerals", numbers.numerals(F.col("sentence")))
    money = F.filter("numerals", lambda t: t["unit"] == "USD")
    wrong = F.exists(money, lambda t: ~numbers.agrees(t["value"], F.col("fact"), t["figures"], F.lit(False)))
    found = F.array_compact(F.array(
        F.when(wrong, "NUMBER_NOT_THE_FACT"), F.when(F.col("sentence").rlike(r"(?i)\b(because|due to|driven by|caused by|as a result of)\b"), "CAUSAL_CLAIM"), F.when(F.col("sentence").rlike(r"(?i)\b(will|expects?|forecasts?|going to)\b"), "FORWARD_LOOKING"),
        F.when(F.col("sentence").rlike(r"(?i)\b(record|highest|lowest|largest|best|worst)\b"), "UNSUPPORTED_SUPERLATIVE"), F.when(numbers.ambiguous_percent_change(F.col("sentence")), "AMBIGUOUS_PERCENT"), F.when(F.col("cited").isNull(), "CITATION_MISSING"),
        F.when(F.col("sentence").rlike(r"(?i)\b(about|approximately|roughly|around|nearly)\s+\$?\d"), "HEDGED"), F.when(F.size(money) == 0, "UNSTATED_NUMBER"),
    ))
    return rows.select("draft_id", F.explode(found).alias("code"))


def draft_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the checks find in drafts."""
    return _findings(spark, sf_dir)


def draft_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draft's verdict by the severities of its findings."""
    return package.verdicts(drafts(spark, sf_dir), _findings(spark, sf_dir), spark.createDataFrame(SEVERITIES, "code string, severity string"))


def repair_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one step that can repair a refused draft, or none."""
    owners = spark.createDataFrame([("NUMBER_NOT_THE_FACT", "writer"), ("CAUSAL_CLAIM", "writer"), ("FORWARD_LOOKING", "planner"), ("AMBIGUOUS_PERCENT", "writer"), ("CITATION_MISSING", "compiler")], "code string, owner string")
    rows = _findings(spark, sf_dir).join(spark.createDataFrame(SEVERITIES, "code string, severity string").where("severity = 'refuse'"), "code").join(owners, "code", "left")
    one = rows.groupBy("draft_id").agg(F.collect_set("owner").alias("o"), F.max(F.col("owner").isNull()).alias("nobody"))
    owner = F.when(~F.col("nobody") & (F.size("o") == 1), F.col("o")[0]).otherwise("none")
    return one.groupBy(owner.alias("owner")).agg(F.count(F.lit(1)).alias("n"))


def uncovered_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numerals of a sentence that no bound span contains."""
    rows = drafts(spark, sf_dir)
    at = F.regexp_instr("sentence", F.lit(r"\d[\d,]*")) - 1
    numerals = rows.select(F.col("draft_id").alias("id"), at.alias("start"), (at + F.length(F.regexp_extract("sentence", r"\d[\d,]*", 0))).alias("end")).where("start >= 0")
    spans = rows.where("draft_id % 3 <> 0").select(F.col("draft_id").alias("id"), (F.instr("sentence", "$") - 1).alias("start"), F.length("sentence").alias("end")).where("start >= 0")
    return package.uncovered(numerals, spans).select(F.col("id").alias("draft_id"))


def gold_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected readings matched by metric and period, verdicts by dimension, recall."""
    gold = facts(spark, sf_dir).groupBy("package", "metric_id", "period").agg(F.max("value").alias("value"), F.max("unit").alias("unit"))
    said = facts(spark, sf_dir).where("fact_id % 6 <> 0").groupBy("package", "metric_id", "period").agg(F.max(F.col("value") + F.when(F.col("fact_id") % 10 == 1, 5).otherwise(0)).alias("said"), F.max(F.when(F.col("fact_id") % 8 == 3, "EUR").otherwise(F.col("unit"))).alias("said_unit"))
    rows = gold.join(said, ["package", "metric_id", "period"], "left")
    hit = F.col("said").isNotNull()
    return rows.groupBy("metric_id").agg(
        F.count(F.lit(1)).alias("n_gold"), F.count_if(hit).alias("n_found"), F.count_if(hit & (F.col("said") == F.col("value"))).alias("n_value"), F.count_if(hit & (F.col("said_unit") == F.col("unit"))).alias("n_unit"), F.round(F.avg(hit.cast("int")), 6).alias("recall"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        packaged_facts, concordant_readings, package_passages, section_rows, budget_trim, derivation_pairs, derivation_checks, absent_evidence, slot_drafts, literal_anchors, draft_findings, draft_verdicts, repair_owners, uncovered_numerals, gold_matches,
    )
}

_F = "f AS (SELECT o_custkey AS package, o_orderkey AS fact_id, ['net', 'gross', 'rate'][o_orderkey % 3 + 1] AS metric_id, (year(o_orderdate) * 4 + quarter(o_orderdate))::INTEGER AS period, floor(o_totalprice)::BIGINT * CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE 1 END AS value, CASE WHEN o_orderkey % 3 = 2 THEN 'percent' ELSE 'USD' END AS unit, o_orderpriority AS section FROM orders)"
_RR = """g AS (SELECT *, row_number() OVER (PARTITION BY package, metric_id, period ORDER BY fact_id) AS depth FROM f), rr AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY depth, period DESC, metric_id, fact_id) AS place FROM g),
hn AS (SELECT package, '{F' || place || '}' AS handle, fact_id, value, CASE WHEN value < 0 THEN '-$' ELSE '$' END || format('{:,}', abs(value)) AS printed FROM rr WHERE place <= 12)"""
_OFF = """p AS (SELECT a.package, a.fact_id AS x, b.fact_id AS y, a.value::DOUBLE AS v, b.value::DOUBLE AS w, a.metric_id = b.metric_id AND a.period < b.period AS change, a.metric_id < b.metric_id AND a.period = b.period AND a.unit = b.unit AS gap FROM f a JOIN f b ON a.package = b.package AND a.fact_id <> b.fact_id AND abs(a.period - b.period) <= 2
  WHERE a.fact_id % 4 <> 0 AND b.fact_id % 4 <> 0),
o AS (SELECT package, x, y, 'absolute_change' AS op, round(w - v, 9) AS result FROM p WHERE change UNION ALL SELECT package, x, y, 'relative_change', round((w - v) / abs(v) * 100, 6) FROM p WHERE change AND v <> 0 AND (v < 0) = (w < 0) UNION ALL SELECT package, x, y, 'gap', round(v - w, 9) FROM p WHERE gap
  UNION ALL SELECT package, x, y, 'ratio', round(v / w, 6) FROM p WHERE gap AND w <> 0 UNION ALL SELECT package, x, y, 'zero_crossing', round(w - v, 9) FROM p WHERE change AND v * w < 0)"""
_D = "d AS (SELECT o_orderkey AS draft_id, o_orderkey % 8 AS k, floor(o_totalprice)::BIGINT AS v, length(floor(o_totalprice)::BIGINT::VARCHAR) AS digits FROM orders)"
# figures that a number rounded to thousands keeps, without the zeros at its end
_FIND = (
    _D
    + """, r AS (SELECT *, CASE WHEN k = 1 THEN v * 2 + 10 WHEN k = 2 THEN (round(v / 1000) * 1000)::BIGINT ELSE v END AS said FROM d), t AS (SELECT *, greatest(length(rtrim(said::VARCHAR, '0')), 1) AS figures FROM r),
fd AS (SELECT draft_id, 'NUMBER_NOT_THE_FACT' AS code FROM t WHERE k <> 6 AND abs(said - v) > 0.5 * pow(10.0, digits - 1 - figures + 1) UNION ALL SELECT draft_id, 'CAUSAL_CLAIM' FROM t WHERE k = 3 UNION ALL SELECT draft_id, 'FORWARD_LOOKING' FROM t WHERE k = 4 UNION ALL SELECT draft_id, 'UNSUPPORTED_SUPERLATIVE' FROM t WHERE k = 5
UNION ALL SELECT draft_id, unnest(['AMBIGUOUS_PERCENT', 'UNSTATED_NUMBER']) FROM t WHERE k = 6 UNION ALL SELECT draft_id, 'CITATION_MISSING' FROM t WHERE k = 7 UNION ALL SELECT draft_id, 'HEDGED' FROM t WHERE k IN (0, 1, 2, 7))"""
)
_SEV = "sev(code, severity) AS (VALUES " + ", ".join(f"('{c}', '{s}')" for c, s in SEVERITIES) + ")"

ORACLES = {
    "packaged_facts": f"WITH {_F}, {_RR} SELECT package, fact_id, metric_id, period, place FROM rr WHERE place <= 12",
    "concordant_readings": f"WITH {_F}, c AS (SELECT package, metric_id, period, abs(value) // 100000 AS s, min(fact_id) AS m FROM f GROUP BY ALL) SELECT c.package, m AS fact_id, coalesce(string_agg(f.fact_id::VARCHAR, ',' ORDER BY f.fact_id) FILTER (WHERE f.fact_id <> m), '') AS corroborating FROM c JOIN f ON f.package = c.package AND f.metric_id = c.metric_id AND f.period = c.period AND abs(f.value) // 100000 = s GROUP BY c.package, m",
    "package_passages": """WITH p AS (SELECT DISTINCT o_custkey AS package, l_suppkey AS d, l_partkey % 20 AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1)
SELECT package, s_suppkey || '#' || n AS passage_id, CASE WHEN bool_or(n = o) THEN 'primary' ELSE 'context' END AS role FROM supplier CROSS JOIN range(20) r(n) JOIN p ON d = s_suppkey AND abs(n - o) <= 1 GROUP BY package, s_suppkey, n""",
    "section_rows": f"""WITH {_F}, cap(section, cap) AS (VALUES {', '.join(f"('{s}', {c})" for s, c, _, _ in _SECTIONS)}), r AS (SELECT *, row_number() OVER (PARTITION BY package, section ORDER BY value DESC, fact_id) AS r FROM f)
SELECT package, section, count(*) AS available, count(*) FILTER (WHERE r <= cap) AS carried, count(*) FILTER (WHERE r > cap) AS dropped, max(fact_id) FILTER (WHERE r <= cap) AS last FROM r JOIN cap USING (section) GROUP BY package, section""",
    "budget_trim": f"""WITH RECURSIVE {_F}, sec(section, turn, least) AS (VALUES {', '.join(f"('{s}', {t}, {f})" for s, _, t, f in _SECTIONS)}),
x AS (SELECT package, fact_id, abs(value) // 1000 AS tokens, turn, period, fact_id % 7 <> 0 AND row_number() OVER (PARTITION BY package, section ORDER BY period, fact_id) > least AS may FROM f JOIN sec USING (section)),
q AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY may DESC, turn, period DESC, fact_id DESC) AS n FROM x), s AS (SELECT package, sum(tokens) AS total, count(*) FILTER (WHERE may) AS can FROM x GROUP BY package),
w AS (SELECT package, 0::BIGINT AS n, total AS left_, can FROM s UNION ALL SELECT w.package, w.n + 1, left_ - q.tokens, can FROM w JOIN q ON q.package = w.package AND q.n = w.n + 1 WHERE left_ > 500 AND w.n < can), e AS (SELECT package, max(n) AS n, min(left_) AS left_ FROM w GROUP BY package)
SELECT q.package, fact_id AS row_id, q.n <= e.n AS dropped, left_ <= 500 AS fits FROM q JOIN e USING (package)""",
    "derivation_pairs": f"WITH {_F}, {_OFF} SELECT package, x AS from_fact, y AS to_fact, op, result FROM o",
    "derivation_checks": f"WITH {_F}, {_OFF} SELECT op, CASE WHEN x % 6 = 1 THEN 'RESULT_NOT_RECOMPUTED' ELSE 'ok' END AS verdict, count(*) AS n FROM o GROUP BY ALL",
    "absent_evidence": f"WITH {_F} SELECT package, 'no_negative' AS absent FROM f GROUP BY package HAVING min(value) >= 0 UNION ALL SELECT package, 'no_rate' FROM f GROUP BY package HAVING NOT bool_or(metric_id = 'rate') UNION ALL SELECT package, 'no_urgent' FROM f GROUP BY package HAVING NOT bool_or(section LIKE '1%')",
    "slot_drafts": f"WITH {_F}, {_RR} SELECT package, 'From ' || coalesce(max(printed) FILTER (WHERE handle = '{{F1}}'), '{{F1}}') || ' to ' || coalesce(max(printed) FILTER (WHERE handle = '{{F2}}'), '{{F2}}') || ', with {{F99}} and {{braces}}.' AS text FROM hn GROUP BY package",
    "literal_anchors": f"""WITH {_F}, {_RR}, w AS (SELECT package, max(printed) FILTER (WHERE handle = '{{F1}}') AS a, max(printed) FILTER (WHERE handle = '{{F2}}') AS b, max(printed) FILTER (WHERE handle = '{{F3}}') AS c FROM hn GROUP BY package),
t AS (SELECT *, length('It was ' || a) AS ea, length('It was ' || a || ' then ' || b) AS eb, length('It was ' || a || ' then' || coalesce(' ' || b, '') || ' of x ' || c) AS ec FROM w)
SELECT package, '{{F1}}' AS handle, ea AS "end" FROM t WHERE a IS DISTINCT FROM b AND a IS DISTINCT FROM c UNION ALL SELECT package, '{{F2}}', eb FROM t WHERE b IS NOT NULL AND a IS DISTINCT FROM b AND b IS DISTINCT FROM c UNION ALL SELECT package, '{{F3}}', ec FROM t WHERE c IS NOT NULL AND a IS DISTINCT FROM c AND b IS DISTINCT FROM c""",
    "draft_findings": f"WITH {_FIND} SELECT draft_id, code FROM fd",
    "draft_verdicts": f"WITH {_FIND}, {_SEV} SELECT d.draft_id, CASE WHEN bool_or(severity = 'refuse') THEN 'refused' WHEN bool_or(severity = 'warn') THEN 'warned' WHEN bool_or(severity = 'annotate') THEN 'annotated' ELSE 'accepted' END AS verdict, count(fd.code) AS n_findings FROM d LEFT JOIN fd ON fd.draft_id = d.draft_id LEFT JOIN sev ON sev.code = fd.code GROUP BY d.draft_id",
    "repair_owners": f"""WITH {_FIND}, {_SEV}, w AS (SELECT draft_id, CASE code WHEN 'FORWARD_LOOKING' THEN 'planner' WHEN 'CITATION_MISSING' THEN 'compiler' ELSE 'writer' END AS owner FROM fd JOIN sev USING (code) WHERE severity = 'refuse'),
g AS (SELECT draft_id, CASE WHEN count(DISTINCT owner) = 1 THEN min(owner) ELSE 'none' END AS owner FROM w GROUP BY draft_id) SELECT owner, count(*) AS n FROM g GROUP BY owner""",
    "uncovered_numerals": f"WITH {_D} SELECT draft_id FROM d WHERE k = 6 OR draft_id % 3 = 0",
    "gold_matches": f"""WITH {_F}, g AS (SELECT package, metric_id, period, max(value) AS value, max(unit) AS unit FROM f GROUP BY ALL), s AS (SELECT package, metric_id, period, max(value + CASE WHEN fact_id % 10 = 1 THEN 5 ELSE 0 END) AS said, max(CASE WHEN fact_id % 8 = 3 THEN 'EUR' ELSE unit END) AS u FROM f WHERE fact_id % 6 <> 0 GROUP BY ALL)
SELECT metric_id, count(*) AS n_gold, count(said) AS n_found, count(*) FILTER (WHERE said = value) AS n_value, count(*) FILTER (WHERE u = unit) AS n_unit, round(count(said) / count(*), 6) AS recall FROM g LEFT JOIN s USING (package, metric_id, period) GROUP BY metric_id""",
}
