"""Queries over recorded answers, prose surfaces, flattened tables, filters and states, made from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import periods
from ..operators import answers, parse
from ..sources.tables import read
from . import vocabulary
from .built import PAGE


def _pick(c: Column, *v: object) -> Column:
    return F.element_at(F.array(*(x if isinstance(x, Column) else F.lit(x) for x in v)), (c + 1).cast("int"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the orders, the k-th of ten wrong in the k-th way."""
    rows = read(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey") % 11).withColumn("n", F.floor("o_totalprice").cast("long"))
    k, shown = F.col("k"), F.format_number(F.col("n"), 0)
    quarter = F.concat(F.quarter("o_orderdate").cast("string"), F.lit("Q"), F.date_format("o_orderdate", "yy"))
    span = F.when(k == 6, F.concat(F.lit("to "), shown)).otherwise(F.concat(F.lit("Net revenue was $"), shown, F.when(k == 8, " million").otherwise("")))
    passage = F.concat(F.lit("In the quarter. "), span, F.lit(" in "), quarter, F.lit("."))
    said = F.struct(
        F.when(k == 2, "order_count").when(k == 3, "refund_total").otherwise("net_revenue").alias("metric"), F.when(k == 4, "another").otherwise("issuer").alias("subject"), F.when(k == 5, F.concat(F.lit("Revenue came to "), shown)).otherwise(span).alias("span"),
        (F.col("n") + F.when(k == 7, 1).otherwise(0)).cast("double").alias("value"), F.when(k == 8, "thousands").alias("scale"), F.when(k == 9, "last spring").otherwise(quarter).alias("period"),
    )
    answer = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, "not json").otherwise(F.to_json(said))
    return rows.select("o_orderkey", "k", answer.alias("answer"), passage.alias("passage"), F.array(F.lit("net_revenue"), F.lit("refund_total")).alias("scope"), F.lit("issuer").alias("subject"))


def answer_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as claims, or the first reason for which they are refused."""
    rows = answers.mapped(_answers(spark, sf_dir), vocabulary.frame(spark, "metric"))
    return rows.select("o_orderkey", "outcome", "claimed", "period_key")


def lane_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a lane makes of selected passages up to a limit of them each: claims, refusals, deferred metrics and silence."""
    rows = answers.mapped(_answers(spark, sf_dir), vocabulary.frame(spark, "metric"))
    place = F.row_number().over(Window.partitionBy(F.col("k")).orderBy("o_orderkey"))
    rows = rows.withColumn("place", place)
    route = F.when(F.col("place") > 20, "unselected").when(F.col("outcome") == "ok", "claim").when(F.col("outcome") == "NO_ANSWER", "SILENT_NO_FINDING").when(F.col("outcome") == "OTHER_LANE", "deferred").otherwise("rejected")
    return rows.groupBy(route.alias("route")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))


def metric_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surfaces of metrics in sentences, the longest where they overlap, and whether they name one metric."""
    rows = read(spark, sf_dir, "orders")
    said = _pick(F.col("o_orderkey") % 5, "net revenue and open orders rose", "orders placed fell; refunds too", "revenue grew", "preorders and discounts", "the discount rate, net of discount")
    found = answers.longest_surfaces(answers.placed_surfaces(rows.select(F.col("o_orderkey").alias("id"), F.lower(said).alias("text")), _distinct(spark)))
    return found.select(F.col("id").alias("o_orderkey"), "surface", F.col("start").cast("long").alias("start"), (F.size(F.split("metric_id", ",")) == 1).alias("unique"))


def _distinct(spark: SparkSession) -> DataFrame:
    """Each surface once with all its metrics."""
    return vocabulary.frame(spark, "surface").groupBy("surface").agg(F.array_join(F.sort_array(F.collect_set("metric_id")), ",").alias("metric_id"))


def flattened_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell of a pipe table by line and place, with its span."""
    rows = read(spark, sf_dir, "customer")
    name = F.concat(F.lit("C"), F.col("c_custkey").cast("string"))
    body = F.concat(F.lit("| item |  value | \n| "), name, F.lit(" |  "), F.format_number(F.floor(F.abs("c_acctbal")), 0), F.lit("  |\n| end | — |"))
    found = answers.cell_span(body, (F.col("c_custkey") % 4).cast("int"), (F.col("c_custkey") % 3).cast("int"))
    same = F.substring(F.sha2(F.concat_ws("|", name, found["text"]), 256), 1, 12)
    return rows.select("c_custkey", found["text"].alias("cell"), found["start"].cast("long").alias("start"), found["end"].cast("long").alias("end"), F.when(found.isNotNull(), same).alias("handle"))


def shown_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders that four filters let through, up to a limit, and why the others aren't shown."""
    rows = read(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "candidate_id")
    out = answers.filtered(
        rows, [F.desc("o_totalprice"), F.col("candidate_id")], 25, status=F.col("o_orderstatus") != "F", since=F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp"), priority=F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"), size=F.col("o_totalprice") >= 1000,
    )
    return out.groupBy(F.coalesce("excluded_because", F.when(F.col("shown"), "shown").otherwise("beyond the limit")).alias("why")).agg(F.count(F.lit(1)).alias("n"), F.min("candidate_id").alias("first"))


def bounded_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """terms to search a customer's facts by: aliases, then periods."""
    rows = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set(F.concat(F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string")))).alias("keys"))
    aliases = _pick(F.col("o_custkey") % 3, F.array(F.lit("net revenue"), F.lit("tax")), F.array(F.lit("open orders"), F.lit("orders"), F.lit("open orders")), F.lit(None).cast("array<string>"))
    return rows.select("o_custkey", F.array_join(answers.search_terms(aliases, F.col("keys")), ",").alias("terms"))


def surface_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups by a printed name as typed outcomes: ok, ambiguous, not found, refused."""
    rows = read(spark, sf_dir, "orders")
    asked = _pick(F.col("o_custkey") % 5, "Net Revenue", "revenue", "orders", "unheard of", "")
    known = _distinct(spark).select("surface", F.split("metric_id", ",").alias("ids"))
    found = rows.select("o_orderkey", F.lower(F.trim(asked)).alias("surface")).join(known, "surface", "left")
    outcome = F.when(F.col("surface") == "", "refused").when(F.col("ids").isNull(), "not_found").when(F.size("ids") > 1, "ambiguous").otherwise("ok")
    return found.select("o_orderkey", outcome.alias("outcome"), F.array_join("ids", ",").alias("metric_ids"))


def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded counts and digests of tables against those of now, and the verdict of the whole."""
    def now(name: str, key: str) -> DataFrame:
        return read(spark, sf_dir, name).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(key)).cast("long").alias("mark")).select(F.lit(name).alias("name"), "n", "mark")

    held = now("orders", "o_orderkey").unionByName(now("customer", "c_custkey")).unionByName(now("part", "p_partkey"))
    recorded = held.select("name", (F.col("n") + F.when(F.col("name") == "part", 1).otherwise(0)).alias("n_then"), (F.col("mark") - F.when(F.col("name") == "customer", 5).otherwise(0)).alias("mark_then"))
    rows = held.join(recorded, "name")
    state = F.when(F.col("n") != F.col("n_then"), "COUNT_CHANGED").when(F.col("mark") != F.col("mark_then"), "CONTENT_CHANGED").otherwise("fresh")
    each = rows.select("name", state.alias("state"))
    whole = each.agg(F.when(F.count_if(F.col("state") != "fresh") > 0, "stale").otherwise("fresh").alias("state")).select(F.lit("whole").alias("name"), "state")
    return each.unionByName(whole)


def vocabulary_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a vocabulary states of metrics, a row an attribute, with the formula in force at the last order."""
    metrics = vocabulary.frame(spark, "metric")
    each = metrics.unpivot("metric_id", ["label", "unit", "currency", "period_type", "family", "sign", "group_id"], "attribute", "statement").where("statement IS NOT NULL")
    last = read(spark, sf_dir, "orders").agg(F.max(F.col("o_orderdate").cast("date")).alias("day"))
    formulas = vocabulary.frame(spark, "formula").crossJoin(F.broadcast(last)).where("day BETWEEN CAST(valid_from AS DATE) AND coalesce(CAST(valid_to AS DATE), DATE '9999-12-31')")  # one row of the last day
    return each.unionByName(formulas.select("metric_id", F.lit("formula").alias("attribute"), F.col("version").alias("statement")))


def candidate_spines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and last fact of a customer with the direction between them, where the last one's size is printed once among the customer's."""
    rows = read(spark, sf_dir, "orders").withColumn("v", F.floor("o_totalprice").cast("long"))
    order = F.struct("o_orderdate", "o_orderkey")
    ends = rows.groupBy("o_custkey").agg(F.min_by(F.struct("o_orderkey", "v"), order).alias("a"), F.max_by(F.struct("o_orderkey", "v"), order).alias("b"), F.array_join(F.sort_array(F.collect_list(F.format_number("v", 0))), "; ").alias("printed"))
    quoted = F.concat(F.lit(r"(?<![\d,])\Q"), F.format_number(F.col("b.v"), 0), F.lit(r"\E(?![\d,])"))
    moved = F.when(F.col("b.v") > F.col("a.v"), "up").when(F.col("b.v") < F.col("a.v"), "down").otherwise("flat")
    return ends.where("a.o_orderkey <> b.o_orderkey").select("o_custkey", F.col("a.o_orderkey").alias("from_fact"), F.col("b.o_orderkey").alias("to_fact"), moved.alias("direction"), (F.regexp_count("printed", quoted) == 1).alias("unique_quote"))


def period_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed periods held against the bound fact's."""
    rows = read(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey") % 4)
    first = F.trunc("o_orderdate", "quarter")
    said = _pick(F.col("k"), F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string"), F.lit(" "), F.year("o_orderdate").cast("string")), F.concat(F.lit("fiscal "), F.year("o_orderdate").cast("string")), F.concat(F.lit("Q"), (F.quarter("o_orderdate") % 4 + 1).cast("string"), F.lit(" "), F.year("o_orderdate").cast("string")), F.lit("recently"))
    found = periods.surface_period(said)
    bound = periods.key(first, F.last_day(F.add_months(first, 2)), F.lit(None).cast("date"))
    key = periods.key(found["start"], found["end"], found["instant"])
    shape = periods.shape(found["start"], found["end"], found["instant"])
    code = F.when(found.isNull(), "PERIOD_UNRESOLVED").when(shape != "quarter", "PERIOD_KIND_MISMATCH").when(key != bound, "PERIOD_MISMATCH").otherwise("ok")
    return rows.select("o_orderkey", code.alias("code"))


def plan_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of plans that name unknown facts, repeat, say another direction than their facts, or rest on none."""
    orders = read(spark, sf_dir, "orders")
    points = orders.select(F.col("o_custkey").alias("plan"), (F.col("o_orderkey") + F.when(F.col("o_orderkey") % 9 == 0, 100000000).otherwise(0)).alias("fact"), F.when(F.col("o_orderkey") % 7 == 0, None).otherwise(F.when(F.col("o_totalprice") > 150000, "up").otherwise("down")).alias("says"), "o_orderkey")
    facts = orders.select(F.col("o_orderkey").alias("fact"), F.when((F.col("o_totalprice") > 150000) != (F.col("o_orderkey") % 5 == 0), "up").otherwise("down").alias("goes"))
    rows = points.join(facts, "fact", "left")
    code = F.when(F.col("goes").isNull(), "UNKNOWN_FACT").when(F.col("says").isNull(), "UNGROUNDED_POINT").when(F.col("says") != F.col("goes"), "DIRECTION_CONTRADICTS_FACT")
    return rows.withColumn("code", code).where("code IS NOT NULL").groupBy("plan", "code").agg(F.count(F.lit(1)).alias("n"))


def parser_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages read by the parser and by plain stripping of tags; the second stands in where the first kept too little."""
    pages = read(spark, sf_dir, "pages")
    bare = F.col("html")
    for pattern in (r"(?s)<!--.*?-->", r"(?s)<(head|script|style)\b.*?</(head|script|style)>", r"<[^>]*>"):
        bare = F.regexp_replace(bare, pattern, " ")
    stripped = F.length(F.regexp_replace(F.translate(bare, " ", " "), r"\s+|&\w+;?", ""))
    profile = pages.select("page_id", stripped.alias("reference"), F.regexp_count("html", F.lit("<table")).alias("n_tables"))
    kept = parse.blocks(pages.where("page_id % 7 <> 0")).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(F.length(F.regexp_replace("text", r"\s+|[&©·\"<>]", ""))).alias("chars"))
    rows = profile.join(kept, "page_id", "left")
    ratio = F.coalesce("chars", F.lit(0)) / F.greatest("reference", F.lit(1))
    reason = F.when(F.col("n_blocks").isNull(), "empty").when(ratio < 0.6, "low_coverage")
    return rows.select("page_id", F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), F.coalesce(reason, F.lit("primary")).alias("chosen"), (ratio >= 0.9).alias("covered"))


def issue_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues by code and year as a pivot with totals."""
    rows = read(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").select(F.concat("l_returnflag", "l_linestatus").alias("code"), F.when(F.year("l_shipdate") < 1998, "before").otherwise("after").alias("era"))
    wide = rows.groupBy("code").pivot("era", ["before", "after"]).count()
    filled = wide.select("code", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("before", "after"))).withColumn("total", F.col("before") + F.col("after"))
    return filled.unionByName(filled.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("before", "after", "total"))).select(F.lit("all").alias("code"), "before", "after", "total"))


QUERIES = {
    f.__name__: f
    for f in (
        answer_claims, lane_outcomes, metric_mentions, flattened_cells, shown_orders, bounded_terms, surface_outcomes, freshness, vocabulary_statements, candidate_spines, period_bindings, plan_violations, parser_coverage, issue_report,
    )
}

_A = """an AS (SELECT o_orderkey, o_orderkey % 11 AS k, floor(o_totalprice)::DOUBLE AS n, CASE o_orderkey % 11 WHEN 0 THEN 'NO_ANSWER' WHEN 1 THEN 'NO_ANSWER' WHEN 2 THEN 'OUT_OF_SCOPE' WHEN 3 THEN 'OTHER_LANE' WHEN 4 THEN 'OTHER_SUBJECT' WHEN 5 THEN 'SPAN_NOT_IN_PASSAGE'
  WHEN 6 THEN 'SPAN_NAMES_NOTHING' WHEN 7 THEN 'VALUE_NOT_IN_SPAN' WHEN 8 THEN 'SCALE_NOT_PRINTED' WHEN 9 THEN 'PERIOD_UNRESOLVED' ELSE 'ok' END AS outcome, make_date((2000 + year(o_orderdate) % 100)::INTEGER, (quarter(o_orderdate) * 3 - 2)::INTEGER, 1) AS s FROM orders)"""

ORACLES = {
    "answer_claims": f"WITH {_A} SELECT o_orderkey, outcome, CASE WHEN outcome = 'ok' THEN n END AS claimed, CASE WHEN outcome = 'ok' THEN s::VARCHAR || '..' || last_day((s + INTERVAL 2 MONTH)::DATE)::VARCHAR END AS period_key FROM an",
    "lane_outcomes": f"""WITH {_A}, p AS (SELECT *, (SELECT count(*) FROM orders o WHERE o.o_orderkey % 11 = k AND o.o_orderkey <= an.o_orderkey) AS place FROM an)
SELECT CASE WHEN place > 20 THEN 'unselected' WHEN k = 10 THEN 'claim' WHEN k < 2 THEN 'SILENT_NO_FINDING' WHEN k = 3 THEN 'deferred' ELSE 'rejected' END AS route, count(*) AS n, min(o_orderkey) AS first FROM p GROUP BY 1""",
    "metric_mentions": """WITH m(k, surface, start, "unique") AS (VALUES (0, 'net revenue', 0, true), (0, 'open orders', 16, true), (1, 'orders placed', 0, true), (1, 'refunds', 20, true), (2, 'revenue', 0, false), (4, 'discount rate', 4, true))
SELECT o_orderkey, surface, start::BIGINT AS start, "unique" FROM orders JOIN m ON k = o_orderkey % 5""",
    "flattened_cells": """WITH c AS (SELECT c_custkey, c_custkey % 4 AS r, c_custkey % 3 AS j, 'C' || c_custkey AS name, format('{:,}', floor(abs(c_acctbal))::BIGINT) AS v FROM customer),
x AS (SELECT *, CASE WHEN j = 2 OR r = 3 THEN NULL WHEN r = 0 THEN CASE j WHEN 0 THEN 'item' ELSE 'value' END WHEN r = 1 THEN CASE j WHEN 0 THEN name ELSE v END ELSE CASE j WHEN 0 THEN 'end' ELSE '—' END END AS cell,
  CASE r WHEN 0 THEN CASE j WHEN 0 THEN 2 ELSE 10 END WHEN 1 THEN 19 + CASE j WHEN 0 THEN 2 ELSE length(name) + 6 END ELSE 19 + length(name) + length(v) + 10 + CASE j WHEN 0 THEN 2 ELSE 8 END END AS start FROM c)
SELECT c_custkey, cell, CASE WHEN cell IS NOT NULL THEN start END::BIGINT AS start, CASE WHEN cell IS NOT NULL THEN start + length(cell) END::BIGINT AS "end", CASE WHEN cell IS NOT NULL THEN substr(sha256(name || '|' || cell), 1, 12) END AS handle FROM x""",
    "shown_orders": """WITH r AS (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 'status' WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'since' WHEN o_orderpriority > '4' THEN 'priority' WHEN o_totalprice < 1000 THEN 'size' END AS w FROM orders), t AS (SELECT *, row_number() OVER (PARTITION BY w IS NULL ORDER BY o_totalprice DESC, o_orderkey) AS p FROM r)
SELECT coalesce(w, CASE WHEN p <= 25 THEN 'shown' ELSE 'beyond the limit' END) AS why, count(*) AS n, min(o_orderkey) AS first FROM t GROUP BY 1""",
    "bounded_terms": """WITH k AS (SELECT o_custkey, list_sort(list_distinct(list(year(o_orderdate) || 'Q' || quarter(o_orderdate)))) AS k FROM orders GROUP BY o_custkey)
SELECT o_custkey, array_to_string((list_concat(CASE o_custkey % 3 WHEN 0 THEN ['net revenue'] WHEN 1 THEN ['open orders', 'orders'] ELSE [] END, k))[:6], ',') AS terms FROM k""",
    "surface_outcomes": """SELECT o_orderkey, CASE o_custkey % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'ambiguous' WHEN 3 THEN 'not_found' ELSE 'refused' END AS outcome, CASE o_custkey % 5 WHEN 0 THEN 'net_revenue' WHEN 1 THEN 'gross_revenue,net_revenue' WHEN 2 THEN 'open_orders,order_count' END AS metric_ids FROM orders""",
    "freshness": "SELECT * FROM (VALUES ('orders', 'fresh'), ('customer', 'CONTENT_CHANGED'), ('part', 'COUNT_CHANGED'), ('whole', 'stale')) v(name, state)",
    "vocabulary_statements": f"""WITH {vocabulary.values('metric')}, {vocabulary.values('formula')} SELECT metric_id, 'label' AS attribute, label AS statement FROM metric_dim UNION ALL SELECT metric_id, 'unit', unit FROM metric_dim UNION ALL SELECT metric_id, 'currency', currency FROM metric_dim WHERE currency IS NOT NULL
UNION ALL SELECT metric_id, 'period_type', period_type FROM metric_dim UNION ALL SELECT metric_id, 'family', family FROM metric_dim WHERE family IS NOT NULL UNION ALL SELECT metric_id, 'sign', sign FROM metric_dim UNION ALL SELECT metric_id, 'group_id', group_id FROM metric_dim WHERE group_id IS NOT NULL
UNION ALL SELECT metric_id, 'formula', version FROM formula_dim WHERE (SELECT max(o_orderdate)::DATE FROM orders) BETWEEN valid_from::DATE AND coalesce(valid_to, '9999-12-31')::DATE""",
    "candidate_spines": """WITH o AS (SELECT *, floor(o_totalprice)::BIGINT AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS b FROM orders)
SELECT x.o_custkey, x.o_orderkey AS from_fact, y.o_orderkey AS to_fact, CASE sign(y.v - x.v) WHEN 1 THEN 'up' WHEN -1 THEN 'down' ELSE 'flat' END AS direction, (SELECT count(*) FROM o z WHERE z.o_custkey = x.o_custkey AND z.v = y.v) = 1 AS unique_quote FROM o x JOIN o y ON x.o_custkey = y.o_custkey WHERE x.a = 1 AND y.b = 1 AND x.o_orderkey <> y.o_orderkey""",
    "period_bindings": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'PERIOD_KIND_MISMATCH' WHEN 2 THEN 'PERIOD_MISMATCH' ELSE 'PERIOD_UNRESOLVED' END AS code FROM orders",
    "plan_violations": "SELECT o_custkey AS plan, CASE WHEN o_orderkey % 9 = 0 THEN 'UNKNOWN_FACT' WHEN o_orderkey % 7 = 0 THEN 'UNGROUNDED_POINT' ELSE 'DIRECTION_CONTRADICTS_FACT' END AS code, count(*) AS n FROM orders WHERE o_orderkey % 9 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 GROUP BY ALL",
    # all visible text of the compared pages is in blocks, so that only those given no blocks fall back
    "parser_coverage": f"WITH {PAGE} SELECT p.page_id, count(b.seq) AS n_blocks, CASE WHEN p.page_id % 7 = 0 THEN 'empty' ELSE 'primary' END AS chosen, p.page_id % 7 <> 0 AS covered FROM pages p LEFT JOIN b ON b.page_id = p.page_id AND p.page_id % 7 <> 0 GROUP BY p.page_id",
    "issue_report": """WITH r AS (SELECT l_returnflag || l_linestatus AS code, count(*) FILTER (WHERE year(l_shipdate) < 1998) AS before, count(*) FILTER (WHERE year(l_shipdate) >= 1998) AS after FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1)
SELECT code, before, after, before + after AS total FROM r UNION ALL SELECT 'all', coalesce(sum(before), 0)::BIGINT, coalesce(sum(after), 0)::BIGINT, coalesce(sum(before + after), 0)::BIGINT FROM r""",
}
