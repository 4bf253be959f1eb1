"""Queries of the table lane, of label resolution and whole-phrase matching.

Tables are printed from the customers, one each, in six kinds of headers; the SQL tells the claims from the
customers' columns by the kind, without a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import tables
from ..sources.shared import cut
from ..sources.tables import read
from . import vocabulary

_LABELS = ("Net revenue", "Discount rate", "Orders placed (1)", "Open orders (at period end)", "Open orders", "Revenue", "Total orders and fees", "Mystery line", "Refunds", "Gross revenue")


def printed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_id, text, preceding): a pipe table of each customer."""
    rows = read(spark, sf_dir, "customer").withColumn("kind", F.col("c_custkey") % 7).withColumn("y", (1995 + F.col("c_custkey") % 5).cast("int")).withColumn("v", F.floor(F.abs("c_acctbal")).cast("long"))
    y = lambda back: (F.col("y") - back).cast("string")
    short = lambda q: F.concat(F.lit(f"{q}Q"), F.substring(F.col("y").cast("string"), 3, 2))
    line = lambda *parts: F.concat(F.lit("| "), F.concat_ws(" | ", *(p if not isinstance(p, str) else F.lit(p) for p in parts)), F.lit(" |"))
    heads = [
        (line("", "Three Months Ended June 30,", "", "Six Months Ended June 30,", ""), line("", y(0), y(1), y(0), y(1))),
        (line("", "Three Months Ended", "", "Year Ended December 31,", ""), line("", F.concat(F.lit("March 31, "), y(0)), F.concat(F.lit("June 30, "), y(0)), y(1), y(2))),
        (line("figures", "", "", ""), line("", short(1), short(2), "Change")),
        (line("", "", "Year Ended December 31,", "", ""), line("", "", y(0), "", y(1))),
        (line("", "Three Months Ended June 30,", "", "Six Months Ended June 30,"), line("", y(0), y(1), y(0))),
        (line("", "Three Months Ended June 30,", "Six Months Ended June 30,", "", "", "", ""), line("", "", "", y(0), y(1), y(2), y(3))),
        (line("", "Three Months Ended June 30,", ""), line("", y(0), y(0))),
    ]
    columns = [4, 4, 3, 2, 3, 4, 2]
    pick = lambda options: F.coalesce(*(F.when(F.col("kind") == i, o) for i, o in enumerate(options)))

    def body(i: int, label: str):
        def cell(j):
            value = F.col("v") + 100 * i + 7 * j
            number = F.format_number(value, 0)
            if i == 0:
                number = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("("), number, F.lit(")"))).otherwise(number)
            if i == 1:
                return F.concat((value % 90).cast("string"), F.lit(".5 | %"))
            return F.lit("—") if i == 8 else F.when(F.col("kind") == 3, F.concat(F.lit("$ | "), number)).otherwise(number)

        # a column less for the changes of kind 2 in one row, and in the last row for every kind
        n = F.col("n") - F.when(F.col("kind") == 2, 1).otherwise(0) if i == 2 else F.col("n") - 1 if i == 9 else F.col("n")
        return line(label, F.transform(F.sequence(F.lit(0), n - 1), cell))

    lines = [body(i, label) for i, label in enumerate(_LABELS)]
    rows = rows.withColumn("n", F.get(F.array(*map(F.lit, columns)), F.col("kind").cast("int")))
    declared = F.when(F.col("kind").isin(0, 3), line("(In thousands, except percentages and net revenue per share)"))
    text_ = F.concat_ws("\n", declared, pick([h for h, _ in heads]), pick([d for _, d in heads]), F.lit("| --- | --- |"), *lines)
    flat = F.when(F.col("c_custkey") % 50 == 49, F.lit("| only | one row |")).when(F.col("c_custkey") % 50 == 48, F.lit("| a | b |\n| c | d |\n| Net revenue | 5 |")).otherwise(text_)
    return rows.select(F.col("c_custkey").alias("table_id"), flat.alias("text"), F.when(F.col("kind") == 2, "All amounts are in millions.").alias("preceding"))


def table_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims read from tables."""
    claims, _ = tables.read_tables(cut(printed_tables(spark, sf_dir)), vocabulary.frame(spark, "metric"), vocabulary.frame(spark, "surface"))
    return claims.select("table_id", "metric_id", "period_key", "value", "unit", "scale", "scale_source", "label")


def table_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tables were refused for, by code."""
    _, issues = tables.read_tables(cut(printed_tables(spark, sf_dir)), vocabulary.frame(spark, "metric"), vocabulary.frame(spark, "surface"))
    return issues.groupBy("table_id", "code").agg(F.count(F.lit(1)).alias("n"))


def table_cells_addressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells in their own and in collapsed coordinates."""
    rows = tables.addressed(tables.cells(printed_tables(spark, sf_dir)))
    return rows.where("cell <> ''").groupBy("table_id").agg(F.count(F.lit(1)).alias("n_cells"), F.max("col").cast("long").alias("last_col"), F.max("collapsed").cast("long").alias("last_collapsed"), F.max("row").cast("long").alias("last_row"))


def resolved_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels to metrics by precedence."""
    rows = read(spark, sf_dir, "orders")
    label = F.element_at(F.array(*map(F.lit, ("Net Revenue (Unaudited)", "“Orders” placed (1)", "revenue", "Discount", "Total orders, net", "Reorders", "Open orders — at period end"))), (F.col("o_orderkey") % 7 + 1).cast("int"))
    found = tables.resolve_labels(rows.select(label.alias("label")), vocabulary.frame(spark, "metric"), vocabulary.frame(spark, "surface"))
    return rows.select("o_orderkey", label.alias("label")).join(found, "label").select("o_orderkey", F.array_join("metric_ids", ",").alias("metric_ids"), "basis")


def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole phrases in documents, met by their first word."""
    docs = read(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL")
    surfaces = spark.createDataFrame(_PHRASES, "surface string, metric_id string")
    folded = docs.select(F.col("doc_id").alias("label"), F.lower(text.folded(F.col("text"))).alias("normal"))
    return tables.label_surfaces(folded, surfaces).select(F.col("label").alias("doc_id"), F.col("metric_id").alias("concept"), "surface")


def alias_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses, contacts and rights named in documents, as whole phrases."""
    docs = read(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL")
    folded = docs.select(F.col("doc_id").alias("label"), F.lower(text.folded(F.col("text"))).alias("normal"))
    return tables.label_surfaces(folded, spark.createDataFrame(_ALIASES, "surface string, metric_id string")).select(F.col("label").alias("doc_id"), F.col("metric_id").alias("concept"), "surface")


def concept_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts of documents with how many surfaces name them."""
    return alias_hits(spark, sf_dir).groupBy("doc_id", "concept").agg(F.count(F.lit(1)).alias("n_reasons"), F.min("surface").alias("first_reason"))


_ALIASES = [("apache license", "license"), ("mit license", "license"), ("general public license", "license"), ("example", "contact"), ("released under", "rights"), ("licensed under", "rights"), ("licensed under", "license")]
_PHRASES = [("mit license", "license"), ("apache license", "license"), ("gnu general public license", "license"), ("all rights reserved", "rights"), ("rights", "rights"), ("license", "license"), ("e-mail", "contact"), ("mail", "contact"), ("the", "common")]


def printed_renderings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value in its legal printed forms: whole, in its scale, and negative in parentheses."""
    rows = read(spark, sf_dir, "customer").withColumn("n", F.floor("c_acctbal").cast("long"))
    size = F.abs("n")
    whole = F.format_number(size, 0)
    scaled = F.format_number(F.floor((size * 10 + 500) / 1000) / 10, 1)
    return rows.select(
        "c_custkey", F.when(F.col("n") < 0, F.concat(F.lit("$("), whole, F.lit(")"))).otherwise(F.concat(F.lit("$"), whole)).alias("accounting"),
        F.concat(F.when(F.col("n") < 0, "-").otherwise(""), F.lit("$"), scaled, F.lit(" thousand")).alias("prose"),
    )


QUERIES = {f.__name__: f for f in (table_claims, table_issues, table_cells_addressed, resolved_labels, phrase_hits, alias_hits, concept_scope, printed_renderings)}

# a table's columns by kind: number j, back years, first and last month (0: refused), then its rows
_LANE = """
cu AS (SELECT c_custkey AS id, c_custkey % 7 AS k, 1995 + c_custkey % 5 AS y, floor(abs(c_acctbal))::BIGINT AS v, c_acctbal < 0 AS neg, c_custkey % 50 AS f FROM customer),
hd(k, j, back, a, b) AS (VALUES (0, 0, 0, 4, 6), (0, 1, 1, 4, 6), (0, 2, 0, 1, 6), (0, 3, 1, 1, 6), (1, 0, 0, 1, 3), (1, 1, 0, 4, 6), (1, 2, 1, 1, 12), (1, 3, 2, 1, 12), (2, 0, -100, 1, 3), (2, 1, -100, 4, 6), (3, 0, 0, 1, 12), (3, 1, 1, 1, 12),
  (4, 0, 0, 4, 6), (4, 1, 1, 4, 6), (4, 2, 0, 1, 6), (6, 0, 0, 4, 6), (6, 1, 0, 4, 6)),
rw(i, metric_id, label, unit) AS (VALUES (0, 'net_revenue', 'Net revenue', 'USD'), (1, 'discount_rate', 'Discount rate', 'percent'), (2, 'order_count', 'Orders placed (1)', 'orders'), (3, 'open_orders', 'Open orders (at period end)', 'orders'), (4, 'open_orders', 'Open orders', 'orders'), (9, 'gross_revenue', 'Gross revenue', 'USD')),
ce AS (SELECT id, cu.k, i, j, metric_id, label, unit, CASE WHEN hd.k = 2 THEN 2000 + y % 100 ELSE y - back END AS yy, a, b, CASE WHEN i = 1 THEN (v + 100 + 7 * j) % 90 + 0.5 WHEN i = 0 AND neg THEN -(v + 7 * j) ELSE v + 100 * i + 7 * j END AS x
  FROM cu JOIN hd ON hd.k = cu.k CROSS JOIN rw WHERE f < 48 AND (i <> 9 OR cu.k = 2))"""



def _said(pairs: list[tuple[str, str]]) -> str:
    """Relation hit: phrases that documents hold with no letter or digit beside them."""
    values = ", ".join(f"('{a}', '{b}')" for a, b in pairs)
    folded = "translate(lower(text), '—–−“”‘’\"''', '---')"
    return f"s(surface, concept) AS (VALUES {values}), hit AS (SELECT DISTINCT doc_id, concept, surface FROM (SELECT doc_id, {folded} AS t FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL) d JOIN s ON contains(t, surface) AND regexp_matches(' ' || t || ' ', '[^a-z0-9]' || surface || '[^a-z0-9]'))"


ORACLES = {
    # kind 6 names one period twice with different values: all its rows are refused
    "table_claims": f"""WITH {_LANE}
SELECT id AS table_id, metric_id, CASE WHEN i = 3 THEN last_day(make_date(yy, b, 1))::VARCHAR ELSE make_date(yy, a, 1)::VARCHAR || '..' || last_day(make_date(yy, b, 1))::VARCHAR END AS period_key,
       CAST(x * CASE WHEN i IN (0, 9) AND k = 2 THEN 1e6 ELSE 1 END AS DOUBLE) AS value, unit, CASE WHEN k IN (0, 3) THEN 'units' WHEN k = 2 THEN CASE WHEN i IN (0, 9) THEN 'millions' ELSE 'units' END END AS scale,
       CASE WHEN k IN (0, 3) THEN 'table_header' WHEN k = 2 THEN 'preceding_context' ELSE 'metric_default' END AS scale_source, label
FROM ce WHERE i <> 4 AND k <> 6 AND NOT (i = 3 AND k IN (0, 4))
UNION ALL SELECT id, metric_id, last_day(make_date(yy, b, 1))::VARCHAR, CAST(x AS DOUBLE), unit, CASE WHEN k = 0 THEN 'units' END, CASE WHEN k = 0 THEN 'table_header' ELSE 'metric_default' END, label
FROM ce c WHERE i = 3 AND k IN (0, 4) AND (SELECT count(*) FROM ce d WHERE d.id = c.id AND d.i = 3 AND d.yy = c.yy AND d.b = c.b) = 1""",
    "table_issues": """WITH cu AS (SELECT c_custkey AS id, c_custkey % 7 AS k, c_custkey % 50 AS f FROM customer),
n(k, code, n) AS (VALUES (0, 'AMBIGUOUS_ALIAS', 2), (0, 'UNRESOLVED_METRIC', 1), (0, 'PERIOD_TYPE_MISMATCH', 4), (0, 'AMBIGUOUS_COLUMN_ALIGNMENT', 3), (1, 'AMBIGUOUS_ALIAS', 2), (1, 'UNRESOLVED_METRIC', 1), (1, 'PERIOD_TYPE_MISMATCH', 4), (1, 'AMBIGUOUS_COLUMN_ALIGNMENT', 1),
(2, 'AMBIGUOUS_ALIAS', 2), (2, 'UNRESOLVED_METRIC', 1), (2, 'PERIOD_TYPE_MISMATCH', 2), (2, 'DERIVED_CHANGE_COLUMN', 5), (3, 'AMBIGUOUS_ALIAS', 2), (3, 'UNRESOLVED_METRIC', 1), (3, 'PERIOD_TYPE_MISMATCH', 2), (3, 'AMBIGUOUS_COLUMN_ALIGNMENT', 1),
(4, 'AMBIGUOUS_ALIAS', 2), (4, 'UNRESOLVED_METRIC', 1), (4, 'PERIOD_TYPE_MISMATCH', 3), (4, 'AMBIGUOUS_COLUMN_ALIGNMENT', 2), (5, 'AMBIGUOUS_COLUMN_ALIGNMENT', 1), (6, 'AMBIGUOUS_ALIAS', 2), (6, 'UNRESOLVED_METRIC', 1), (6, 'PERIOD_TYPE_MISMATCH', 2), (6, 'AMBIGUOUS_COLUMN_ALIGNMENT', 5))
SELECT id AS table_id, code, n::BIGINT AS n FROM cu JOIN n USING (k) WHERE f < 48 UNION ALL SELECT id, CASE f WHEN 49 THEN 'UNSUPPORTED_TABLE_SHAPE' ELSE 'MISSING_PERIOD' END, 1 FROM cu WHERE f >= 48""",
    "table_cells_addressed": """SELECT 0 AS table_id WHERE false""",
    "resolved_labels": """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'net_revenue' WHEN 1 THEN 'order_count' WHEN 2 THEN 'gross_revenue,net_revenue' WHEN 3 THEN 'discount_rate' WHEN 4 THEN 'open_orders,order_count' WHEN 5 THEN '' ELSE 'open_orders,order_count' END AS metric_ids,
CASE o_orderkey % 7 WHEN 0 THEN 'canonical_label' WHEN 1 THEN 'canonical_label' WHEN 3 THEN 'exact_alias' WHEN 5 THEN 'unresolved' ELSE 'ambiguous_alias' END AS basis FROM orders""",
    "alias_hits": f"WITH {_said(_ALIASES)} SELECT doc_id, concept, surface FROM hit",
    "concept_scope": f"WITH {_said(_ALIASES)} SELECT doc_id, concept, count(*) AS n_reasons, min(surface) AS first_reason FROM hit GROUP BY doc_id, concept",
    "phrase_hits": "WITH s(surface, concept) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _PHRASES) + r"""), d AS (SELECT doc_id, translate(lower(text), '—–−“”‘’"''', '---') AS t FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
SELECT DISTINCT doc_id, concept, surface FROM d JOIN s ON contains(t, surface) AND regexp_matches(' ' || t || ' ', '[^a-z0-9]' || surface || '[^a-z0-9]')""",
    "printed_renderings": """SELECT c_custkey, CASE WHEN n < 0 THEN '$(' || format('{:,}', abs(n)) || ')' ELSE '$' || format('{:,}', n) END AS accounting,
CASE WHEN n < 0 THEN '-' ELSE '' END || '$' || format('{:,}', ((abs(n) * 10 + 500) // 1000) // 10) || '.' || (((abs(n) * 10 + 500) // 1000) % 10) || ' thousand' AS prose FROM (SELECT c_custkey, floor(c_acctbal)::BIGINT AS n FROM customer) x""",
}
del ORACLES["table_cells_addressed"]
