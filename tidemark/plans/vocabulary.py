"""The vocabulary that the series queries work with: metrics, families of thresholds, dated formulas, pairs, lineage.

Dimensions of a few rows each, kept as data: Spark gets them as frames, an independent engine as VALUES.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Thresholds of the families, in percent (points for percentages) and in units.
FAMILIES = [("amount", 65.0, 5e7), ("margin", 3.0, None), ("aging", 19.0, None), ("count", 40.0, 1000.0)]

#: metric, label, unit, currency, period type, family, sign by which it is stored, cohort basis, group that must not be merged
METRICS = [
    ("net_revenue", "Net revenue", "USD", "USD", "duration", "amount", "positive", False, "revenue_measures"),
    ("gross_revenue", "Gross revenue", "USD", "USD", "duration", "amount", "positive", False, "revenue_measures"),
    ("tax_paid", "Tax paid", "USD", "USD", "duration", "amount", "negative", True, "revenue_measures"),
    ("refund_total", "Refunds", "USD", "USD", "duration", None, "unverified", False, "revenue_measures"),
    ("discount_rate", "Discount rate", "percent", None, "duration", "margin", "positive", True, "rate_measures"),
    ("return_rate", "Return rate", "percent", None, "duration", "aging", "positive", False, "rate_measures"),
    ("order_count", "Orders placed", "orders", None, "duration", "count", "positive", False, None),
    ("open_orders", "Open orders", "orders", None, "instant", "count", "positive", False, None),
]

#: metric, version, first and last day, component metrics
FORMULAS = [
    ("net_revenue", "net_revenue_v1", "1990-01-01", "1997-12-31", "gross_revenue,discount_rate"),
    ("net_revenue", "net_revenue_v2", "1998-01-01", None, "gross_revenue"),
    ("tax_paid", "tax_paid_v1", "1996-04-01", None, "net_revenue"),
    ("return_rate", "return_rate_v1", "1990-01-01", "1999-05-15", "order_count"),
    ("return_rate", "return_rate_v2", "1999-05-16", None, "order_count"),
    ("discount_rate", "discount_rate_v1", "1990-01-01", None, "gross_revenue,order_count"),
]

#: left and right metric of the declared divergences
PAIRS = [("net_revenue", "gross_revenue"), ("discount_rate", "return_rate"), ("net_revenue", "refund_total"), ("gross_revenue", "order_count"), ("net_revenue", "absent_metric")]

#: alias, metric: ways to print a metric; some stand for several
SURFACES = [
    ("net revenue", "net_revenue"), ("revenue, net", "net_revenue"), ("revenue", "net_revenue"), ("revenue", "gross_revenue"), ("gross revenue", "gross_revenue"), ("tax paid", "tax_paid"),
    ("refunds", "refund_total"), ("discount rate", "discount_rate"), ("discount", "discount_rate"), ("return rate", "return_rate"), ("orders placed", "order_count"), ("orders", "order_count"),
    ("orders", "open_orders"), ("open orders", "open_orders"),
]

_SCHEMAS = {
    "family": (FAMILIES, "family string, pct_min double, abs_min double"),
    "metric": (METRICS, "metric_id string, label string, unit string, currency string, period_type string, family string, sign string, cohort boolean, group_id string"),
    "formula": (FORMULAS, "metric_id string, version string, valid_from string, valid_to string, components string"),
    "pair": (PAIRS, "left_metric string, right_metric string"),
    "surface": (SURFACES, "surface string, metric_id string"),
}


def frame(spark: SparkSession, name: str) -> DataFrame:
    rows, schema = _SCHEMAS[name]
    return spark.createDataFrame(rows, schema)


def values(name: str) -> str:
    """`name(columns) AS (VALUES ...)` for the WITH clause of another engine."""
    rows, schema = _SCHEMAS[name]

    def literal(value: object, kind: str) -> str:
        if value is None:
            return f"CAST(NULL AS {'VARCHAR' if kind == 'string' else kind})"
        return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else repr(value)

    kinds = [column.split(" ")[1] for column in schema.split(", ")]
    names = ", ".join(column.split(" ")[0] for column in schema.split(", "))
    return f"{name}_dim({names}) AS (VALUES {', '.join('(' + ', '.join(map(literal, row, kinds)) + ')' for row in rows)})"
