"""Series queries over readings derived from the orders: canonical points, the gate, detectors, scores.

Readings: the customers' nation is the subject; eight metrics of its line items by quarter, half year, nine
months and year, and one at quarter ends; each slot read from two filings in different scales, some from a
third that disagrees, some from a narrative whose quotation lost its columns. The SQL beside each query is a
formulation of its own over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers, periods
from ..operators import components, series
from ..sources.shared import cut
from ..sources.tables import read
from . import vocabulary

PINNED = "2001-09-30"
SCOPE = ("subject", "metric_id", "shape", "period_key")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All readings; sums are of whole cents and percents, so that they don't depend on the order of rows."""
    price, off, tax = F.round(F.col("l_extendedprice") * 100).cast("long"), F.round(F.col("l_discount") * 100).cast("long"), F.round(F.col("l_tax") * 100).cast("long")
    returned = F.col("l_returnflag") == "R"
    by_order = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum(price).alias("gross"), F.sum(price * off).alias("off"), F.sum(price * (100 - off)).alias("net"), F.sum(price * (100 - off) * tax).alias("tax"),
        F.sum(F.when(returned, price)).alias("refund"), F.count_if(returned).alias("returned"), F.count(F.lit(1)).alias("lines"),
    )
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"), (F.col("o_orderstatus") == "O").cast("long").alias("open"))
    customers = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("sid"))
    sums = ("gross", "off", "net", "tax", "refund", "returned", "lines", "open")
    base = orders.join(by_order, orders["o_orderkey"] == by_order["l_orderkey"]).join(customers, orders["o_custkey"] == customers["c_custkey"])
    base = cut(base.groupBy("sid", "y", "q").agg(F.count(F.lit(1)).alias("orders"), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in sums)))
    windows = F.array(*(F.when(F.col("q").between(first, last), F.struct(F.lit(shape).alias("shape"), F.lit(first).alias("first"), F.lit(last).alias("last"))) for shape, first, last in (
        ("quarter", 1, 1), ("quarter", 2, 2), ("quarter", 3, 3), ("quarter", 4, 4), ("ytd_6m", 1, 2), ("ytd_9m", 1, 3), ("fiscal_year", 1, 4))))
    spans = base.withColumn("w", F.explode(F.array_compact(windows))).select("*", "w.shape", "w.first", "w.last")
    spans = spans.groupBy("sid", "y", "shape", "first", "last").agg(F.count(F.lit(1)).alias("n_quarters"), *(F.sum(c).alias(c) for c in ("orders", *sums))).where("n_quarters = last - first + 1")
    start = F.make_date("y", F.col("first") * 3 - 2, F.lit(1))
    end = F.last_day(F.make_date("y", F.col("last") * 3, F.lit(1)))
    tenth = lambda part, whole: F.expr(f"CAST((2000 * {part} + {whole}) div (2 * {whole}) AS DOUBLE) / 10")
    value = {
        "net_revenue": F.col("net") / 10000, "gross_revenue": F.col("gross") / 100, "tax_paid": -F.col("tax") / 1000000, "refund_total": F.col("refund") / 100, "discount_rate": tenth("off", "(100 * gross)"),
        "return_rate": tenth("returned", "lines"), "order_count": F.col("orders").cast("double"), "open_orders": F.col("open").cast("double"),
    }
    listed = F.explode(F.array(*(F.struct(F.lit(name).alias("metric_id"), v.cast("double").alias("exact")) for name, v in value.items()))).alias("m")
    rows = spans.select("sid", "y", "shape", "last", start.alias("period_start"), end.alias("period_end"), listed).select("*", "m.metric_id", "m.exact").drop("m")
    instant = F.col("metric_id") == "open_orders"
    rows = rows.where(~instant | (F.col("shape") == "quarter")).join(vocabulary.frame(spark, "metric").select("metric_id", "unit", "currency"), "metric_id")
    rows = rows.withColumn("instant_date", F.when(instant, F.col("period_end"))).withColumn("k", F.explode(F.array(*map(F.lit, range(4)))))
    wrong, third = (F.col("sid") + F.col("last")) % 5 == 0, (F.col("sid") + F.col("last") + F.col("y")) % 7 == 0
    rows = rows.where((F.col("k") < 2) | ((F.col("k") == 2) & wrong) | ((F.col("k") == 3) & third))
    amount, k = F.col("unit") == "USD", F.col("k")
    scale = F.when(amount, F.when(k == 1, "millions").otherwise("thousands"))
    by = F.when(k == 1, 1e6).otherwise(1e3)
    off_by = F.when(k >= 2, F.when(amount, F.col("exact") * 0.5).when(F.col("unit") == "percent", 1.5).otherwise(3.0)).otherwise(0.0)
    shown = F.when(amount, F.round((F.col("exact") + off_by) / by) * by).otherwise(F.col("exact") + off_by)
    names = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("sid"), F.col("n_name").alias("subject"))
    filed = F.date_add("period_end", F.when(k == 1, 405).otherwise(40))
    narrative = k == 3
    rows = rows.join(names, "sid").select(
        "metric_id", "subject", F.when(~instant, F.col("period_start")).alias("period_start"), F.when(~instant, F.col("period_end")).alias("period_end"), "instant_date",
        F.when(instant, "instant").otherwise(F.col("shape")).alias("shape"), shown.alias("value"), "unit", F.when((F.col("metric_id") == "refund_total") & (F.col("y") >= 2000), None).otherwise(F.col("currency")).alias("currency"), scale.alias("scale"),
        F.concat(F.lit("F"), k.cast("string"), F.lit(":"), F.col("y").cast("string"), F.lit("-"), F.col("last").cast("string")).alias("document_id"), F.when(F.col("sid") % 6 != 5, filed).alias("filing_date"),
        F.when(narrative, "normalized_narrative").otherwise("normalized_table").alias("lane"), F.when(narrative & (F.col("sid") % 2 == 0), "12 34 / 56 as of March 31, 1996").when(narrative & (F.col("sid") % 3 == 0), "rose to 12 from 34 and 56").alias("quote"), "k",
    )
    key = periods.key(F.col("period_start"), F.col("period_end"), F.col("instant_date"))
    rows = rows.withColumn("period_key", key)
    return rows.withColumn("observation_id", F.concat_ws(":", "metric_id", "subject", "period_key", F.col("k").cast("string"))).drop("k")


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points, formulas and steps; points and steps are read several times, so they are written once."""
    formulas = vocabulary.frame(spark, "formula")
    points = cut(series.canonicalize(readings(spark, sf_dir)))
    return points, formulas, cut(series.steps(points, formulas))


def _moves(spark: SparkSession, parts: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    return series.measured(parts[2], parts[0], vocabulary.frame(spark, "metric"), vocabulary.frame(spark, "family"))


def series_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical points with support, filing dates and warnings."""
    points = series.canonicalize(readings(spark, sf_dir))
    return points.select(
        "metric_id", "subject", "period_key", "shape", "status", "value", "unit", "currency", "scale", "tolerance", "observation_id", F.size("support").alias("n_support"), "n_docs", "n_readings", "n_quarantined", "n_values", "n_clusters",
        F.col("first_filed").cast("string").alias("first_filed"), F.col("last_filed").cast("string").alias("last_filed"), F.array_join("warnings", ",").alias("warnings"),
    )


def point_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots by metric: several values, several clusters, by status, readings quarantined."""
    points = series.canonicalize(readings(spark, sf_dir))
    count = lambda when, name: F.count_if(when).alias(name)
    return points.groupBy("metric_id").agg(
        F.sum("n_readings").alias("n_readings"), F.count(F.lit(1)).alias("n_slots"), count(F.col("n_values") > 1, "multi_valued"), count(F.col("n_clusters") > 1, "multi_cluster"),
        count(F.col("status") == "ok", "n_ok"), count(F.col("status") == "resolved_by_majority", "n_majority"), count(F.col("status") == "conflict", "n_conflict"), F.sum("n_quarantined").alias("n_quarantined"),
    )


def gate_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the gate over four kinds of pairs, by claim, rule and reason."""
    formulas = vocabulary.frame(spark, "formula")
    points = cut(series.with_versions(series.canonicalize(readings(spark, sf_dir)), formulas))
    point = F.struct(*points.columns)

    def pairs(by: list[str], order: list[str], claim: str, rows: DataFrame) -> DataFrame:
        both = rows.select(point.alias("a"), F.lag(point).over(Window.partitionBy(*by).orderBy(*order)).alias("b")).where("b IS NOT NULL")
        related = (F.col("a.unit") == F.col("b.unit")) | (F.col("a.metric_id") == "discount_rate")
        return both.select(F.lit(f"{claim} by {' '.join(by)}").alias("pairs"), series.refusal(F.col("a"), F.col("b"), claim, related).alias("refused"))

    every = (
        pairs(["metric_id", "period_key"], ["subject"], "level", points).unionByName(pairs(["subject", "period_key"], ["metric_id"], "level", points))
        .unionByName(pairs(["subject", "period_key"], ["metric_id"], "divergence", points)).unionByName(pairs(["subject", "metric_id"], ["anchor", "period_key"], "movement", points))
        .unionByName(pairs(["subject", "metric_id", "shape"], ["anchor", "period_key"], "movement", points.where("status <> 'conflict'")))
    )
    return every.groupBy("pairs", F.coalesce("refused.rule", F.lit("ok")).alias("rule"), F.coalesce("refused.reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def series_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparable steps that fire, with their arms, sizes, direction and warnings."""
    fired = _moves(spark, _parts(spark, sf_dir)).where(F.size("arms") > 0)
    return fired.select(*SCOPE[:3], F.col("later.period_key").alias("period_key"), F.col("earlier.period_key").alias("earlier_key"), "delta", "delta_pct", "delta_pp", F.array_join("arms", ",").alias("fired_on"), "direction", F.array_join("warnings", ",").alias("warnings"))


def unmeasured_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics that no family of thresholds covers."""
    return series.unmeasured(series.canonicalize(readings(spark, sf_dir)), vocabulary.frame(spark, "metric"))


def value_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the median size over all shapes."""
    return series.floors(series.canonicalize(readings(spark, sf_dir))).select("subject", "metric_id", F.round("floor", 6).alias("floor"))


def series_reversals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reversals with their spread, population and the deltas before."""
    parts = _parts(spark, sf_dir)
    found = series.reversals(parts[2], _moves(spark, parts), parts[0])
    return found.select(*SCOPE, "delta", "d1", "d2", F.round("sigma", 4).alias("sigma"), F.col("n").alias("population"), "first_key", series.direction(F.col("sign"), F.col("d2")).alias("prior_direction"))


def series_accelerations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of four points whose steps grow."""
    found = series.accelerations(_parts(spark, sf_dir)[2])
    return found.select(*SCOPE[:3], F.col("later.period_key").alias("period_key"), "delta", "d1", "d2", "first_key")


def series_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of comparable deltas by series."""
    found = series.distributions(_parts(spark, sf_dir)[2])
    return found.select(*SCOPE[:3], "n", F.round("mean", 4).alias("mean"), F.round("sigma", 4).alias("sigma"), F.round("p90", 4).alias("p90"))


def _gapped(spark: SparkSession, points: DataFrame) -> DataFrame:
    return series.gaps(points, vocabulary.frame(spark, "formula"), vocabulary.frame(spark, "metric"), vocabulary.frame(spark, "pair"))


def series_divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of declared pairs by verdict, with their populations and relation."""
    rows = series.divergences(_gapped(spark, cut(series.canonicalize(readings(spark, sf_dir)))))
    return rows.select(
        "subject", "left_metric", "right_metric", "shape", "period_key", "gap", "verdict", F.round("z", 4).alias("z"), "n", "n_excluded", "n_unresolved", "relation", "basis",
        F.when(F.col("verdict") == "ok", F.round("sigma_without", 2)).alias("sigma_without"),
    )


def divergence_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs refused as a whole and periods refused by the gate, counted."""
    rows = _gapped(spark, series.canonicalize(readings(spark, sf_dir))).where("refused IS NOT NULL").groupBy("left_metric", "right_metric", "refused.rule", "refused.reason").agg(F.count(F.lit(1)).alias("n"))
    signs = vocabulary.frame(spark, "metric").select("metric_id", "sign")
    pairs = vocabulary.frame(spark, "pair")
    known = pairs.join(signs.select(F.col("metric_id").alias("left_metric"), F.col("sign").alias("a")), "left_metric", "left").join(signs.select(F.col("metric_id").alias("right_metric"), F.col("sign").alias("b")), "right_metric", "left")
    whole = known.select("left_metric", "right_metric", F.lit("D4").alias("rule"), F.when(F.col("a").isNull() | F.col("b").isNull(), "SERIES_ABSENT").when(F.col("a") != F.col("b"), "SIGN_CONVENTION_MISMATCH").alias("reason"), F.lit(1).cast("long").alias("n"))
    return rows.unionByName(whole.where("reason IS NOT NULL"))


def reading_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of readings of a slot's neighbours that are one reading, and why others aren't."""
    rows = series.with_versions(readings(spark, sf_dir).withColumn("anchor", F.coalesce("period_end", "instant_date")), vocabulary.frame(spark, "formula"))
    reading = F.struct(*rows.columns)
    def pairs(by: list[str]) -> DataFrame:
        along = Window.partitionBy(*by).orderBy("observation_id")
        return rows.select(F.lit(by[-1]).alias("within"), reading.alias("a"), F.lag(reading).over(along).alias("b")).where("b IS NOT NULL")

    both = pairs(["metric_id", "subject", "period_key"]).unionByName(pairs(["subject", "anchor"])).unionByName(pairs(["metric_id", "period_key", "scale"]))
    refused = both.select("within", series.disagreement(F.col("a"), F.col("b")).alias("d"))
    return refused.groupBy("within", F.coalesce("d.rule", F.lit("same")).alias("rule"), F.coalesce("d.reason", F.lit("same")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def _candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Candidates of all detectors with what stands behind them, and the spreads."""
    points, formulas, stepped = parts = _parts(spark, sf_dir)
    moves = cut(_moves(spark, parts))
    none = F.lit(None).cast("double")
    metrics = vocabulary.frame(spark, "metric").select("metric_id", "sign")

    def of(detector: str, rows: DataFrame, keys: list[Column], warnings: Column) -> DataFrame:
        name = F.concat_ws(":", F.lit("cand"), F.lit(detector), "metric_id", "subject", F.array_join(F.array_sort(F.array_compact(F.array(*keys))), "_"))
        return rows.select(name.alias("candidate_id"), F.lit(detector).alias("detector"), "subject", "metric_id", "shape", F.col("later.anchor").alias("anchor"), F.col("later.period_key").alias("period_key"), "delta", none.alias("z"), F.least("later.n_docs", "earlier.n_docs").alias("n_docs"), warnings.alias("n_warnings"))

    now, was = F.col("later.period_key"), F.col("earlier.period_key")
    fired = of("metric_move", moves.where(F.size("arms") > 0), [was, now], F.size("warnings"))
    turned = of("trend_reversal", series.reversals(stepped, moves, points), [F.col("first_key"), was, now], F.size("warnings"))
    grown = of("acceleration", series.accelerations(stepped), [F.col("first_key"), was, now], F.size(F.array_distinct(F.concat("later.warnings", "earlier.warnings"))))
    apart = series.divergences(_gapped(spark, points)).where("verdict = 'ok'")
    apart = apart.select(
        F.concat_ws(":", F.lit("cand"), F.lit("cross_metric_divergence"), F.concat_ws("-", "left_metric", "right_metric"), "subject", "period_key").alias("candidate_id"), F.lit("cross_metric_divergence").alias("detector"), "subject",
        F.col("left_metric").alias("metric_id"), "shape", "anchor", "period_key", none.alias("delta"), "z", F.least("left_docs", "right_docs").alias("n_docs"),
        (F.when(F.col("n_excluded") + F.col("n_unresolved") > 0, 1).otherwise(0) + F.when(F.col("basis").isNotNull(), 1).otherwise(0)).alias("n_warnings"),
    )
    every = fired.unionByName(turned).unionByName(grown).unionByName(apart)
    negative = points.where("value < 0").groupBy("subject", "metric_id").agg(F.min_by("period_key", F.struct("anchor", "period_key")).alias("negative_key"))
    every = every.join(negative, ["subject", "metric_id"], "left").withColumn("first_negative", F.coalesce(F.col("negative_key") == F.col("period_key"), F.lit(False))).withColumn("repetition", F.lit(0.0))
    return every, series.distributions(stepped)


def series_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all detectors' candidates with their terms and those suppressed."""
    rows = series.score(*_candidates(spark, sf_dir), PINNED)
    return rows.select("candidate_id", "detector", "subject", "metric_id", "period_key", "score", F.array_join("suppressed", ",").alias("suppressed"), *(F.round(f"t_{t}", 6).alias(f"term_{t}") for t in series.WEIGHTS if t != "repetition"))


def _lineage(spark: SparkSession) -> DataFrame:
    """(a, b, relation) of two different metrics, closest relation first, over all formulas."""
    formulas = vocabulary.frame(spark, "formula")
    parts = formulas.select("metric_id", F.explode(F.split("components", ",")).alias("part")).distinct()
    component = parts.select(F.col("metric_id").alias("a"), F.col("part").alias("b"), F.lit(1).alias("rank"))
    shared = parts.alias("x").join(parts.alias("y"), F.col("x.part") == F.col("y.part")).where("x.metric_id <> y.metric_id").select(F.col("x.metric_id").alias("a"), F.col("y.metric_id").alias("b"), F.lit(2).alias("rank"))
    co = series.co_components(formulas).withColumn("rank", F.lit(3))
    both = component.unionByName(shared).unionByName(co)
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "rank")).where("a <> b")
    names = F.element_at(F.array(*map(F.lit, ("component", "shared_components", "co_component"))), F.col("rank"))
    return both.groupBy("a", "b").agg(F.min("rank").alias("rank")).select("a", "b", names.alias("relation"))


def lineage_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closest lineage of two metrics."""
    return _lineage(spark)


def ranked_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of one anchor period about related metrics as one cluster, ranked by their best."""
    rows = cut(series.score(*_candidates(spark, sf_dir), PINNED).select("candidate_id", "subject", "metric_id", "period_key", "score"))
    # members of one group meet through their metric's first candidate, so that links grow with candidates and not with their pairs
    firsts = rows.groupBy("subject", "period_key", "metric_id").agg(F.min("candidate_id").alias("first"))
    same = rows.join(firsts, ["subject", "period_key", "metric_id"]).select(F.col("candidate_id").alias("a"), F.col("first").alias("b"))
    other = firsts.alias("x").join(firsts.alias("y"), ["subject", "period_key"]).join(_lineage(spark), (F.col("x.metric_id") == F.col("a")) & (F.col("y.metric_id") == F.col("b")))
    links = same.unionByName(other.select(F.col("x.first").alias("a"), F.col("y.first").alias("b")))
    grouped = components.connected(rows.select(F.col("candidate_id").alias("id")), links).select(F.col("id").alias("candidate_id"), F.col("component").alias("cluster"))
    whole = rows.join(grouped, "candidate_id")
    # a cluster's place: how many clusters have a better best; counted over clusters sorted by ranges, not in one task
    best = cut(whole.groupBy("cluster").agg(F.max_by(F.struct("score", "candidate_id"), F.struct("score", F.col("candidate_id"))).alias("x")).select("cluster", F.col("x.score").alias("top")))
    place = placed(best, [F.col("top").desc(), F.col("cluster")])
    return whole.join(place.select("cluster", "place"), "cluster").select("candidate_id", "subject", "period_key", "score", "cluster", F.col("place").alias("cluster_rank"))


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with `place`, from 1 in the whole order: sorted by ranges, numbered inside them, and moved by the counts before."""
    ranged = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("part").count()
    before = counts.withColumn("before", F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", F.coalesce("before", F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return ranged.withColumn("inside", inside).join(before, "part").withColumn("place", F.col("inside") + F.col("before")).drop("part", "inside", "before")


def change_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of consecutive points by operation with the unit of the result and a word for the direction."""
    stepped = series.steps(series.canonicalize(readings(spark, sf_dir)), vocabulary.frame(spark, "formula"))
    a, b, unit = F.col("earlier.value"), F.col("later.value"), F.col("later.unit")
    percent = unit == "percent"
    ops = F.explode(F.array(
        F.struct(F.lit("absolute_change").alias("op"), numbers.delta(a, b).alias("result"), F.when(percent, "percentage_points").otherwise(unit).alias("result_unit")),
        F.struct(F.lit("relative_change").alias("op"), F.when(~percent, F.round(numbers.relative_change(a, b), 6)).alias("result"), F.lit("percent").alias("result_unit")),
        F.struct(F.lit("basis_points").alias("op"), F.when(percent, F.round((b - a) * 100, 6)).alias("result"), F.lit("basis_points").alias("result_unit")),
        F.struct(F.lit("ratio").alias("op"), F.when((a != 0) & (F.col("later.subject") == F.col("earlier.subject")), F.round(b / a, 6)).alias("result"), F.lit("multiple").alias("result_unit")),
    )).alias("o")
    rows = stepped.join(vocabulary.frame(spark, "metric").select("metric_id", "sign"), "metric_id").select(*SCOPE[:3], F.col("later.period_key").alias("period_key"), "sign", "delta", ((a < 0) != (b < 0)).alias("crosses_zero"), strictly_crosses(a, b).alias("strict_crossing"), ops)
    rows = rows.where("o.result IS NOT NULL")
    return rows.select(*SCOPE, "o.op", "o.result", "o.result_unit", "strict_crossing", series.direction(F.col("sign"), F.col("delta")).alias("direction"))


def strictly_crosses(a: Column, b: Column) -> Column:
    """A strict change of sign; from or to zero is none."""
    return ((a < 0) & (b > 0)) | ((a > 0) & (b < 0))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        series_points, point_census, gate_census, series_moves, unmeasured_metrics, value_floors, series_reversals, series_accelerations, series_distributions, series_divergences, divergence_refusals,
        reading_agreement, series_scores, lineage_pairs, ranked_clusters, change_operations,
    )
}

# the same readings told in SQL, from which the SQL of each query goes on by itself

_BASE = f"""
{vocabulary.values("family")}, {vocabulary.values("metric")}, {vocabulary.values("formula")}, {vocabulary.values("pair")},
li AS (SELECT l_orderkey, round(l_extendedprice * 100)::BIGINT AS p, round(l_discount * 100)::BIGINT AS d, round(l_tax * 100)::BIGINT AS t, l_returnflag = 'R' AS r FROM lineitem),
ord AS (SELECT o_orderkey, c_nationkey AS sid, year(o_orderdate) AS y, quarter(o_orderdate) AS q, o_orderstatus = 'O' AS open FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
qu AS (SELECT sid, y, q, sum(p) AS gross, sum(p * d) AS off, sum(p * (100 - d)) AS net, sum(p * (100 - d) * t) AS tax, coalesce(sum(p) FILTER (WHERE r), 0) AS refund, count(*) FILTER (WHERE r) AS returned, count(*) AS lines FROM ord JOIN li ON l_orderkey = o_orderkey GROUP BY ALL),
oc AS (SELECT sid, y, q, count(*) AS orders, count(*) FILTER (WHERE open) AS n_open FROM ord GROUP BY ALL),
sp(shape, f, l) AS (VALUES ('quarter', 1, 1), ('quarter', 2, 2), ('quarter', 3, 3), ('quarter', 4, 4), ('ytd_6m', 1, 2), ('ytd_9m', 1, 3), ('fiscal_year', 1, 4)),
span AS (SELECT sid, y, shape, f, l, sum(gross) AS gross, sum(off) AS off, sum(net) AS net, sum(tax) AS tax, sum(refund) AS refund, sum(returned) AS returned, sum(lines) AS lines, sum(orders) AS orders, sum(n_open) AS n_open
  FROM qu JOIN oc USING (sid, y, q) JOIN sp ON q BETWEEN f AND l GROUP BY ALL HAVING count(*) = l - f + 1),
val AS (SELECT sid, y, shape, f, l, unnest(['net_revenue', 'gross_revenue', 'tax_paid', 'refund_total', 'discount_rate', 'return_rate', 'order_count', 'open_orders']) AS metric_id,
  unnest([net / 10000, gross / 100, -tax / 1000000, refund / 100, ((2000 * off + 100 * gross) // (200 * gross)) / 10, ((2000 * returned + lines) // (2 * lines)) / 10, orders::DOUBLE, n_open::DOUBLE]) AS x FROM span),
rd AS (SELECT m.metric_id, n_name AS subject, v.sid, v.y, v.l, k, CASE WHEN m.period_type = 'instant' THEN 'instant' ELSE v.shape END AS shape, make_date(y, f * 3 - 2, 1) AS s, last_day(make_date(y, l * 3, 1)) AS e, m.unit, m.period_type = 'instant' AS inst,
  CASE WHEN m.metric_id = 'refund_total' AND y >= 2000 THEN NULL ELSE m.currency END AS currency, CASE WHEN m.unit = 'USD' THEN CASE k WHEN 1 THEN 'millions' ELSE 'thousands' END END AS scale,
  CASE WHEN m.unit <> 'USD' THEN x + CASE WHEN k >= 2 THEN CASE m.unit WHEN 'percent' THEN 1.5 ELSE 3 END ELSE 0 END WHEN k = 1 THEN round(x / 1e6) * 1e6 WHEN k = 0 THEN round(x / 1e3) * 1e3 ELSE round((x + x * 0.5) / 1e3) * 1e3 END AS value
  FROM val v JOIN metric_dim m USING (metric_id) JOIN nation ON n_nationkey = sid CROSS JOIN range(4) r(k)
  WHERE (m.period_type <> 'instant' OR v.shape = 'quarter') AND (k < 2 OR k = 2 AND (sid + l) % 5 = 0 OR k = 3 AND (sid + l + y) % 7 = 0)),
reading AS (SELECT metric_id, subject, CASE WHEN inst THEN e::VARCHAR ELSE s::VARCHAR || '..' || e::VARCHAR END AS period_key, shape, e AS anchor, inst, s, e, value::DOUBLE + 0::DOUBLE AS value, unit, currency, scale, 'F' || k || ':' || y || '-' || l AS doc,
  CASE WHEN sid % 6 <> 5 THEN e + CASE WHEN k = 1 THEN 405 ELSE 40 END END AS filed, k = 3 AND sid % 2 = 0 AS defect, k = 3 AND sid % 2 <> 0 AND sid % 3 <> 0 AS unquoted, metric_id || ':' || subject || ':' || CASE WHEN inst THEN e::VARCHAR ELSE s::VARCHAR || '..' || e::VARCHAR END || ':' || k AS obs,
  CASE WHEN unit = 'percent' THEN 0.1 WHEN unit = 'USD' AND scale = 'millions' THEN 1e6 WHEN unit = 'USD' THEN 1e3 ELSE 1.0 END AS tol, CASE scale WHEN 'thousands' THEN 0 WHEN 'millions' THEN 1 ELSE 2 END AS prec FROM rd),
kept AS (SELECT * FROM reading WHERE NOT defect),
brk AS (SELECT *, coalesce(round(value - lag(value) OVER w, 9) > greatest(tol, lag(tol) OVER w), false)::INT AS b FROM kept WINDOW w AS (PARTITION BY metric_id, subject, period_key ORDER BY value, obs)),
clu AS (SELECT *, sum(b) OVER (PARTITION BY metric_id, subject, period_key ORDER BY value, obs) AS c FROM brk),
cs AS (SELECT metric_id, subject, period_key, c, count(DISTINCT doc) AS docs, count(*) AS n, min((prec, coalesce(filed, DATE '9999-12-31'), obs)) AS best FROM clu GROUP BY ALL),
rk AS (SELECT *, row_number() OVER w AS r, lead(docs) OVER w AS runner, count(*) OVER (PARTITION BY metric_id, subject, period_key) AS n_clusters FROM cs WINDOW w AS (PARTITION BY metric_id, subject, period_key ORDER BY docs DESC, best)),
win AS (SELECT metric_id, subject, period_key, n_clusters, n, best[3] AS obs, CASE WHEN runner IS NULL THEN 'ok' WHEN docs >= 2 AND docs >= 2 * runner THEN 'resolved_by_majority' ELSE 'conflict' END AS status FROM rk WHERE r = 1),
slot AS (SELECT metric_id, subject, period_key, any_value(shape) AS shape, any_value(anchor) AS anchor, any_value(inst) AS inst, any_value(s) AS s, any_value(e) AS e, count(*) AS n_readings, count(*) FILTER (WHERE defect) AS n_quarantined, bool_or(unquoted) AS unquoted,
  count(DISTINCT doc) FILTER (WHERE NOT defect) AS n_docs, count(DISTINCT value) FILTER (WHERE NOT defect) AS n_values, min(filed) FILTER (WHERE NOT defect) AS first_filed, max(filed) FILTER (WHERE NOT defect) AS last_filed, bool_or(filed IS NULL AND NOT defect) AS undated, min(unit) AS u0, min(currency) AS c0 FROM reading GROUP BY ALL),
pt AS (SELECT sl.*, w.status, w.n_clusters, CASE WHEN w.status <> 'conflict' THEN w.n END AS n_support, k.value, k.scale, k.tol, k.obs, CASE WHEN k.obs IS NULL THEN u0 ELSE k.unit END AS unit, CASE WHEN k.obs IS NULL THEN c0 ELSE k.currency END AS currency,
  list_sort(list_filter([CASE WHEN n_quarantined > 0 THEN 'lane_defect' END, CASE WHEN sl.unquoted THEN 'quarantine_not_evaluated' END, CASE WHEN sl.undated THEN 'filing_date_unknown' END, CASE WHEN w.n_clusters > 1 THEN 'minority_reading_present' END], lambda x: x IS NOT NULL)) AS warnings
  FROM slot sl JOIN win w USING (metric_id, subject, period_key) LEFT JOIN kept k ON k.obs = w.obs AND w.status <> 'conflict'),
vp AS (SELECT p.*, EXISTS (SELECT 1 FROM formula_dim f WHERE f.metric_id = p.metric_id) AS versioned, (SELECT max(version) FROM formula_dim f WHERE f.metric_id = p.metric_id AND p.anchor BETWEEN f.valid_from::DATE AND coalesce(f.valid_to, '9999-12-31')::DATE) AS v,
  (SELECT max(version) FROM formula_dim f WHERE f.metric_id = p.metric_id AND p.s BETWEEN f.valid_from::DATE AND coalesce(f.valid_to, '9999-12-31')::DATE) AS v0 FROM pt p)"""

# a step is told by the nearest earlier valued point, not by a lag over the series
_STEPS = (
    _BASE
    + """,
vl AS (SELECT * FROM vp WHERE status <> 'conflict'),
st AS (SELECT b.subject, b.metric_id, b.shape, b.period_key, b.anchor, a.period_key AS earlier_key, a.value AS v1, b.value AS v2, round(b.value - a.value, 9) AS delta, a.unit, greatest(a.tol, b.tol) AS tol, a.n_docs AS d1docs, b.n_docs AS d2docs, a.warnings AS w1, b.warnings AS w2,
  CASE WHEN a.currency IS DISTINCT FROM b.currency THEN 'R5 CURRENCY_MISMATCH' WHEN b.versioned AND NOT b.inst AND (b.v0 IS DISTINCT FROM b.v OR a.v0 IS DISTINCT FROM a.v) THEN 'R6 FORMULA_VERSION_STRADDLES' WHEN b.versioned AND (a.v IS NULL OR b.v IS NULL) THEN 'R6 FORMULA_VERSION_UNDECLARED'
  WHEN b.versioned AND a.v <> b.v THEN 'R6 FORMULA_VERSION_MISMATCH' WHEN round(abs(a.value - b.value), 9) <= greatest(a.tol, b.tol) THEN 'R8 WITHIN_PRESENTATION_TOLERANCE' WHEN datediff('month', a.anchor, b.anchor) <> CASE WHEN b.shape IN ('quarter', 'instant') THEN 3 ELSE 12 END THEN 'R10 SERIES_GAP' ELSE 'ok' END AS verdict
  FROM vl b JOIN vl a ON a.subject = b.subject AND a.metric_id = b.metric_id AND a.shape = b.shape AND a.anchor = (SELECT max(x.anchor) FROM vl x WHERE x.subject = b.subject AND x.metric_id = b.metric_id AND x.shape = b.shape AND x.anchor < b.anchor)),
ok AS (SELECT * FROM st WHERE verdict = 'ok'),
fl AS (SELECT subject, metric_id, 0.1 * median(abs(value)) AS floor FROM vl GROUP BY ALL),
mv0 AS (SELECT o.*, m.sign, f.pct_min, f.abs_min, CASE WHEN abs(v1) > 0 AND abs(v1) >= fl.floor THEN round(delta / abs(v1) * 100, 9) END AS rel, (v1 = 0 OR (v1 < 0) <> (v2 < 0)) AS crosses FROM ok o JOIN metric_dim m USING (metric_id) JOIN family_dim f USING (family) JOIN fl USING (subject, metric_id)),
mv AS (SELECT *, array_to_string(list_filter([CASE WHEN unit = 'percent' AND abs(delta) >= pct_min THEN 'pp' END, CASE WHEN unit <> 'percent' AND abs(rel) >= pct_min THEN 'pct' END, CASE WHEN abs(delta) >= abs_min THEN 'abs' END], lambda x: x IS NOT NULL), ',') AS arms,
  CASE WHEN sign <> 'unverified' THEN CASE WHEN delta = 0 THEN 'unchanged' WHEN (delta > 0) = (sign = 'positive') THEN 'increase' ELSE 'decrease' END END AS direction,
  list_sort(list_distinct(list_concat(w1, w2, list_filter([CASE WHEN crosses THEN 'relative_change_across_zero' END, CASE WHEN sign = 'unverified' THEN 'metric_sign_convention_unverified' END], lambda x: x IS NOT NULL)))) AS warnings FROM mv0),
chain AS (SELECT c.*, b.delta AS d1, a.delta AS d2, a.earlier_key AS first_key FROM ok c JOIN ok b ON b.subject = c.subject AND b.metric_id = c.metric_id AND b.shape = c.shape AND b.period_key = c.earlier_key JOIN ok a ON a.subject = c.subject AND a.metric_id = c.metric_id AND a.shape = c.shape AND a.period_key = b.earlier_key),
ds AS (SELECT subject, metric_id, shape, count(*) AS n, avg(delta) AS mean, stddev_pop(delta) AS sigma, CASE WHEN count(*) >= 4 THEN quantile_cont(abs(delta), 0.9) END AS p90 FROM ok GROUP BY ALL),
ct AS (SELECT subject, metric_id, shape, max(tol) AS coarsest FROM vl GROUP BY ALL),
rv AS (SELECT c.*, ds.sigma, ds.n AS population, mv.sign, mv.warnings FROM chain c JOIN ds USING (subject, metric_id, shape) JOIN ct USING (subject, metric_id, shape) JOIN mv ON mv.subject = c.subject AND mv.metric_id = c.metric_id AND mv.shape = c.shape AND mv.period_key = c.period_key
  WHERE ds.n >= 8 AND ds.sigma >= ct.coarsest AND c.d1 * c.d2 > 0 AND c.d1 * c.delta < 0 AND mv.arms <> '' AND round(abs(c.delta) - ds.sigma, 6) >= 0),
ac AS (SELECT * FROM chain WHERE d2 * d1 > 0 AND d1 * delta > 0 AND abs(d1) > abs(d2) AND abs(delta) > abs(d1) AND round(abs(delta) - 1.5 * abs(d2), 9) >= 0)"""
)

_COMP = "cmp AS (SELECT metric_id, version, unnest(string_split(components, ',')) AS part FROM formula_dim), co AS (SELECT DISTINCT x.part AS a, y.part AS b FROM cmp x JOIN cmp y ON x.version = y.version AND x.part <> y.part)"
_GAPS = (
    _BASE
    + f""", {_COMP},
pr AS (SELECT p.*, l.group_id = r.group_id AS grp, l.cohort <> r.cohort AS mixed, (p.left_metric, p.right_metric) IN (SELECT (a, b) FROM co) AS co FROM pair_dim p JOIN metric_dim l ON l.metric_id = left_metric JOIN metric_dim r ON r.metric_id = right_metric WHERE l.sign = r.sign),
g0 AS (SELECT pr.*, l.subject, l.shape, l.period_key, l.anchor, l.v AS lv, r.v AS rv, l.currency, round(l.value - r.value, 9) AS gap, greatest(l.tol, r.tol) AS tol, least(l.n_docs, r.n_docs) AS ldocs,
  CASE WHEN NOT (coalesce(grp, false) OR co) THEN 'R2 UNRELATED_METRICS' WHEN l.unit IS DISTINCT FROM r.unit THEN 'R4 UNIT_MISMATCH' WHEN l.currency IS DISTINCT FROM r.currency THEN 'R5 CURRENCY_MISMATCH' WHEN (l.versioned AND NOT l.inst AND l.v0 IS DISTINCT FROM l.v) OR (r.versioned AND NOT r.inst AND r.v0 IS DISTINCT FROM r.v) THEN 'R6 FORMULA_VERSION_STRADDLES'
  WHEN (l.versioned AND l.v IS NULL) OR (r.versioned AND r.v IS NULL) THEN 'R6 FORMULA_VERSION_UNDECLARED' WHEN l.value IS NULL OR r.value IS NULL THEN 'R7 NOT_CANONICAL' ELSE 'ok' END AS verdict,
  CASE WHEN list_contains(lf.parts, right_metric) OR list_contains(rf.parts, left_metric) THEN 'component' WHEN list_has_any(lf.parts, rf.parts) THEN 'shared_components' WHEN co THEN 'co_component' WHEN grp THEN 'distinct_group' END AS relation
  FROM pr JOIN vp l ON l.metric_id = left_metric JOIN vp r ON r.metric_id = right_metric AND r.subject = l.subject AND r.period_key = l.period_key
  LEFT JOIN (SELECT version, list(part) AS parts FROM cmp GROUP BY version) lf ON lf.version = l.v LEFT JOIN (SELECT version, list(part) AS parts FROM cmp GROUP BY version) rf ON rf.version = r.v),
g1 AS (SELECT * FROM g0 WHERE verdict = 'ok'),
pop AS (SELECT a.subject, a.left_metric, a.right_metric, a.shape, a.period_key, count(*) AS n, avg(b.gap) AS mean, stddev_pop(b.gap) AS sigma, 2 * max(b.tol) AS least, coalesce(stddev_pop(b.gap) FILTER (WHERE b.period_key <> a.period_key), 0) AS sigma_without
  FROM g1 a JOIN g1 b ON a.subject = b.subject AND a.left_metric = b.left_metric AND a.right_metric = b.right_metric AND a.shape = b.shape AND a.lv IS NOT DISTINCT FROM b.lv AND a.rv IS NOT DISTINCT FROM b.rv AND a.currency IS NOT DISTINCT FROM b.currency GROUP BY ALL),
tot AS (SELECT subject, left_metric, right_metric, shape, count(*) FILTER (WHERE verdict = 'ok') AS n_gaps, count(*) FILTER (WHERE verdict LIKE 'R7%') AS n_unresolved FROM g0 GROUP BY ALL),
dv AS (SELECT g.*, p.n, p.sigma, p.sigma_without, CASE WHEN p.sigma > 0 THEN (g.gap - p.mean) / p.sigma END AS z, t.n_gaps - p.n AS n_excluded, t.n_unresolved,
  CASE WHEN p.n < 8 THEN 'POPULATION_TOO_SMALL' WHEN p.sigma < p.least OR p.sigma_without < p.least THEN 'LOW_VARIANCE_PRESENTATION_NOISE' WHEN abs((g.gap - p.mean) / p.sigma) < 1.5 THEN 'WITHIN_SPREAD' WHEN relation IS NULL THEN 'RELATION_UNDECLARED' ELSE 'ok' END AS final
  FROM g1 g JOIN pop p USING (subject, left_metric, right_metric, shape, period_key) JOIN tot t USING (subject, left_metric, right_metric, shape))"""
)
_CAND = (
    _STEPS
    + _GAPS.removeprefix(_BASE)
    + """,
cand AS (SELECT 'cand:metric_move:' || metric_id || ':' || subject || ':' || array_to_string(list_sort([earlier_key, period_key]), '_') AS candidate_id, 'metric_move' AS detector, subject, metric_id, shape, anchor, period_key, delta, NULL::DOUBLE AS z0, least(d1docs, d2docs) AS n_docs, len(warnings) AS n_warnings FROM mv WHERE arms <> ''
UNION ALL SELECT 'cand:trend_reversal:' || metric_id || ':' || subject || ':' || array_to_string(list_sort([first_key, earlier_key, period_key]), '_'), 'trend_reversal', subject, metric_id, shape, anchor, period_key, delta, NULL, least(d1docs, d2docs), len(warnings) FROM rv
UNION ALL SELECT 'cand:acceleration:' || metric_id || ':' || subject || ':' || array_to_string(list_sort([first_key, earlier_key, period_key]), '_'), 'acceleration', subject, metric_id, shape, anchor, period_key, delta, NULL, least(d1docs, d2docs), len(list_distinct(list_concat(w1, w2))) FROM ac
UNION ALL SELECT 'cand:cross_metric_divergence:' || left_metric || '-' || right_metric || ':' || subject || ':' || period_key, 'cross_metric_divergence', subject, left_metric, shape, anchor, period_key, NULL, z, ldocs, CASE WHEN n_excluded + n_unresolved > 0 THEN 1 ELSE 0 END + CASE WHEN mixed THEN 1 ELSE 0 END FROM dv WHERE final = 'ok'),
neg AS (SELECT subject, metric_id, min((anchor, period_key))[2] AS k FROM pt WHERE value < 0 GROUP BY ALL),
tm AS (SELECT c.*, CASE WHEN z0 IS NOT NULL THEN abs(z0) WHEN n >= 8 AND sigma > 0 THEN abs((delta - mean) / sigma) END AS zz, CASE WHEN z0 IS NULL AND p90 > 0 THEN abs(delta) / p90 END AS uu, coalesce(neg.k = c.period_key, false) AS first,
  row_number() OVER (PARTITION BY detector, c.subject, c.metric_id ORDER BY anchor, c.period_key, candidate_id) - 1 AS prior FROM cand c LEFT JOIN ds USING (subject, metric_id, shape) LEFT JOIN neg USING (subject, metric_id)),
tr AS (SELECT *, round(least(1, zz / 4), 9) AS tz, round(least(1, uu), 9) AS tu, round(least(1, n_docs / 5), 9) AS tc, round(least(1, 1 / (1 + prior) + CASE WHEN first THEN 0.5 ELSE 0 END), 9) AS tn,
  round(greatest(0, least(1, 1 - datediff('month', anchor, DATE '2001-09-30') / 3 / 32)), 9) AS tt, least(n_warnings, 4)::DOUBLE AS tw, CASE WHEN n_docs = 1 THEN 1 ELSE 0 END::DOUBLE AS t1 FROM tm),
sc AS (SELECT *, round(round(coalesce(tz, 0) * 0.4, 9) + round(coalesce(tu, 0) * 0.2, 9) + round(tc * 0.15, 9) + round(tn * 0.1, 9) + round(tt * 0.1, 9) + round(tw * -0.15, 9) + round(t1 * -0.2, 9), 9) AS score FROM tr)"""
)
_LINEAGE = """lin AS (SELECT a, b, min(r) AS r FROM (SELECT metric_id AS a, part AS b, 1 AS r FROM cmp UNION ALL SELECT part, metric_id, 1 FROM cmp UNION ALL SELECT x.metric_id, y.metric_id, 2 FROM cmp x JOIN cmp y ON x.part = y.part AND x.metric_id <> y.metric_id UNION ALL SELECT a, b, 3 FROM co) u WHERE a <> b GROUP BY a, b)"""

ORACLES = {
    "series_points": f"WITH {_BASE} SELECT metric_id, subject, period_key, shape, status, value, unit, currency, scale, tol AS tolerance, obs AS observation_id, n_support::INTEGER AS n_support, n_docs, n_readings, n_quarantined, n_values, n_clusters::INTEGER AS n_clusters, first_filed::VARCHAR AS first_filed, last_filed::VARCHAR AS last_filed, array_to_string(warnings, ',') AS warnings FROM pt",
    "point_census": f"""WITH {_BASE} SELECT metric_id, sum(n_readings)::BIGINT AS n_readings, count(*) AS n_slots, count(*) FILTER (WHERE n_values > 1) AS multi_valued, count(*) FILTER (WHERE n_clusters > 1) AS multi_cluster, count(*) FILTER (WHERE status = 'ok') AS n_ok,
count(*) FILTER (WHERE status = 'resolved_by_majority') AS n_majority, count(*) FILTER (WHERE status = 'conflict') AS n_conflict, sum(n_quarantined)::BIGINT AS n_quarantined FROM pt GROUP BY metric_id""",
    "gate_census": f"""WITH {_BASE}, num AS (SELECT *, row_number() OVER (PARTITION BY metric_id, period_key ORDER BY subject) AS i1, row_number() OVER (PARTITION BY subject, period_key ORDER BY metric_id) AS i2, row_number() OVER (PARTITION BY subject, metric_id ORDER BY anchor, period_key) AS i3 FROM vp),
val4 AS (SELECT *, row_number() OVER (PARTITION BY subject, metric_id, shape ORDER BY anchor, period_key) AS i4 FROM vp WHERE status <> 'conflict'),
j AS (SELECT 'level' AS claim, 'level by metric_id period_key' AS pairs, a, b FROM num a JOIN num b ON a.metric_id = b.metric_id AND a.period_key = b.period_key AND a.i1 = b.i1 + 1
UNION ALL SELECT 'level', 'level by subject period_key', a, b FROM num a JOIN num b ON a.subject = b.subject AND a.period_key = b.period_key AND a.i2 = b.i2 + 1
UNION ALL SELECT 'divergence', 'divergence by subject period_key', a, b FROM num a JOIN num b ON a.subject = b.subject AND a.period_key = b.period_key AND a.i2 = b.i2 + 1
UNION ALL SELECT 'movement', 'movement by subject metric_id', a, b FROM num a JOIN num b ON a.subject = b.subject AND a.metric_id = b.metric_id AND a.i3 = b.i3 + 1),
jj AS (SELECT claim, pairs, a.metric_id AS am, b.metric_id AS bm, a.subject AS asub, b.subject AS bsub, a.shape AS ash, b.shape AS bsh, a.unit AS au, b.unit AS bu, a.currency AS ac, b.currency AS bc, a.versioned AS av, b.versioned AS bv, a.v AS a1, b.v AS b1, a.v0 AS a0, b.v0 AS b0, a.inst AS ai, b.inst AS bi, a.value AS ax, b.value AS bx, greatest(a.tol, b.tol) AS tol, a.anchor AS aa, b.anchor AS ba FROM j
UNION ALL SELECT 'movement', 'movement by subject metric_id shape', a.metric_id, b.metric_id, a.subject, b.subject, a.shape, b.shape, a.unit, b.unit, a.currency, b.currency, a.versioned, b.versioned, a.v, b.v, a.v0, b.v0, a.inst, b.inst, a.value, b.value, greatest(a.tol, b.tol), a.anchor, b.anchor
  FROM val4 a JOIN val4 b ON a.subject = b.subject AND a.metric_id = b.metric_id AND a.shape = b.shape AND a.i4 = b.i4 + 1),
w AS (SELECT pairs, CASE WHEN asub <> bsub THEN 'R1 SUBJECT_MISMATCH' WHEN am <> bm AND claim <> 'divergence' THEN 'R2 METRIC_MISMATCH' WHEN am <> bm AND au <> bu AND am <> 'discount_rate' THEN 'R2 UNRELATED_METRICS' WHEN ash <> bsh THEN 'R3 UNCOMPARABLE_SHAPE' WHEN au <> bu THEN 'R4 UNIT_MISMATCH'
  WHEN ac IS DISTINCT FROM bc THEN 'R5 CURRENCY_MISMATCH' WHEN (av AND NOT ai AND a0 IS DISTINCT FROM a1) OR (bv AND NOT bi AND b0 IS DISTINCT FROM b1) THEN 'R6 FORMULA_VERSION_STRADDLES' WHEN (av AND a1 IS NULL) OR (bv AND b1 IS NULL) THEN 'R6 FORMULA_VERSION_UNDECLARED' WHEN am = bm AND a1 <> b1 THEN 'R6 FORMULA_VERSION_MISMATCH'
  WHEN ax IS NULL OR bx IS NULL THEN 'R7 NOT_CANONICAL' WHEN claim = 'movement' AND round(abs(ax - bx), 9) <= tol THEN 'R8 WITHIN_PRESENTATION_TOLERANCE' WHEN claim = 'movement' AND abs(datediff('month', ba, aa)) <> CASE WHEN ash IN ('quarter', 'instant') THEN 3 ELSE 12 END THEN 'R10 SERIES_GAP' ELSE 'ok ok' END AS r FROM jj)
SELECT pairs, split_part(r, ' ', 1) AS rule, split_part(r, ' ', 2) AS reason, count(*) AS n FROM w GROUP BY ALL""",
    "series_moves": f"WITH {_STEPS} SELECT subject, metric_id, shape, period_key, earlier_key, delta, CASE WHEN unit <> 'percent' AND NOT crosses THEN rel END AS delta_pct, CASE WHEN unit = 'percent' THEN delta END AS delta_pp, arms AS fired_on, direction, array_to_string(warnings, ',') AS warnings FROM mv WHERE arms <> ''",
    "unmeasured_metrics": f"WITH {_BASE} SELECT metric_id, 'THRESHOLD_UNMEASURED' AS reason FROM metric_dim WHERE family IS NULL AND metric_id IN (SELECT metric_id FROM pt)",
    "value_floors": f"WITH {_STEPS} SELECT subject, metric_id, round(floor, 6) AS floor FROM fl",
    "series_reversals": f"""WITH {_STEPS} SELECT subject, metric_id, shape, period_key, delta, d1, d2, round(sigma, 4) AS sigma, population, first_key,
CASE WHEN sign <> 'unverified' THEN CASE WHEN (d2 > 0) = (sign = 'positive') THEN 'increase' ELSE 'decrease' END END AS prior_direction FROM rv""",
    "series_accelerations": f"WITH {_STEPS} SELECT subject, metric_id, shape, period_key, delta, d1, d2, first_key FROM ac",
    "series_distributions": f"WITH {_STEPS} SELECT subject, metric_id, shape, n, round(mean, 4) + 0::DOUBLE AS mean, round(sigma, 4) AS sigma, round(p90, 4) AS p90 FROM ds",
    "series_divergences": f"""WITH {_GAPS} SELECT subject, left_metric, right_metric, shape, period_key, gap + 0::DOUBLE AS gap, final AS verdict, round(z, 4) + 0::DOUBLE AS z, n, n_excluded, n_unresolved, relation, CASE WHEN mixed THEN 'cohort_vs_period_basis' END AS basis,
CASE WHEN final = 'ok' THEN round(sigma_without, 2) END AS sigma_without FROM dv""",
    "divergence_refusals": f"""WITH {_GAPS} SELECT left_metric, right_metric, split_part(verdict, ' ', 1) AS rule, split_part(verdict, ' ', 2) AS reason, count(*) AS n FROM g0 WHERE verdict <> 'ok' GROUP BY ALL
UNION ALL SELECT left_metric, right_metric, 'D4', CASE WHEN l.metric_id IS NULL OR r.metric_id IS NULL THEN 'SERIES_ABSENT' ELSE 'SIGN_CONVENTION_MISMATCH' END, 1 FROM pair_dim LEFT JOIN metric_dim l ON l.metric_id = left_metric LEFT JOIN metric_dim r ON r.metric_id = right_metric WHERE l.sign IS DISTINCT FROM r.sign""",
    "reading_agreement": f"""WITH {_BASE}, r2 AS (SELECT *, (SELECT max(version) FROM formula_dim f WHERE f.metric_id = reading.metric_id AND anchor BETWEEN f.valid_from::DATE AND coalesce(f.valid_to, '9999-12-31')::DATE) AS v, row_number() OVER (PARTITION BY metric_id, subject, period_key ORDER BY obs) AS i1,
  row_number() OVER (PARTITION BY subject, anchor ORDER BY obs) AS i2, row_number() OVER (PARTITION BY metric_id, period_key, scale ORDER BY obs) AS i3 FROM reading),
p AS (SELECT 'period_key' AS within, a, b FROM r2 a JOIN r2 b ON a.metric_id = b.metric_id AND a.subject = b.subject AND a.period_key = b.period_key AND a.i1 = b.i1 + 1
UNION ALL SELECT 'anchor', a, b FROM r2 a JOIN r2 b ON a.subject = b.subject AND a.anchor = b.anchor AND a.i2 = b.i2 + 1
UNION ALL SELECT 'scale', a, b FROM r2 a JOIN r2 b ON a.metric_id = b.metric_id AND a.period_key = b.period_key AND a.scale IS NOT DISTINCT FROM b.scale AND a.i3 = b.i3 + 1),
d AS (SELECT within, CASE WHEN a.subject <> b.subject THEN 'E1 SUBJECT_MISMATCH' WHEN a.metric_id <> b.metric_id THEN 'E2 METRIC_MISMATCH' WHEN a.period_key <> b.period_key THEN 'E3 PERIOD_MISMATCH' WHEN a.unit <> b.unit THEN 'E4 UNIT_MISMATCH' WHEN a.currency IS DISTINCT FROM b.currency THEN 'E5 CURRENCY_MISMATCH'
  WHEN a.v IS DISTINCT FROM b.v THEN 'E6 FORMULA_VERSION_MISMATCH' WHEN round(abs(a.value - b.value), 9) <= greatest(a.tol, b.tol) THEN 'same same' WHEN a.value * b.value < 0 THEN 'E7 OPPOSITE_SIGN' ELSE 'E7 VALUE_OUTSIDE_TOLERANCE' END AS x FROM p)
SELECT within, split_part(x, ' ', 1) AS rule, split_part(x, ' ', 2) AS reason, count(*) AS n FROM d GROUP BY ALL""",
    "series_scores": f"""WITH {_CAND} SELECT candidate_id, detector, subject, metric_id, period_key, score, array_to_string(list_filter([CASE WHEN tz IS NULL THEN 'z' END, CASE WHEN tu IS NULL THEN 'units' END], lambda x: x IS NOT NULL), ',') AS suppressed, round(tz, 6) AS term_z, round(tu, 6) AS term_units,
round(tc, 6) AS term_corroboration, round(tn, 6) AS term_novelty, round(tt, 6) AS term_recency, tw AS term_warnings, t1 AS term_single FROM sc""",
    "lineage_pairs": f"WITH {vocabulary.values('formula')}, {_COMP}, {_LINEAGE} SELECT a, b, CASE r WHEN 1 THEN 'component' WHEN 2 THEN 'shared_components' ELSE 'co_component' END AS relation FROM lin",
    "ranked_clusters": f"""WITH RECURSIVE {_CAND}, {_LINEAGE},
lk AS (SELECT x.candidate_id AS a, y.candidate_id AS b FROM sc x JOIN sc y ON x.subject = y.subject AND x.period_key = y.period_key LEFT JOIN lin ON lin.a = x.metric_id AND lin.b = y.metric_id WHERE x.metric_id = y.metric_id OR lin.r IS NOT NULL),
rc AS (SELECT a, b FROM lk UNION SELECT rc.a, lk.b FROM rc JOIN lk ON rc.b = lk.a), cl AS (SELECT a AS candidate_id, min(b) AS cluster FROM rc GROUP BY a),
tp AS (SELECT cluster, max(score) AS top FROM sc JOIN cl USING (candidate_id) GROUP BY cluster), pl AS (SELECT cluster, row_number() OVER (ORDER BY top DESC, cluster) AS cluster_rank FROM tp)
SELECT candidate_id, subject, period_key, score, cluster, cluster_rank FROM sc JOIN cl USING (candidate_id) JOIN pl USING (cluster)""",
    "change_operations": f"""WITH {_STEPS}, o AS (SELECT st.*, m.sign, unnest(['absolute_change', 'relative_change', 'basis_points', 'ratio']) AS op, unnest([delta, CASE WHEN st.unit <> 'percent' AND NOT (v1 = 0 OR (v1 < 0) <> (v2 < 0)) THEN round((v2 - v1) / abs(v1) * 100, 6) END,
  CASE WHEN st.unit = 'percent' THEN round((v2 - v1) * 100, 6) END, CASE WHEN v1 <> 0 THEN round(v2 / v1, 6) + 0::DOUBLE END]) AS result FROM st JOIN metric_dim m USING (metric_id))
SELECT subject, metric_id, shape, period_key, op, result, CASE op WHEN 'absolute_change' THEN CASE WHEN unit = 'percent' THEN 'percentage_points' ELSE unit END WHEN 'relative_change' THEN 'percent' WHEN 'ratio' THEN 'multiple' ELSE op END AS result_unit, v1 * v2 < 0 AS strict_crossing,
CASE WHEN sign <> 'unverified' THEN CASE WHEN delta = 0 THEN 'unchanged' WHEN (delta > 0) = (sign = 'positive') THEN 'increase' ELSE 'decrease' END END AS direction FROM o WHERE result IS NOT NULL""",
}
