"""Readings to canonical points, the comparability gate, and what moves in a series.

A reading is one printed value of a metric for a subject and a period. Readings of one slot (metric,
subject, period) are clustered by their tolerance; the slot's point is its one cluster, or one that twice as
many documents state, else a conflict without a value. A series holds the valued points of a subject, metric
and shape by their anchor date. All windows go by slot or by series, so that they grow with the length of a
series and not with the table. Dates are DATE columns; a period that isn't dated has the shape `other`.

Dimensions (formulas, families, metrics) are frames of a vocabulary; Spark chooses how to join them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers, periods

# Fixed values of the policy.
SHAPES = ("quarter", "instant", "fiscal_year", "ytd_6m", "ytd_9m")
FLOOR_SHARE, LEAST_DELTAS, LEAST_FOR_P90 = 0.1, 8, 4
SIGMAS, GROWTH, LEAST_Z, VARIANCE_FLOOR = 1.0, 1.5, 1.5, 2.0
WEIGHTS = {"z": 0.40, "units": 0.20, "corroboration": 0.15, "novelty": 0.10, "recency": 0.10, "warnings": -0.15, "single": -0.20, "repetition": -0.25}
Z_FULL, DOCS_FULL, QUARTERS_FULL, MOST_WARNINGS, FIRST_BONUS = 4.0, 5.0, 32.0, 4, 0.5
SLOT = ("metric_id", "subject", "period_key")
SERIES = ("subject", "metric_id", "shape")


def is_flattened_quote(quote: Column) -> Column:
    """Whether a quotation holds three numerals with no letter between, dates aside: a table that lost its columns."""
    day = r"(?i)\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},\s*\d{4}\b"
    marked = F.regexp_replace(F.translate(F.regexp_replace(quote, day, "DATE"), "#", ""), r"\d[\d,]*(?:\.\d+)?", "#")
    return F.coalesce(marked.rlike("#[^A-Za-z#]*#[^A-Za-z#]*#"), F.lit(False))


def canonicalize(readings: DataFrame) -> DataFrame:
    """One point a slot: status, value, its reading, support, filing dates and warnings.

    readings: observation_id, metric_id, subject, period_key, period_start, period_end, instant_date, shape,
    value, unit, currency, scale, document_id, filing_date, lane, quote.
    """
    narrative = F.col("lane") == "normalized_narrative"
    rows = readings.withColumn("defect", narrative & is_flattened_quote(F.col("quote"))).withColumn("unquoted", narrative & F.col("quote").isNull())
    rows = rows.withColumn("tolerance", numbers.tolerance(F.col("unit"), F.col("scale")))
    precision = F.when(F.col("scale").isin("units", "thousands"), 0).when(F.col("scale") == "millions", 1).otherwise(2)
    rows = rows.withColumn("order_key", F.struct(precision.alias("p"), F.coalesce("filing_date", F.lit("9999-12-31").cast("date")).alias("f"), F.col("observation_id").alias("o")))
    kept = rows.where(~F.col("defect"))
    along = Window.partitionBy(*SLOT).orderBy("value", "observation_id")
    apart = ~numbers.within(F.col("value"), F.lag("value").over(along), F.greatest("tolerance", F.lag("tolerance").over(along)))
    kept = kept.withColumn("breaks", F.coalesce(apart.cast("int"), F.lit(0))).withColumn("cluster", F.sum("breaks").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    clusters = kept.groupBy(*SLOT, "cluster").agg(
        F.count_distinct("document_id").alias("docs"), F.min("order_key").alias("best"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("observation_id")).alias("members"),
        F.min_by(F.struct("observation_id", "value", "unit", "currency", "scale", "tolerance"), "order_key").alias("reading"),
    )
    ranked = clusters.groupBy(*SLOT).agg(F.sort_array(F.collect_list(F.struct((-F.col("docs")).alias("minus"), "best", "docs", "n", "members", "reading"))).alias("c"))
    top, docs, next_docs = F.col("c")[0], F.col("c")[0]["docs"], F.get("c", F.lit(1))["docs"]
    status = F.when(F.size("c") == 1, "ok").when((docs >= 2) & (docs >= 2 * next_docs), "resolved_by_majority").otherwise("conflict")
    ranked = ranked.select(*SLOT, status.alias("status"), top.alias("top"), F.size("c").alias("n_clusters"))
    whole = rows.groupBy(*SLOT).agg(
        *(F.min(c).alias(c) for c in ("period_start", "period_end", "instant_date", "shape")), F.count(F.lit(1)).alias("n_readings"),
        F.count_if("defect").alias("n_quarantined"), F.max("unquoted").alias("unquoted"), F.count_distinct(F.when(~F.col("defect"), F.col("document_id"))).alias("n_docs"),
        F.count_distinct(F.when(~F.col("defect"), F.col("value"))).alias("n_values"), F.min(F.when(~F.col("defect"), F.col("filing_date"))).alias("first_filed"),
        F.max(F.when(~F.col("defect"), F.col("filing_date"))).alias("last_filed"), F.max(~F.col("defect") & F.col("filing_date").isNull()).alias("undated"),
        F.count_distinct(F.when(~F.col("defect"), F.coalesce("unit", F.lit("")))).alias("n_units"), F.count_distinct(F.when(~F.col("defect"), F.coalesce("currency", F.lit("")))).alias("n_currencies"),
        F.min("unit").alias("any_unit"), F.min("currency").alias("any_currency"),
    )
    out = whole.join(ranked, list(SLOT), "left")
    valued = F.col("status") != "conflict"
    warnings = F.array_compact(F.array(
        F.when(F.col("n_quarantined") > 0, "lane_defect"), F.when(F.col("unquoted"), "quarantine_not_evaluated"), F.when(F.col("n_units") > 1, "slot_unit_disagreement"),
        F.when(F.col("n_currencies") > 1, "slot_currency_disagreement"), F.when(F.col("undated"), "filing_date_unknown"), F.when(F.col("n_clusters") > 1, "minority_reading_present"),
    ))
    return out.select(
        *SLOT, "period_start", "period_end", "instant_date", "shape", F.coalesce("period_end", "instant_date").alias("anchor"), F.coalesce("status", F.lit("conflict")).alias("status"),
        *(F.when(valued, F.col("top.reading")[c]).alias(c) for c in ("value", "scale", "tolerance", "observation_id")), F.when(valued, F.col("top.members")).alias("support"),
        F.when(valued, F.col("top.reading.unit")).otherwise(F.col("any_unit")).alias("unit"), F.when(valued, F.col("top.reading.currency")).otherwise(F.col("any_currency")).alias("currency"),
        "n_docs", "n_readings", "n_quarantined", "n_values", F.coalesce("n_clusters", F.lit(0)).alias("n_clusters"), "first_filed", "last_filed", F.array_sort(warnings).alias("warnings"),
    )


def with_versions(points: DataFrame, formulas: DataFrame) -> DataFrame:
    """Points with `versioned`, and the formula in force at their anchor, start and end; null where none is. Of overlapping ones the last begun holds."""
    dated = formulas.select("metric_id", F.struct(F.col("valid_from").cast("date").alias("since"), F.coalesce(F.col("valid_to").cast("date"), F.lit("9999-12-31").cast("date")).alias("until"), "version", F.split("components", ",").alias("components")).alias("f"))
    known = dated.groupBy("metric_id").agg(F.sort_array(F.collect_list("f"), asc=False).alias("formulas"))

    def at(day: Column) -> Column:
        return F.get(F.filter("formulas", lambda f: day.between(f["since"], f["until"])), F.lit(0))

    rows = points.join(known, "metric_id", "left")
    return rows.select(
        *points.columns, F.col("formulas").isNotNull().alias("versioned"), at(F.col("anchor"))["version"].alias("version"), at(F.col("anchor"))["components"].alias("components"),
        at(F.col("period_start"))["version"].alias("start_version"), at(F.col("period_end"))["version"].alias("end_version"),
    )


def refusal(left: Column, right: Column, claim: str, related: Column | None = None) -> Column:
    """(rule, reason) of the first rule that refuses to compare two points (structs with versions); null if they compare.

    A level needs subject, metric, shape, unit, currency, formula and a value on both sides. A movement also
    needs a difference beyond the coarser tolerance and consecutive points, given as neighbours of one
    series. A divergence may name two metrics that `related` says belong together.
    """
    no = lambda rule, reason, when: F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(reason).alias("reason")))
    same = left["metric_id"] == right["metric_id"]
    straddles = lambda p: p["versioned"] & p["period_start"].isNotNull() & p["period_end"].isNotNull() & ~p["start_version"].eqNullSafe(p["end_version"])
    # across metrics each keeps its own formulas, so dates alone can differ there, and those are equal in a pair of one period
    undeclared = (left["versioned"] & left["version"].isNull()) | (right["versioned"] & right["version"].isNull())
    rules = [no("R1", "SUBJECT_MISMATCH", left["subject"] != right["subject"])]
    if claim == "divergence":
        rules.append(no("R2", "UNRELATED_METRICS", ~same & ~F.coalesce(related, F.lit(False))))
    else:
        rules.append(no("R2", "METRIC_MISMATCH", ~same))
    rules += [
        no("R3", "UNCOMPARABLE_SHAPE", (left["shape"] == "other") | (right["shape"] == "other") | (left["shape"] != right["shape"])),
        no("R4", "UNIT_MISMATCH", ~left["unit"].eqNullSafe(right["unit"])),
        no("R5", "CURRENCY_MISMATCH", ~left["currency"].eqNullSafe(right["currency"])),
        no("R6", "FORMULA_VERSION_STRADDLES", straddles(left) | straddles(right)),
        no("R6", "FORMULA_VERSION_UNDECLARED", undeclared),
        no("R6", "FORMULA_VERSION_MISMATCH", same & left["versioned"] & (left["version"] != right["version"])),
        no("R7", "NOT_CANONICAL", left["value"].isNull() | right["value"].isNull()),
    ]
    if claim == "movement":
        rules += [
            no("R8", "WITHIN_PRESENTATION_TOLERANCE", numbers.within(left["value"], right["value"], F.greatest(left["tolerance"], right["tolerance"]))),
            no("R10", "SERIES_GAP", ~F.abs(periods.months_between(right["anchor"], left["anchor"])).eqNullSafe(periods.step_months(left["shape"]))),
        ]
    return F.coalesce(*rules)


def basis_warning(left: Column, right: Column, cohort_left: Column, cohort_right: Column) -> Column:
    """Disclosure where a cohort measure is held against a period measure."""
    return F.when((left["metric_id"] != right["metric_id"]) & (cohort_left != cohort_right), "cohort_vs_period_basis")


def steps(points: DataFrame, formulas: DataFrame) -> DataFrame:
    """Each valued point of a series with the one before it, their delta, and why the step is refused, if it is."""
    rows = with_versions(points, formulas).where((F.col("status") != "conflict") & F.col("shape").isin(*SHAPES))
    point = F.struct(*rows.columns)
    along = Window.partitionBy(*SERIES).orderBy("anchor", "period_key")
    pairs = rows.select(*SERIES, point.alias("later"), F.lag(point).over(along).alias("earlier")).where("earlier IS NOT NULL")
    pairs = pairs.withColumn("refused", refusal(F.col("later"), F.col("earlier"), "movement")).withColumn("delta", numbers.delta(F.col("earlier.value"), F.col("later.value")))
    broken = F.count_if(F.col("refused").isNotNull()).over(Window.partitionBy(*SERIES).orderBy("later.anchor", "later.period_key").rowsBetween(Window.unboundedPreceding, 0))
    return pairs.withColumn("run", broken)


def floors(points: DataFrame) -> DataFrame:
    """A tenth of the median size of a metric's valued points over all shapes, by subject."""
    return points.where("status <> 'conflict'").groupBy("subject", "metric_id").agg((F.lit(FLOOR_SHARE) * F.percentile(F.abs("value"), 0.5)).alias("floor"))


def direction(sign: Column, delta: Column) -> Column:
    """increase, decrease or unchanged of the quantity; null where its sign of storage isn't known."""
    up = F.when(sign == "positive", delta > 0).otherwise(delta < 0)
    return F.when(sign.isin("positive", "negative"), F.when(F.round(delta, numbers.PLACES) == 0, "unchanged").when(up, "increase").otherwise("decrease"))


def measured(stepped: DataFrame, points: DataFrame, metrics: DataFrame, families: DataFrame) -> DataFrame:
    """Comparable steps with their relative size, the arms that fire and their direction.

    Percentages fire on points, other units on percent of a base that reaches the floor; either on the
    absolute change. The published percentage is null across zero. A metric without a family measures nothing.
    """
    rows = stepped.where("refused IS NULL").join(floors(points), ["subject", "metric_id"]).join(metrics.select("metric_id", "family", "sign"), "metric_id").join(families, "family")
    before, after, delta = F.col("earlier.value"), F.col("later.value"), F.col("delta")
    percent = F.col("earlier.unit") == "percent"
    relative = F.when((F.abs(before) > 0) & (F.abs(before) >= F.col("floor")), F.round(delta / F.abs(before) * 100, numbers.PLACES))
    rows = rows.withColumn("relative", relative)
    arms = F.array_compact(F.array(
        F.when(percent & (F.abs(delta) >= F.col("pct_min")), "pp"), F.when(~percent & (F.abs("relative") >= F.col("pct_min")), "pct"), F.when(F.abs(delta) >= F.col("abs_min"), "abs"),
    ))
    crosses = numbers.across_zero(before, after)
    return rows.select(
        *SERIES, "earlier", "later", "delta", "run", "sign", F.when(~percent & ~crosses, F.col("relative")).alias("delta_pct"), F.when(percent, delta).alias("delta_pp"), arms.alias("arms"), direction(F.col("sign"), delta).alias("direction"),
        F.array_sort(F.array_distinct(F.concat(F.col("earlier.warnings"), F.col("later.warnings"), F.array_compact(F.array(F.when(crosses, "relative_change_across_zero"), F.when(F.col("sign") == "unverified", "metric_sign_convention_unverified")))))).alias("warnings"),
    )


def unmeasured(points: DataFrame, metrics: DataFrame) -> DataFrame:
    """Metrics with points but without a family of thresholds."""
    return points.select("metric_id").distinct().join(metrics.where("family IS NULL").select("metric_id"), "metric_id").withColumn("reason", F.lit("THRESHOLD_UNMEASURED"))


def distributions(stepped: DataFrame) -> DataFrame:
    """Population, mean, spread and 90th percentile of comparable deltas by series; the percentile from four, by linear interpolation."""
    ok = stepped.where("refused IS NULL").groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("n"), F.avg("delta").alias("mean"), F.stddev_pop("delta").alias("sigma"), F.percentile(F.abs("delta"), 0.9).alias("p"), F.max(F.greatest("later.tolerance", "earlier.tolerance")).alias("tolerance"),
    )
    return ok.select(*SERIES, "n", "mean", "sigma", F.when(F.col("n") >= LEAST_FOR_P90, F.col("p")).alias("p90"), "tolerance")


def _in_run(stepped: DataFrame) -> DataFrame:
    """Comparable steps with the two deltas before them in their run."""
    along = Window.partitionBy(*SERIES, "run").orderBy("later.anchor", "later.period_key")
    return stepped.where("refused IS NULL").withColumn("d1", F.lag("delta", 1).over(along)).withColumn("d2", F.lag("delta", 2).over(along)).withColumn("first_key", F.lag("earlier.period_key", 2).over(along))


def reversals(stepped: DataFrame, moves: DataFrame, points: DataFrame) -> DataFrame:
    """Steps against the sign of the two before them, of a spread or more, that also fire as moves, in series of enough spread."""
    coarse = points.where("status <> 'conflict'").groupBy(*SERIES).agg(F.max("tolerance").alias("coarsest"))
    spread = distributions(stepped).where(F.col("n") >= LEAST_DELTAS).join(coarse, list(SERIES)).where("sigma >= coarsest").select(*SERIES, "sigma", "n")
    rows = _in_run(stepped).where("d1 <> 0 AND d2 <> 0 AND delta <> 0 AND signum(d1) = signum(d2) AND signum(d1) <> signum(delta)")
    rows = rows.select(*SERIES, F.col("later.period_key").alias("period_key"), "d1", "d2", "first_key").join(spread, list(SERIES))
    fired = moves.where(F.size("arms") > 0).withColumn("period_key", F.col("later.period_key"))
    return fired.join(rows, [*SERIES, "period_key"]).where(F.round(F.abs("delta") - F.lit(SIGMAS) * F.col("sigma"), 6) >= 0)


def accelerations(stepped: DataFrame) -> DataFrame:
    """Three deltas of one sign, each larger than the one before, the last one and a half times the first."""
    grows = (F.signum("d2") == F.signum("d1")) & (F.signum("d1") == F.signum("delta")) & (F.abs("d2") < F.abs("d1")) & (F.abs("d1") < F.abs("delta"))
    return _in_run(stepped).where(grows & (F.col("delta") != 0) & (F.round(F.abs("delta") - GROWTH * F.abs("d2"), numbers.PLACES) >= 0))


def relation(left: Column, right: Column, left_parts: Column, right_parts: Column, co_parts: Column, groups: Column) -> Column:
    """How two metrics belong together, closest first: component, shared components, components of one formula, one group."""
    empty = F.array().cast("array<string>")
    a, b = F.coalesce(left_parts, empty), F.coalesce(right_parts, empty)
    return (
        F.when(F.array_contains(a, right) | F.array_contains(b, left), "component").when(F.arrays_overlap(a, b), "shared_components")
        .when(F.coalesce(co_parts, F.lit(False)), "co_component").when(F.coalesce(groups, F.lit(False)), "distinct_group")
    )


def co_components(formulas: DataFrame) -> DataFrame:
    """(a, b) of metrics that stand in one formula's list."""
    parts = formulas.select("version", F.explode(F.split("components", ",")).alias("part"))
    return parts.alias("x").join(parts.alias("y"), F.col("x.version") == F.col("y.version")).where("x.part <> y.part").select(F.col("x.part").alias("a"), F.col("y.part").alias("b")).distinct()


def gaps(points: DataFrame, formulas: DataFrame, metrics: DataFrame, pairs: DataFrame) -> DataFrame:
    """Levels of declared pairs in the same period with their gap, relation, and why they are refused, if they are."""
    known = metrics.select("metric_id", "sign", "cohort", "group_id")
    side = lambda m: known.select(F.col("metric_id").alias(f"{m}_metric"), F.col("sign").alias(f"{m}_sign"), F.col("cohort").alias(f"{m}_cohort"), F.col("group_id").alias(f"{m}_group"))
    named = pairs.join(side("left"), "left_metric").join(side("right"), "right_metric").where("left_sign = right_sign")
    named = named.join(co_components(formulas).withColumn("co", F.lit(True)), (F.col("left_metric") == F.col("a")) & (F.col("right_metric") == F.col("b")), "left").drop("a", "b")
    named = named.withColumn("one_group", F.coalesce(F.col("left_group") == F.col("right_group"), F.lit(False))).withColumn("co", F.coalesce("co", F.lit(False)))
    rows = with_versions(points, formulas).where(F.col("shape").isin(*SHAPES))
    lefts = rows.select(F.col("metric_id").alias("left_metric"), "subject", "period_key", "shape", F.struct(*rows.columns).alias("l")).join(named, "left_metric")
    rights = rows.select(F.col("metric_id").alias("right_metric"), "subject", "period_key", F.struct(*rows.columns).alias("r"))
    both = lefts.join(rights, ["right_metric", "subject", "period_key"])
    both = both.withColumn("refused", refusal(F.col("l"), F.col("r"), "divergence", F.col("one_group") | F.col("co")))
    return both.select(
        "subject", "left_metric", "right_metric", "shape", "period_key", "refused", F.round(F.col("l.value") - F.col("r.value"), numbers.PLACES).alias("gap"), F.greatest("l.tolerance", "r.tolerance").alias("tolerance"),
        F.col("l.anchor").alias("anchor"), F.col("l.version").alias("left_version"), F.col("r.version").alias("right_version"), F.col("l.n_docs").alias("left_docs"), F.col("r.n_docs").alias("right_docs"), F.col("l.currency").alias("currency"),
        relation(F.col("left_metric"), F.col("right_metric"), F.col("l.components"), F.col("r.components"), F.col("co"), F.col("one_group")).alias("relation"),
        basis_warning(F.col("l"), F.col("r"), F.col("left_cohort"), F.col("right_cohort")).alias("basis"), F.col("left_sign").alias("sign"),
    )


def divergences(gapped: DataFrame) -> DataFrame:
    """Every gap against those comparable with it (same formulas on either side, itself included): z, spread with and without it, and a verdict.

    The spread of the others follows from the sums, so that no gap meets every other one.
    """
    by = Window.partitionBy("subject", "left_metric", "right_metric", "shape")
    unresolved = F.count_if(F.col("refused.rule") == "R7").over(by)
    rows = gapped.withColumn("n_unresolved", unresolved).where("refused IS NULL").withColumn("n_gaps", F.count(F.lit(1)).over(by))
    like = Window.partitionBy("subject", "left_metric", "right_metric", "shape", "left_version", "right_version", "currency")
    rows = rows.select("*", F.count(F.lit(1)).over(like).alias("n"), F.avg("gap").over(like).alias("mean"), F.stddev_pop("gap").over(like).alias("sigma"), (VARIANCE_FLOOR * F.max("tolerance").over(like)).alias("least"))
    n, away = F.col("n"), F.col("gap") - F.col("mean")
    rest = F.when(n > 2, F.sqrt(F.greatest(F.lit(0.0), (n * F.col("sigma") * F.col("sigma") - away * away * n / (n - 1)) / (n - 1)))).otherwise(F.lit(0.0))
    rows = rows.withColumn("sigma_without", rest).withColumn("z", F.when(F.col("sigma") > 0, away / F.col("sigma")))
    verdict = (
        F.when(n < LEAST_DELTAS, "POPULATION_TOO_SMALL").when((F.col("sigma") < F.col("least")) | (F.col("sigma_without") < F.col("least")), "LOW_VARIANCE_PRESENTATION_NOISE")
        .when(F.abs("z") < LEAST_Z, "WITHIN_SPREAD").when(F.col("relation").isNull(), "RELATION_UNDECLARED").otherwise("ok")
    )
    return rows.withColumn("n_excluded", F.col("n_gaps") - n).withColumn("verdict", verdict)


def disagreement(left: Column, right: Column) -> Column:
    """(rule, reason) of the first way in which two readings (structs with versions) aren't one; null if they are one reading."""
    no = lambda rule, reason, when: F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(reason).alias("reason")))
    dates = [~left[c].eqNullSafe(right[c]) for c in ("period_key", "period_start", "period_end", "instant_date", "shape")]
    other = (left["shape"] == "other") | (right["shape"] == "other")
    points = left["unit"].isin("percent", "percentage_points") & right["unit"].isin("percent", "percentage_points")
    near = numbers.within(left["value"], right["value"], F.greatest(numbers.tolerance(left["unit"], left["scale"]), numbers.tolerance(right["unit"], right["scale"])))
    opposed = (left["value"] != 0) & (right["value"] != 0) & ((left["value"] > 0) != (right["value"] > 0))
    return F.coalesce(
        no("E1", "SUBJECT_MISMATCH", left["subject"] != right["subject"]), no("E2", "METRIC_MISMATCH", left["metric_id"] != right["metric_id"]), no("E3", "UNCOMPARABLE_SHAPE", other),
        no("E3", "PERIOD_MISMATCH", dates[0] | dates[1] | dates[2] | dates[3] | dates[4]), no("E4b", "PERCENT_VERSUS_PERCENTAGE_POINTS", (left["unit"] != right["unit"]) & points),
        no("E4", "UNIT_MISMATCH", ~left["unit"].eqNullSafe(right["unit"])), no("E5", "CURRENCY_MISMATCH", ~left["currency"].eqNullSafe(right["currency"])),
        no("E6", "FORMULA_VERSION_MISMATCH", left["versioned"] & ~left["version"].eqNullSafe(right["version"])), no("E7", "OPPOSITE_SIGN", ~near & opposed), no("E7", "VALUE_OUTSIDE_TOLERANCE", ~near),
    )


def score(candidates: DataFrame, spreads: DataFrame, pinned: str) -> DataFrame:
    """Candidates (candidate_id, detector, subject, metric_id, shape, anchor, period_key, delta, z, n_docs, n_warnings, first_negative, repetition) with their terms and score.

    A term that can't be told is null and named in `suppressed`; every rounded term counts by its weight.
    """
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    rows = candidates.join(spreads.select(*SERIES, "n", "mean", "sigma", "p90"), list(SERIES), "left")
    own = F.when((F.col("n") >= LEAST_DELTAS) & (F.col("sigma") > 0), F.abs((F.col("delta") - F.col("mean")) / F.col("sigma")))
    z = F.coalesce(F.abs("z"), own)
    units = F.when(F.col("z").isNull() & (F.col("p90") > 0), F.abs("delta") / F.col("p90"))
    before = F.row_number().over(Window.partitionBy("detector", "subject", "metric_id").orderBy("anchor", "period_key", "candidate_id")) - 1
    months = periods.months_between(F.col("anchor"), F.lit(pinned).cast("date"))
    terms = {
        "z": clip(z / Z_FULL), "units": clip(units), "corroboration": clip(F.col("n_docs") / DOCS_FULL), "novelty": clip(F.lit(1.0) / (F.lit(1.0) + before) + F.when(F.col("first_negative"), FIRST_BONUS).otherwise(0.0)),
        "recency": clip(F.lit(1.0) - months / 3.0 / QUARTERS_FULL), "warnings": F.least(F.col("n_warnings"), F.lit(MOST_WARNINGS)).cast("double"),
        "single": (F.col("n_docs") == 1).cast("double"), "repetition": clip(F.coalesce("repetition", F.lit(0.0))),
    }
    rows = rows.withColumns({f"t_{name}": F.round(term, numbers.PLACES) for name, term in terms.items()})
    total = F.round(sum((F.round(F.coalesce(f"t_{name}", F.lit(0.0)) * weight, numbers.PLACES) for name, weight in WEIGHTS.items()), F.lit(0.0)), numbers.PLACES)
    suppressed = F.array_compact(F.array(*(F.when(F.col(f"t_{name}").isNull(), name) for name in WEIGHTS)))
    return rows.withColumn("score", total).withColumn("suppressed", suppressed)
