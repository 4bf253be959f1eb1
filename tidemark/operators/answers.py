"""Recorded answers as claims or coded refusals, prose surfaces, cells of flattened tables, filters that say why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers, periods, text
from .tables import first_words

SCHEMA = "metric string, subject string, span string, value double, scale string, period string"


def first_code(*checks: tuple[str, Column]) -> Column:
    """The code of the first check that fails, null if none does; a check that is null doesn't fail."""
    return F.coalesce(*(F.when(F.coalesce(when, F.lit(False)), code) for code, when in checks))


def mapped(rows: DataFrame, metrics: DataFrame) -> DataFrame:
    """Answers (answer: JSON text, passage, scope: array of metrics, subject) with `outcome`, the first refusal or ok, and the claim's value and period.

    In order: an answer that is none, a metric out of scope, one of another lane, another subject, a span that
    the passage doesn't hold, a value that the span doesn't print, a span that names nothing, a scale that
    isn't printed, a period that doesn't resolve.
    """
    said = rows.withColumn("a", F.from_json("answer", SCHEMA, {"mode": "PERMISSIVE"})).withColumn("_m", F.col("a.metric"))
    known = said.join(metrics.select(F.col("metric_id").alias("_m"), "unit", "period_type", "family"), "_m", "left")
    printed = numbers.printed_magnitude(F.col("a.span"))
    known = known.withColumn("printed", printed).withColumn("period", periods.phrase_period(F.col("a.period")))
    scale = F.coalesce(F.col("printed.scale"), F.lit("units"))
    outcome = first_code(
        ("NO_ANSWER", F.col("a").isNull() | F.col("a.metric").isNull()), ("OUT_OF_SCOPE", ~F.coalesce(F.array_contains("scope", F.col("a.metric")), F.lit(False))), ("OTHER_LANE", F.col("family").isNull()),
        ("OTHER_SUBJECT", ~F.col("a.subject").eqNullSafe(F.col("subject"))), ("SPAN_NOT_IN_PASSAGE", ~F.coalesce(F.contains("passage", F.col("a.span")), F.lit(False))), ("VALUE_NOT_IN_SPAN", ~F.col("printed.value").eqNullSafe(F.col("a.value"))),
        ("SPAN_NAMES_NOTHING", ~numbers.names_its_subject(F.col("a.span"))), ("SCALE_NOT_PRINTED", F.coalesce("a.scale", F.lit("units")) != scale), ("PERIOD_UNRESOLVED", F.col("period").isNull()),
    )
    p = F.col("period")
    return known.withColumn("outcome", F.coalesce(outcome, F.lit("ok"))).withColumn("claimed", F.when(F.col("outcome") == "ok", F.col("a.value") * numbers.scale_factor(scale))).withColumn("period_key", F.when(F.col("outcome") == "ok", periods.key(p["start"], p["end"], p["instant"])))


def longest_surfaces(hits: DataFrame) -> DataFrame:
    """Spans (id, surface, start, end, ...) less those that end no further than one that began before or at the same place and is longer; of equal spans the first by name stays."""
    before = Window.partitionBy("id").orderBy("start", F.desc("end"), "surface").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("end").over(before)
    return hits.withColumn("_reach", reach).where(F.col("_reach").isNull() | (F.col("end") > F.col("_reach"))).drop("_reach")


def placed_surfaces(texts: DataFrame, surfaces: DataFrame) -> DataFrame:
    """(id, surface, metric_id, start, end): the first place of every surface as a whole phrase, found by the first word of the surface.

    texts: id, text (folded, in lower case).
    """
    found = first_words(texts.select("id", "text"), "text", surfaces).withColumn("at", text.phrase_at(F.col("text"), F.col("surface"))).where("at > 0")
    return found.select("id", "surface", "metric_id", (F.col("at") - 1).alias("start"), (F.col("at") - 1 + F.length("surface")).alias("end"))


def cell_span(body: Column, row: Column, col: Column) -> Column:
    """(text, start, end) of a cell in a text of pipe rows, by line and place between pipes (both from 0); null outside."""
    lines = F.split(body, "\n")
    line = F.get(lines, row)
    parts = F.split(line, r"\|")
    cell = F.get(parts, col + 1)
    before = F.aggregate(F.slice(lines, 1, row), F.lit(0), lambda a, x: a + F.length(x) + 1)
    inner = F.aggregate(F.slice(parts, 1, col + 1), F.lit(0), lambda a, x: a + F.length(x) + 1)
    start = before + inner + F.length(cell) - F.length(F.ltrim(cell))
    return F.when((col + 2 < F.size(parts)) & cell.isNotNull(), F.struct(F.trim(cell).alias("text"), start.alias("start"), (start + F.length(F.trim(cell))).alias("end")))


def filtered(rows: DataFrame, order: list[Column], limit: int, **filters: Column) -> DataFrame:
    """rows with `excluded_because` (the first filter that fails) and `shown`: the first of the others by order, up to a limit."""
    reason = F.coalesce(*(F.when(~F.coalesce(holds, F.lit(False)), name) for name, holds in filters.items()))
    known = rows.withColumn("excluded_because", reason)
    top = known.where("excluded_because IS NULL").orderBy(*order).limit(limit).select("candidate_id").withColumn("shown", F.lit(True))
    return known.join(top, "candidate_id", "left").withColumn("shown", F.coalesce("shown", F.lit(False)))


def search_terms(aliases: Column, keys: Column, most: int = 6, least: int = 4) -> Column:
    """Terms to search by: aliases first, then periods, each once and long enough, up to a bound."""
    every = F.array_distinct(F.concat(F.coalesce(aliases, F.array().cast("array<string>")), F.coalesce(keys, F.array().cast("array<string>"))))
    return F.slice(F.filter(every, lambda t: F.length(t) >= least), 1, most)
