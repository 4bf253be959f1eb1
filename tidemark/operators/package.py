"""Bounded packages of evidence and the checks of a draft against them.

A package's rows compete by total orders, so that the same rows are kept wherever they lie. Windows go by
package. A draft is sentences with numerals and citations; each check gives finding rows with a code, whose
severity a table of codes decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers


def round_robin(rows: DataFrame, package: list[str], slot: list[str], order: list[Column], most: int) -> DataFrame:
    """rows with `place` up to `most`: the best of every slot, slots in the order of their best, then the second of every slot, and so on."""
    key = F.row_number().over(Window.partitionBy(*package).orderBy(*order))
    ranked = rows.withColumn("_rank", key)
    ranked = ranked.withColumn("_depth", F.row_number().over(Window.partitionBy(*package, *slot).orderBy("_rank"))).withColumn("_slot", F.min("_rank").over(Window.partitionBy(*package, *slot)))
    place = F.row_number().over(Window.partitionBy(*package).orderBy("_depth", "_slot"))
    return ranked.withColumn("place", place).where(F.col("place") <= most).drop("_rank", "_depth", "_slot")


def sections_cut(rows: DataFrame, caps: DataFrame, order: list[Column]) -> DataFrame:
    """rows (package, section, ...) up to their section's cap; caps: section, cap."""
    place = F.row_number().over(Window.partitionBy("package", "section").orderBy(*order))
    return rows.withColumn("place", place).join(caps, "section").where("place <= cap").drop("cap")


def trimmed(rows: DataFrame, sections: DataFrame, budget: int) -> DataFrame:
    """rows (package, section, row_id, tokens, protected, rank) with `dropped`, and `fits` of their package.

    Rows go one at a time, sections in the order of `sections` (section, turn, least), within one the worst
    rank first, until the package's tokens fit. A protected row stays, and of each section its `least` best.
    A package that can't be made to fit says so. What goes is a prefix of the rows that may go, by running sums.
    """
    known = rows.join(sections, "section")
    best = F.row_number().over(Window.partitionBy("package", "section").orderBy("rank", "row_id"))
    known = known.withColumn("_best", best).withColumn("_may", ~F.col("protected") & (best > F.col("least")))
    total = F.sum("tokens").over(Window.partitionBy("package"))
    along = Window.partitionBy("package", "_may").orderBy("turn", F.desc("rank"), F.desc("row_id"))
    gone_before = F.coalesce(F.sum("tokens").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = known.withColumn("_total", total).withColumn("_gone", gone_before)
    known = known.withColumn("dropped", F.col("_may") & (F.col("_total") - F.col("_gone") > budget))
    kept = F.sum(F.when(~F.col("dropped"), F.col("tokens")).otherwise(0)).over(Window.partitionBy("package"))
    return known.withColumn("fits", kept <= budget).drop("_best", "_may", "_total", "_gone", "turn", "least")


def neighbours(primary: DataFrame, passages: DataFrame, reach: int) -> DataFrame:
    """(package, passage_id, role): primary passages, and those up to `reach` places away that aren't primary, each once.

    primary: package, document_id, ordinal. passages: passage_id, document_id, ordinal.
    """
    around = primary.select("package", "document_id", F.explode(F.sequence(F.col("ordinal") - reach, F.col("ordinal") + reach)).alias("ordinal"), F.col("ordinal").alias("_at"))
    role = around.groupBy("package", "document_id", "ordinal").agg(F.max(F.col("ordinal") == F.col("_at")).alias("_primary"))
    found = role.join(passages, ["document_id", "ordinal"])
    return found.select("package", "passage_id", F.when(F.col("_primary"), "primary").otherwise("context").alias("role"))


def offers(facts: DataFrame, package: str, refused: Column) -> DataFrame:
    """Pairs of a package's facts (structs a, b) by operation that is valid for them: a change needs one metric and two periods, a gap two metrics and one period, a ratio a divisor.

    facts: package, fact_id, metric_id, period, value, unit. `refused` is a condition on a and b that rules any of them out.
    """
    fact = F.struct("fact_id", "metric_id", "period", "value", "unit")
    a = facts.select(package, fact.alias("a"))
    b = facts.select(package, fact.alias("b"))
    pairs = a.join(b, package).where((F.col("a.fact_id") != F.col("b.fact_id")) & ~F.coalesce(refused, F.lit(False)))
    one, two = F.col("a"), F.col("b")
    change = (one["metric_id"] == two["metric_id"]) & (one["period"] < two["period"])
    gap = (one["metric_id"] < two["metric_id"]) & (one["period"] == two["period"]) & (one["unit"] == two["unit"])
    crossing = change & (one["value"] * two["value"] < 0)
    ops = F.array_compact(F.array(
        F.when(change, "absolute_change"), F.when(change & ~numbers.across_zero(one["value"], two["value"]), "relative_change"), F.when(gap, "gap"), F.when(gap & (two["value"] != 0), "ratio"), F.when(crossing, "zero_crossing"),
    ))
    return pairs.withColumn("op", F.explode(ops))


def computed(op: Column, a: Column, b: Column) -> Column:
    """Result of an operation on two values."""
    return (
        F.when(op.isin("absolute_change", "zero_crossing"), numbers.delta(a, b)).when(op == "relative_change", F.round(numbers.relative_change(a, b), 6))
        .when(op == "gap", F.round(a - b, numbers.PLACES)).when(op == "ratio", F.round(a / b, 6))
    )


def filled(template: Column, values: Column) -> Column:
    """A template with every {handle} in it replaced by its value from a map; an unknown handle stays."""
    parts = F.split(template, r"(?=\{)|(?<=\})")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\{[A-Z]\d+\}$"), F.coalesce(F.element_at(values, p), p)).otherwise(p)), "")


def anchors(rows: DataFrame) -> DataFrame:
    """(id, handle, start, end) of every literal that stands exactly once in its text, by itself (no letter, digit, minus sign, point or comma with a digit beside it), where no other literal overlaps it.

    rows: id, text, handle, literal. Overlap is told by the furthest end seen before, not by pairs.
    """
    # a hyphen behind a word isn't a sign
    quoted = F.concat(F.lit(r"(?<![\w.,])(?<!(?<!\w)-)\Q"), F.col("literal"), F.lit(r"\E(?!\w|[.,]\d)"))
    found = rows.where("length(literal) > 0").withColumn("n", F.regexp_count("text", quoted)).where("n = 1").withColumn("start", F.regexp_instr("text", quoted) - 1)
    spans = found.select("id", "handle", "start", (F.col("start") + F.length("literal")).alias("end"))
    along = Window.partitionBy("id").orderBy("start", "end", "handle")
    before = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    island = spans.withColumn("_new", F.when(before.isNull() | (F.col("start") >= before), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return island.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("id", "_island"))).where("_n = 1").select("id", "handle", "start", "end")


def uncovered(numerals: DataFrame, spans: DataFrame) -> DataFrame:
    """Numerals (id, start, end, ...) that no span (id, start, end) of their text contains."""
    s = spans.select(F.col("id").alias("_id"), F.col("start").alias("_from"), F.col("end").alias("_to"))
    inside = (F.col("id") == F.col("_id")) & (F.col("_from") <= F.col("start")) & (F.col("end") <= F.col("_to"))
    return numerals.join(s, inside, "left_anti")


def verdicts(drafts: DataFrame, findings: DataFrame, severities: DataFrame) -> DataFrame:
    """(draft_id, verdict, n_findings): refused by any finding that refuses or whose code is unknown, else warned, annotated or accepted."""
    known = findings.join(severities, "code", "left").withColumn("severity", F.coalesce("severity", F.lit("refuse")))
    weight = F.when(F.col("severity") == "refuse", 3).when(F.col("severity") == "warn", 2).otherwise(1)
    worst = known.groupBy("draft_id").agg(F.max(weight).alias("w"), F.count(F.lit(1)).alias("n"))
    name = F.element_at(F.array(*map(F.lit, ("annotated", "warned", "refused"))), F.col("w"))
    return drafts.select("draft_id").join(worst, "draft_id", "left").select("draft_id", F.coalesce(F.when(F.col("w").isNotNull(), name), F.lit("accepted")).alias("verdict"), F.coalesce("n", F.lit(0)).alias("n_findings"))
