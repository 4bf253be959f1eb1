"""Queries that read printed numbers, periods and names, over texts printed from the columns of the tables.

The tables hold numbers and dates, not filings, so each query first prints a column the way filings print it
and then reads the text back through the functions. The SQL beside it never sees the text: it tells the
result from the columns that were printed, so that the two share nothing but the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, periods, text
from ..sources.tables import read

#: DuckDB's name for a month as it is printed.
_MONTH = "strftime({0}, '%B')"


def _choose(kind: Column, *choices: Column | str) -> Column:
    return F.coalesce(*(F.when(kind == i, c if isinstance(c, Column) else F.lit(c)) for i, c in enumerate(choices)))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem")
    return rows.withColumn("whole", F.floor("l_extendedprice").cast("long")).withColumn("grouped", F.format_number(F.col("whole"), 0))


def number_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of accounting tables as numbers."""
    rows = _lines(spark, sf_dir)
    grouped = F.col("grouped")
    cell = _choose(
        (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 10, F.concat(F.lit("$ "), grouped), F.concat(F.lit("("), grouped, F.lit(")")), F.concat(F.lit("$("), grouped, F.lit(")")), "—",
        F.concat((F.col("l_quantity") / 2).cast("string"), F.lit("%")), "n/a", "12,34", F.concat(F.lit(" "), F.col("whole").cast("string"), F.lit(".50 ")), F.concat(F.lit("-"), grouped), F.concat(F.lit("Â"), grouped, F.lit(" ")),
    )
    rows = rows.withColumn("cell", cell)
    return rows.select("l_orderkey", "l_linenumber", numbers.magnitude(F.col("cell")).alias("value"), numbers.is_nil(F.col("cell")).alias("nil"), numbers.strict_number(F.col("cell")).alias("strict"))


def scale_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared scales and the rows exempt from them."""
    rows = _orders(spark, sf_dir)
    heading = _choose(F.col("o_orderkey") % 5, "(In thousands, except percentages and homes sold)", "dollars in millions", "(in billions, except number of markets)", "no scale here", "in thousands of millions, in millions")
    label = _choose(F.col("o_custkey") % 5, "Homes sold in period", "Gross margin %", "Number of markets", "Net revenue", "")
    found = numbers.scale_declaration(heading)
    return rows.select(
        "o_orderkey", found["scale"].alias("scale"), found["exceptions"].alias("exceptions"), numbers.scale_excludes(found["exceptions"], label).alias("exempt"),
        (F.floor("o_totalprice") * numbers.scale_factor(F.when(~numbers.scale_excludes(found["exceptions"], label), found["scale"]))).alias("value"),
    )


def prose_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money, percent and single figures in sentences."""
    rows = _orders(spark, sf_dir).withColumn("k", F.col("o_orderkey") % 6).withColumn("n", F.floor("o_totalprice").cast("long"))
    grouped = F.format_number(F.col("n"), 0)
    sentence = _choose(
        F.col("k"), F.concat(F.lit("Revenue was $"), grouped, F.lit(" million for the year")), F.concat(F.lit("a loss of $("), grouped, F.lit(") thousand")), F.concat(F.lit("or "), (F.col("n") % 100).cast("string"), F.lit(".5% gross margin (GAAP)")),
        F.concat(F.lit("from $"), grouped, F.lit(" to $2 billion")), F.concat(F.lit("to "), grouped), "nothing printed here",
    )
    rows = rows.withColumn("s", sentence)
    s = F.col("s")
    return rows.select(
        "o_orderkey", numbers.money_phrase(s)["value"].alias("money"), numbers.percent_phrase(s)["value"].alias("percent"), numbers.printed_magnitude(s)["value"].alias("single"),
        numbers.printed_magnitude(s)["scale"].alias("scale"), numbers.names_its_subject(s).alias("named"),
    )


def resolved_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a table header as periods, or refused."""
    rows = _orders(spark, sf_dir).withColumn("k", F.col("o_orderkey") % 8)
    end = F.last_day("day")
    year, month_day, full = F.date_format(end, "yyyy"), F.date_format(end, "MMMM d,"), F.date_format(end, "MMMM d, yyyy")
    label = _choose(F.col("k"), year, full, year, year, F.concat(F.quarter("day").cast("string"), F.lit("Q"), F.date_format("day", "yy")), year, F.concat(F.lit("Nine Months Ended "), full), full)
    heading = _choose(F.col("k"), F.concat(F.lit("Three Months Ended "), month_day), "Year Ended", F.concat(F.lit("Six Months Ended "), month_day), month_day, "", "", "", "")
    row_label = F.when(F.col("k") == 2, "Open orders (at period end)").otherwise("Net revenue")
    found = periods.resolve(label, heading, row_label)
    start, stop, instant = found["start"], found["end"], found["instant"]
    return rows.select("o_orderkey", start.cast("string").alias("period_start"), stop.cast("string").alias("period_end"), instant.cast("string").alias("instant_date"), periods.shape(start, stop, instant).alias("shape"))


def period_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Period phrases of a passage, and headings that lost their columns."""
    rows = _orders(spark, sf_dir)
    end, before = F.last_day("day"), F.last_day(F.add_months("day", -12))
    ended, was = F.date_format(end, "MMMM d, yyyy"), F.date_format(before, "MMMM d, yyyy")
    short = F.concat(F.quarter("day").cast("string"), F.lit("Q"), F.date_format("day", "yy"))
    passage = _choose(
        F.col("o_orderkey") % 4, F.concat(F.lit("For the three months ended  "), ended, F.lit(" and "), ended, F.lit(" sales rose.")), F.concat(ended, F.lit(", "), was, F.lit(" "), short, F.lit(" Revenue")),
        F.concat(F.lit("In "), short, F.lit(" we grew; in "), short, F.lit(" we grew again.")), "No period at all.",
    )
    return rows.select("o_orderkey", F.array_join(periods.phrases(passage), "; ").alias("phrases"), periods.is_flattened_grid(passage).alias("flattened"))


def printed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed calendar dates, among them days that don't exist."""
    rows = _orders(spark, sf_dir)
    line = _choose(
        F.col("o_orderkey") % 4, F.concat(F.lit("SAN FRANCISCO, "), F.date_format("day", "MMM. d, yyyy"), F.lit(" (WIRE)")), F.concat(F.lit("On "), F.date_format("day", "MMMM d yyyy"), F.lit(" the board met")),
        F.concat(F.lit("February 30, "), F.date_format("day", "yyyy")), "undated",
    )
    return rows.select("o_orderkey", periods.printed_date(line).cast("string").alias("day"))


def period_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape, key and steps of periods given by dates."""
    rows = _orders(spark, sf_dir).withColumn("k", F.col("o_orderkey") % 7)
    first, year = F.trunc("day", "quarter"), F.trunc("day", "year")
    none = F.lit(None).cast("date")
    start = _choose(F.col("k"), first, year, year, year, F.col("day"), none, first)
    end = _choose(F.col("k"), F.last_day(F.add_months(first, 2)), F.last_day(F.add_months(year, 11)), F.last_day(F.add_months(year, 5)), F.last_day(F.add_months(year, 8)), F.last_day("day"), none, F.last_day(F.add_months(first, 3)))
    instant = F.when(F.col("k") == 5, F.col("day"))
    shape = periods.shape(start, end, instant)
    return rows.select(
        "o_orderkey", shape.alias("shape"), periods.key(start, end, instant).alias("period_key"), periods.step_months(shape).alias("step"),
        periods.months_between(F.lit("1995-03-31").cast("date"), F.coalesce(end, instant)).cast("int").alias("months"),
    )


def numeral_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All numerals of a sentence with sign, unit and significant figures."""
    rows = _lines(spark, sf_dir)
    sentence = F.concat(
        F.lit("Sales of $"), F.col("grouped"), F.lit(" million fell ("), F.col("l_quantity").cast("int").cast("string"), F.lit(".50%) or -"), F.col("l_linenumber").cast("string"),
        F.lit("00 basis points, "), F.col("l_linenumber").cast("string"), F.lit(".2x and 3 percentage points"),
    )
    token = F.explode(numbers.numerals(sentence)).alias("t")
    out = rows.select("l_orderkey", "l_linenumber", token)
    return out.select("l_orderkey", "l_linenumber", F.col("t.at").alias("place"), F.col("t.value").alias("value"), F.col("t.unit").alias("unit"), F.col("t.figures").alias("figures"), F.col("t.negative").alias("negative"))


def printed_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a figure rounded to some digits may stand for a fact."""
    rows = _lines(spark, sf_dir).withColumn("digits", (F.col("l_linenumber") % 4 + 1).cast("int")).where("whole > 0")
    place = numbers.exponent(F.col("whole").cast("double")) - F.col("digits") + 1
    unit = F.pow(F.lit(10.0), place.cast("double"))
    said = F.round(F.col("whole") / unit, 0) * unit * F.when(F.col("l_orderkey") % 3 == 0, 1.1).otherwise(1.0) * F.when(F.col("l_orderkey") % 5 == 0, -1.0).otherwise(1.0)
    signed = F.col("l_orderkey") % 2 == 0
    fact = F.col("whole").cast("double")
    return rows.select("l_orderkey", "l_linenumber", numbers.exponent(fact).alias("exponent"), F.round(numbers.window(fact, F.col("digits")), 9).alias("half_unit"), numbers.agrees(said, fact, F.col("digits"), signed).alias("accepted"))


def percent_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent changes that don't say whether they are points or relative."""
    rows = _orders(spark, sf_dir)
    n = (F.col("o_orderkey") % 90 + 1).cast("string")
    said = _choose(
        F.col("o_custkey") % 6, F.concat(F.lit("Margin rose "), n, F.lit("%.")), F.concat(F.lit("Margin rose "), n, F.lit("% in relative terms.")), F.concat(F.lit("Margin rose "), n, F.lit(" percentage points to 9%.")),
        F.concat(F.lit("Margin was "), n, F.lit("%; it fell.")), F.concat(F.lit("Sales fell to "), n, F.lit(".5% of the total")), F.lit(None).cast("string"),
    )
    return rows.select("o_orderkey", numbers.ambiguous_percent_change(said).alias("ambiguous"))


def period_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways to print a period, read back."""
    rows = _orders(spark, sf_dir).withColumn("k", F.col("o_orderkey") % 7)
    year, q = F.date_format("day", "yyyy"), F.quarter("day")
    word = _choose(q - 1, "first", "second", "third", "fourth")
    surface = _choose(
        F.col("k"), F.concat(F.lit("Q"), q.cast("string"), F.lit(" "), year), F.concat(F.lit("the "), word, F.lit(" quarter of "), year), F.concat(F.lit("fiscal "), year), F.concat(F.lit("full year "), year), year,
        F.date_format("day", "MMMM d, yyyy"), "last spring",
    )
    found = periods.surface_period(surface)
    return rows.select("o_orderkey", periods.key(found["start"], found["end"], found["instant"]).alias("period_key"))


def folded_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels without typography, footnotes and qualifiers."""
    rows = read(spark, sf_dir, "part")
    label = _choose(
        F.col("p_partkey") % 4, F.concat(F.lit("“"), F.col("p_type"), F.lit("” (1) (2)")), F.concat(F.col("p_type"), F.lit(" — net (at period end)")), F.concat(F.col("p_type"), F.lit(" (Unaudited)")), F.col("p_type"),
    )
    return rows.select("p_partkey", F.lower(text.without_qualifiers(text.folded(label))).alias("label"))


def reading_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers from ordered parts; blanks keep their place."""
    rows = read(spark, sf_dir, "lineitem")
    place = text.position_parts(
        F.col("l_orderkey"), F.lit("Net Revenue"), F.year("l_shipdate"), F.lit(None).cast("string"), F.col("l_linenumber"), F.lit(" USD "),
        F.create_map(F.lit("status"), F.col("l_linestatus"), F.lit("flag"), F.col("l_returnflag")),
    )
    passage = F.when(F.col("l_linenumber") > 1, F.col("l_partkey").cast("string"))
    made = text.reading_id(F.lit("Net Revenue"), F.concat(F.lit("Supplier #"), F.col("l_suppkey")), F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("normalized_table"), passage, F.when(F.col("l_linenumber") > 2, place))
    return rows.select("l_orderkey", "l_linenumber", made.alias("reading_id"), text.digest(place, F.lit("")).alias("place_digest"))


def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bounded, escaped bag of terms."""
    rows = read(spark, sf_dir, "part")
    asked = F.concat_ws(" ", F.col("p_name"), F.col("p_type"), F.lit("a/b:c (x)"), F.col("p_brand"))
    return rows.select("p_partkey", text.bag_of_terms(asked).alias("terms"))


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text around the first needle, with its place."""
    found = text.window(F.col("text"), ["license", "mail", "the "], 40)
    return read(spark, sf_dir, "documents").select("doc_id", F.col("text"), found.alias("w")).select("doc_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), F.md5(F.col("w.text")).alias("window_md5"))


def quoted_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of the benchmark retyped with other dashes and spaces, found again in their text."""
    rows = read(spark, sf_dir, "benchmark").where(F.length("text") >= 60)
    source = F.concat(F.lit("before – "), F.col("text"), F.lit(" — after"))
    retyped = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("Before - "), F.substr("text", F.lit(1), F.lit(20)))).when(F.col("item_id") % 3 == 1, F.substr("text", F.lit(11), F.lit(30))).otherwise(F.lit("not there at all"))
    found = text.located(source, retyped)
    return rows.select("item_id", found["start"].alias("start"), found["exact"].alias("exact"), F.length(found["found"]).alias("n_chars"))


def term_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of a term in a text, case aside."""
    found = text.occurrences(F.col("text"), F.lit("the"))
    rows = read(spark, sf_dir, "documents").select("doc_id", found.alias("at"))
    return rows.select("doc_id", F.size("at").alias("n"), F.get("at", F.lit(0)).alias("first_at"), F.when(F.size("at") > 0, F.element_at("at", -1)).alias("last_at"))


def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collapsed white space, sentences, and words that run together."""
    rows = read(spark, sf_dir, "documents").where("text IS NOT NULL")
    return rows.select("doc_id", F.length(text.collapsed(F.col("text"))).alias("n_chars"), F.size(text.sentences(F.col("text"))).alias("n_sentences"), text.has_glued_words(F.col("text")).alias("glued"))


QUERIES = {
    f.__name__: f
    for f in (
        number_cells, scale_declarations, prose_figures, resolved_periods, period_mentions, printed_dates, period_shapes, numeral_tokens, printed_tolerance, percent_claims,
        period_surfaces, folded_labels, reading_ids, search_terms, excerpts, quoted_spans, term_occurrences, sentence_counts,
    )
}

_DAY = "SELECT *, CAST(o_orderdate AS DATE) AS d, last_day(CAST(o_orderdate AS DATE)) AS e, date_trunc('year', o_orderdate)::DATE AS y0, date_trunc('quarter', o_orderdate)::DATE AS q0 FROM orders"
_KEY = "CASE WHEN {1} IS NULL THEN NULL ELSE CAST({0} AS VARCHAR) || '..' || CAST({1} AS VARCHAR) END"

ORACLES = {
    "number_cells": """
SELECT l_orderkey, l_linenumber, CASE k WHEN 0 THEN v WHEN 1 THEN -v WHEN 4 THEN l_quantity / 2 WHEN 7 THEN v + 0.5 WHEN 8 THEN -v WHEN 9 THEN v END AS value, k = 3 AS nil,
       CASE WHEN k = 7 THEN v + 0.5 WHEN k = 8 AND v < 1000 THEN -v END AS strict
FROM (SELECT *, (l_orderkey * 7 + l_linenumber) % 10 AS k, floor(l_extendedprice)::DOUBLE AS v FROM lineitem) x""",
    "scale_declarations": """
SELECT o_orderkey, CASE k WHEN 0 THEN 'thousands' WHEN 1 THEN 'millions' WHEN 2 THEN 'billions' WHEN 4 THEN 'millions' END AS scale,
       CASE k WHEN 0 THEN 'percentages and homes sold' WHEN 2 THEN 'number of markets' END AS exceptions, exempt,
       floor(o_totalprice) * CASE WHEN exempt THEN 1.0 WHEN k = 0 THEN 1e3 WHEN k IN (1, 4) THEN 1e6 WHEN k = 2 THEN 1e9 ELSE 1.0 END AS value
FROM (SELECT *, o_orderkey % 5 AS k, (o_orderkey % 5 = 0 AND o_custkey % 5 IN (0, 1)) OR (o_orderkey % 5 = 2 AND o_custkey % 5 = 2) AS exempt FROM orders) x""",
    "prose_figures": """
SELECT o_orderkey, CASE k WHEN 0 THEN n * 1e6 WHEN 3 THEN n END AS money, CASE WHEN k = 2 THEN n % 100 + 0.5 END AS percent,
       CASE k WHEN 0 THEN n WHEN 1 THEN -n WHEN 2 THEN n % 100 + 0.5 WHEN 4 THEN n END AS single, CASE k WHEN 0 THEN 'millions' WHEN 1 THEN 'thousands' END AS scale, k IN (0, 1, 2, 3, 5) AS named
FROM (SELECT *, o_orderkey % 6 AS k, floor(o_totalprice)::DOUBLE AS n FROM orders) x""",
    "resolved_periods": f"""
WITH o AS (SELECT *, o_orderkey % 8 AS k, date_trunc('month', d)::DATE AS m0 FROM ({_DAY}) t),
p AS (SELECT o_orderkey, k, e, make_date(2000 + year(d) % 100, quarter(d) * 3, 1) AS s0,
      CASE k WHEN 0 THEN (m0 - INTERVAL 2 MONTH)::DATE WHEN 1 THEN (m0 - INTERVAL 11 MONTH)::DATE WHEN 6 THEN (m0 - INTERVAL 8 MONTH)::DATE WHEN 4 THEN (make_date(2000 + year(d) % 100, quarter(d) * 3, 1) - INTERVAL 2 MONTH)::DATE END AS s,
      CASE WHEN k IN (0, 1, 6) THEN e WHEN k = 4 THEN last_day(make_date(2000 + year(d) % 100, quarter(d) * 3, 1)) END AS f, CASE WHEN k IN (2, 3) THEN e END AS i FROM o)
SELECT o_orderkey, CAST(s AS VARCHAR) AS period_start, CAST(f AS VARCHAR) AS period_end, CAST(i AS VARCHAR) AS instant_date,
       CASE WHEN i IS NOT NULL THEN 'instant' WHEN k = 4 OR k = 0 AND month(f) % 3 = 0 THEN 'quarter' WHEN k = 1 AND month(f) = 12 THEN 'fiscal_year' WHEN k = 6 AND month(f) = 9 THEN 'ytd_9m' ELSE 'other' END AS shape FROM p""",
    "period_mentions": f"""
SELECT o_orderkey, CASE k WHEN 0 THEN 'three months ended ' || a || '; ' || a WHEN 1 THEN a || '; ' || b || '; ' || q WHEN 2 THEN q ELSE '' END AS phrases, k = 1 AS flattened
FROM (SELECT o_orderkey, o_orderkey % 4 AS k, strftime(e, '%B ') || day(e) || strftime(e, ', %Y') AS a,
      strftime(last_day((d - INTERVAL 12 MONTH)::DATE), '%B ') || day(last_day((d - INTERVAL 12 MONTH)::DATE)) || strftime((d - INTERVAL 12 MONTH)::DATE, ', %Y') AS b, quarter(d) || 'Q' || strftime(d, '%y') AS q FROM ({_DAY}) t) x""",
    "printed_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders",
    "period_shapes": f"""
WITH p AS (SELECT o_orderkey, d, o_orderkey % 7 AS k, CASE WHEN o_orderkey % 7 IN (0, 6) THEN q0 WHEN o_orderkey % 7 IN (1, 2, 3) THEN y0 WHEN o_orderkey % 7 = 4 THEN d END AS s,
  CASE o_orderkey % 7 WHEN 0 THEN last_day((q0 + INTERVAL 2 MONTH)::DATE) WHEN 1 THEN make_date(year(d), 12, 31) WHEN 2 THEN make_date(year(d), 6, 30) WHEN 3 THEN make_date(year(d), 9, 30) WHEN 4 THEN e WHEN 6 THEN last_day((q0 + INTERVAL 3 MONTH)::DATE) END AS f FROM ({_DAY}) t)
SELECT o_orderkey, CASE k WHEN 0 THEN 'quarter' WHEN 1 THEN 'fiscal_year' WHEN 2 THEN 'ytd_6m' WHEN 3 THEN 'ytd_9m' WHEN 5 THEN 'instant' ELSE 'other' END AS shape,
       CASE WHEN k = 5 THEN CAST(d AS VARCHAR) ELSE CAST(s AS VARCHAR) || '..' || CAST(f AS VARCHAR) END AS period_key, CASE WHEN k IN (0, 5) THEN 3 WHEN k IN (1, 2, 3) THEN 12 END AS step,
       CAST((year(coalesce(f, d)) - 1995) * 12 + month(coalesce(f, d)) - 3 AS INTEGER) AS months FROM p""",
    "numeral_tokens": """
WITH l AS (SELECT l_orderkey, l_linenumber, floor(l_extendedprice)::BIGINT AS v, l_quantity::INTEGER AS q FROM lineitem),
t AS (SELECT l_orderkey, l_linenumber, 0 AS place, v * 1e6 AS value, 'USD' AS unit, greatest(length(rtrim(v::VARCHAR, '0')), 1) AS figures, false AS negative FROM l
UNION ALL SELECT l_orderkey, l_linenumber, 1, -(q + 0.5), 'percent', CASE WHEN q = 0 THEN 2 ELSE length(q::VARCHAR) + 2 END, true FROM l
UNION ALL SELECT l_orderkey, l_linenumber, 2, -100.0 * l_linenumber, 'basis_points', length(rtrim(l_linenumber::VARCHAR, '0')), true FROM l
UNION ALL SELECT l_orderkey, l_linenumber, 3, l_linenumber + 0.2, 'multiple', length(l_linenumber::VARCHAR) + 1, false FROM l
UNION ALL SELECT l_orderkey, l_linenumber, 4, 3.0, 'percentage_points', 1, false FROM l)
SELECT l_orderkey, l_linenumber, place::INTEGER AS place, value::DOUBLE AS value, unit, figures::INTEGER AS figures, negative FROM t""",
    "printed_tolerance": """
WITH l AS (SELECT l_orderkey, l_linenumber, floor(l_extendedprice)::DOUBLE AS v, (l_linenumber % 4 + 1)::INTEGER AS n, length(floor(l_extendedprice)::BIGINT::VARCHAR) - 1 AS e FROM lineitem WHERE l_extendedprice >= 1),
s AS (SELECT *, pow(10.0, e - n + 1) AS u, round(v / pow(10.0, e - n + 1)) * pow(10.0, e - n + 1) * CASE WHEN l_orderkey % 3 = 0 THEN 1.1 ELSE 1 END AS said FROM l)
SELECT l_orderkey, l_linenumber, e::INTEGER AS exponent, round(0.5 * u, 9) AS half_unit, round(abs(said - v), 9) <= 0.5 * u AND NOT (l_orderkey % 2 = 0 AND l_orderkey % 5 = 0) AS accepted FROM s""",
    "percent_claims": "SELECT o_orderkey, o_custkey % 6 IN (0, 4) AS ambiguous FROM orders",
    "period_surfaces": f"""
SELECT o_orderkey, CASE WHEN k IN (0, 1) THEN CAST(q0 AS VARCHAR) || '..' || CAST(last_day((q0 + INTERVAL 2 MONTH)::DATE) AS VARCHAR) WHEN k IN (2, 3, 4) THEN year(d) || '-01-01..' || year(d) || '-12-31' WHEN k = 5 THEN CAST(d AS VARCHAR) END AS period_key
FROM (SELECT *, o_orderkey % 7 AS k FROM ({_DAY}) t) x""",
    "folded_labels": "SELECT p_partkey, lower(p_type) || CASE WHEN p_partkey % 4 = 1 THEN ' - net' ELSE '' END AS label FROM part",
    "reading_ids": """
WITH p AS (SELECT *, 'accession=' || l_orderkey || '|fy=' || year(l_shipdate) || '|fp=|concept=Net Revenue|context=' || l_linenumber || '|unit=USD|dims=flag=' || l_returnflag || ';status=' || l_linestatus AS place FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 1 THEN 'obs:net-revenue:supplier-' || l_suppkey || ':' || strftime(l_shipdate, '%Y-%m-%d') || ':normalized-table:' ||
  substr(sha256(l_partkey::VARCHAR || chr(31) || CASE WHEN l_linenumber > 2 THEN place ELSE '' END), 1, 12) END AS reading_id, substr(sha256(place || chr(31)), 1, 12) AS place_digest FROM p""",
    "search_terms": r"""
WITH w AS (SELECT p_partkey, unnest(string_split(lower(p_name || ' ' || p_type || ' a/b:c (x) ' || p_brand), ' ')) AS w, generate_subscripts(string_split(lower(p_name || ' ' || p_type || ' a/b:c (x) ' || p_brand), ' '), 1) AS n FROM part),
f AS (SELECT p_partkey, w, min(n) AS n FROM w WHERE length(w) >= 4 GROUP BY p_partkey, w), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY n) AS r FROM f)
SELECT p_partkey, string_agg('"' || replace(replace(replace(replace(w, '/', '\/'), ':', '\:'), '#', '#'), '-', '\-') || '"', ' OR ' ORDER BY r) AS terms FROM r WHERE r <= 6 GROUP BY p_partkey""",
    "excerpts": """
WITH n AS (SELECT doc_id, text, strpos(lower(text), 'license') AS a, strpos(lower(text), 'mail') AS b, strpos(lower(text), 'the ') AS c FROM documents),
p AS (SELECT *, CASE WHEN a > 0 THEN a WHEN b > 0 THEN b WHEN c > 0 THEN c ELSE 1 END AS spot, CASE WHEN a > 0 THEN 7 WHEN b > 0 THEN 4 WHEN c > 0 THEN 4 ELSE 0 END AS n FROM n),
w AS (SELECT doc_id, text, greatest(spot - 41, 0) AS s, least(spot - 1 + n + 40, length(text)) AS e FROM p)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN s::INTEGER END AS window_start, e::INTEGER AS window_end, md5(substr(text, s + 1, e - s)) AS window_md5 FROM w""",
    "quoted_spans": """
SELECT item_id, CASE item_id % 3 WHEN 0 THEN 0 WHEN 1 THEN strpos('before – ' || text || ' — after', substr(text, 11, 30)) - 1 END::INTEGER AS start, CASE item_id % 3 WHEN 0 THEN false WHEN 1 THEN true END AS exact,
       CASE item_id % 3 WHEN 0 THEN 29 WHEN 1 THEN 30 END AS n_chars FROM benchmark WHERE length(text) >= 60""",
    "term_occurrences": """
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE len(string_split(lower(text), 'the')) - 1 END::INTEGER AS n, CASE WHEN strpos(lower(text), 'the') > 0 THEN strpos(lower(text), 'the') - 1 END::INTEGER AS first_at,
       CASE WHEN strpos(lower(text), 'the') > 0 THEN length(text) - strpos(reverse(lower(text)), 'eht') - 2 END::INTEGER AS last_at FROM documents""",
    "sentence_counts": r"""
WITH c AS (SELECT doc_id, text, trim(regexp_replace(text, '[\s\x{a0}]+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, length(t)::INTEGER AS n_chars, (len(regexp_extract_all(t, '[.!?]\s+[A-Z0-9"''(]')) + 1)::INTEGER AS n_sentences, regexp_matches(text, '[a-z][a-z][A-Z][a-z][a-z]') AS glued FROM c""",
}
