"""Periods as dates and as printed phrases, as Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names and abbreviations.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_NAME = "|".join(MONTHS)
_SHORT = "jan|feb|mar|apr|may|jun|jul|aug|sept|sep|oct|nov|dec"
FULL_DATE = rf"(?i)\b({_NAME})\s+(\d{{1,2}}),?\s+(\d{{4}})\b"
DURATION = r"(?i)\b(?:(three|six|nine|twelve)\s+months|(?:fiscal\s+)?year)\s+ended\b"
SHORTHAND = r"\b([1-4])Q(\d{2})\b"
#: Any phrase that names a period: a stated duration up to a date, a quarter's shorthand, a date.
PHRASE = (
    rf"\b(?:(?:three|six|nine|twelve)\s+months|(?:fiscal\s+)?year)\s+ended\s+(?:{_NAME})\s+\d{{1,2}},?\s+\d{{4}}\b"
    rf"|\b[1-4]Q\d{{2}}\b|\b(?:{_NAME})\s+\d{{1,2}},?\s+\d{{4}}\b"
)
#: Months from one period of a shape to the next.
STEP_MONTHS = {"instant": 3, "quarter": 3, "fiscal_year": 12, "ytd_6m": 12, "ytd_9m": 12}


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value worked out once, however often it is mentioned; keeps long expressions small."""
    return F.element_at(F.transform(F.array(value), then), 1)


def made_date(year: Column, month: Column, day: Column) -> Column:
    """The date of three numbers; null if a number is missing or the day doesn't exist."""
    return F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int")).try_cast("date")


def month_number(name: Column) -> Column:
    """1 to 12 by the first three letters; null for another word."""
    place = F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.substring(name, 1, 3)))
    return F.when((F.length(name) >= 3) & (place % 3 == 1), ((place - 1) / 3).cast("int") + 1)


def printed_date(text: Column) -> Column:
    """The first printed calendar date, full or short month; null where there is none or the day doesn't exist."""
    pattern = rf"(?i)\b({_NAME}|{_SHORT})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})\b"
    year, month, day = F.regexp_extract(text, pattern, 3), month_number(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)
    return F.when(text.rlike(pattern), made_date(year.try_cast("int"), month, day.try_cast("int")))


def months_of(wording: Column) -> Column:
    """Length that a heading states: 3, 6, 9 or 12 months; null where it states none."""
    word = F.lower(F.regexp_extract(wording, DURATION, 1))
    return F.when(wording.rlike(DURATION), F.when(word == "three", 3).when(word == "six", 6).when(word == "nine", 9).otherwise(12))


def is_instant_label(label: Column) -> Column:
    return F.coalesce(label.rlike(r"(?i)\bat\s+period\s+end\b|\bas\s+of\b"), F.lit(False))


def resolve(label: Column, heading: Column, row_label: Column) -> Column:
    """(start, end, instant) of a column from its label, its group's heading and the row; null if nothing states its length.

    The date is the label's, else the heading's; a bare year takes the heading's month and day, or the year's
    end. A row "at period end" is a stock whatever its group says, and so is a heading that is a month and day
    alone. The length is the heading's, else the label's; a quarter's shorthand states both. It is never guessed.
    """
    none = F.lit(None).cast("date")
    both = F.struct(F.coalesce(F.trim(label), F.lit("")).alias("label"), F.coalesce(F.trim(heading), F.lit("")).alias("heading"))

    def dates(t: Column) -> Column:
        label, heading = t["label"], t["heading"]
        year = F.when(label.rlike(r"^\d{4}$"), label.try_cast("int"))
        without_year = rf"(?i)\b({_NAME})\s+(\d{{1,2}}),\s*$"
        under = F.when(heading.rlike(without_year), made_date(year, month_number(F.regexp_extract(heading, without_year, 1)), F.regexp_extract(heading, without_year, 2).try_cast("int")))
        short = F.coalesce(F.when(label.rlike(SHORTHAND), label), F.when(heading.rlike(SHORTHAND), heading))
        quarter = F.last_day(made_date(2000 + F.regexp_extract(short, SHORTHAND, 2).try_cast("int"), F.regexp_extract(short, SHORTHAND, 1).try_cast("int") * 3, F.lit(1)))
        plain = F.when(~heading.rlike(without_year), made_date(year, F.lit(12), F.lit(31)))
        dated = F.coalesce(_full_date(label), _full_date(heading), under, plain)
        return F.struct(
            dated.alias("dated"), quarter.alias("quarter"), F.coalesce(months_of(heading), months_of(label)).alias("stated"),
            heading.rlike(rf"(?i)^({_NAME})\s+\d{{1,2}},?$").alias("day_alone"),
        )

    def period(t: Column) -> Column:
        end = F.coalesce(t["dated"], t["quarter"])
        stock = is_instant_label(row_label) | (t["day_alone"] & t["dated"].isNotNull())
        months = F.when(t["dated"].isNull(), F.lit(3)).otherwise(t["stated"])
        ranged = F.struct(F.add_months(F.trunc(end, "month"), 1 - months).alias("start"), end.alias("end"), none.alias("instant"))
        return F.when(end.isNotNull() & stock, F.struct(none.alias("start"), none.alias("end"), end.alias("instant"))).when(end.isNotNull() & months.isNotNull(), ranged)

    return let(let(both, dates), period)


def _full_date(text: Column) -> Column:
    return F.when(text.rlike(FULL_DATE), made_date(F.regexp_extract(text, FULL_DATE, 3).try_cast("int"), month_number(F.regexp_extract(text, FULL_DATE, 1)), F.regexp_extract(text, FULL_DATE, 2).try_cast("int")))


def phrases(text: Column) -> Column:
    """Array of the period phrases of a text in the order printed, space within them collapsed, each once."""
    found = F.regexp_extract_all(text, F.lit(f"(?i)({PHRASE})"), 1)
    return F.array_distinct(F.transform(found, lambda p: F.regexp_replace(p, r"\s+", " ")))


def is_flattened_grid(text: Column) -> Column:
    """Whether three period phrases or more stand side by side without a word between: headings of a table that lost its columns."""
    return F.coalesce(text.rlike(rf"(?i)(?:{PHRASE})(?:[^\w]*(?:{PHRASE})){{2}}"), F.lit(False))


def phrase_period(phrase: Column) -> Column:
    """(start, end, instant) of one printed phrase; a date alone is an instant."""
    ranged = resolve(phrase, phrase, F.lit(""))
    day = printed_date(phrase)
    none = F.lit(None).cast("date")
    return F.coalesce(ranged, F.when(day.isNotNull(), F.struct(none.alias("start"), none.alias("end"), day.alias("instant"))))


def key(start: Column, end: Column, instant: Column) -> Column:
    """Text that names a period: a date, or two with dots between."""
    return F.coalesce(instant.cast("string"), F.concat(start.cast("string"), F.lit(".."), end.cast("string")))


def shape(start: Column, end: Column, instant: Column) -> Column:
    """instant, quarter, fiscal_year, ytd_6m, ytd_9m, or other for any other pair of dates and for missing ones."""
    year_start = (F.month(start) == 1) & (F.dayofmonth(start) == 1) & (F.year(start) == F.year(end))
    whole = (F.dayofmonth(start) == 1) & (end == F.last_day(end)) & (F.year(start) == F.year(end))
    quarter = whole & (F.month(start) % 3 == 1) & (F.month(end) == F.month(start) + 2)
    until = lambda month: year_start & (end == F.last_day(end)) & (F.month(end) == month)
    return (
        F.when(instant.isNotNull(), "instant").when(start.isNull() | end.isNull(), "other").when(quarter, "quarter")
        .when(until(12), "fiscal_year").when(until(6), "ytd_6m").when(until(9), "ytd_9m").otherwise("other")
    )


def months_between(earlier: Column, later: Column) -> Column:
    """Whole calendar months from one date's month to another's."""
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)


def step_months(of_shape: Column) -> Column:
    return F.coalesce(*(F.when(of_shape == name, F.lit(months)) for name, months in STEP_MONTHS.items()))


def surface_period(surface: Column) -> Column:
    """(start, end, instant) of a way to print a period: "Q1 2023", "first quarter of 2023", "fiscal 2023", "full year 2023", "2023", a date or a phrase."""
    quarter = r"(?i)^(?:the )?(?:q([1-4])|(first|second|third|fourth) quarter)(?: of)?,? (?:fiscal )?(\d{4})$"
    year = r"(?i)^(?:the )?(?:(?:full[- ]year|fiscal(?: year)?|year|fy) ?)?(\d{4})$"
    none = F.lit(None).cast("date")

    def read(text: Column) -> Column:
        word = F.lower(F.substring(F.regexp_extract(text, quarter, 2), 1, 2))
        number = F.coalesce(F.regexp_extract(text, quarter, 1).try_cast("int"), F.when(word == "fi", 1).when(word == "se", 2).when(word == "th", 3).when(word == "fo", 4))
        first = made_date(F.regexp_extract(text, quarter, 3).try_cast("int"), number * 3 - 2, F.lit(1))
        whole = F.regexp_extract(text, year, 1).try_cast("int")
        return F.coalesce(
            F.when(text.rlike(quarter), F.struct(first.alias("start"), F.last_day(F.add_months(first, 2)).alias("end"), none.alias("instant"))),
            F.when(text.rlike(year), F.struct(made_date(whole, F.lit(1), F.lit(1)).alias("start"), made_date(whole, F.lit(12), F.lit(31)).alias("end"), none.alias("instant"))),
            phrase_period(text),
        )

    return let(F.trim(F.regexp_replace(surface, r"\s+", " ")), read)
