"""Numbers as they are printed in cells and sentences, as Column functions.

All take and give Columns of one row, so they stay inside generated code. Null texts give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a cell may hold besides its number, dashes that say nil, words and their factors.
STRANDED = "ÂâÃ\u00a0"
DASHES = ("—", "–", "-", "‒", "―")
FACTORS = {"thousand": 1_000.0, "million": 1_000_000.0, "billion": 1_000_000_000.0}
PLAIN_NUMBER = r"^-?\d{1,3}(,\d{3})*(\.\d+)?$|^-?\d+(\.\d+)?$"
#: Places to which differences are rounded before they are compared.
PLACES = 9


def cleaned(text: Column) -> Column:
    """The text without stranded bytes of a wrong encoding and without space around it."""
    return F.trim(F.translate(text, STRANDED, ""))


def is_nil(text: Column) -> Column:
    """Whether a cell holds a dash alone: nil, which is neither zero nor missing."""
    return cleaned(text).isin(*DASHES)


def magnitude(text: Column) -> Column:
    """The number that a cell is, negative in parentheses; null for a dash and for all that isn't a number alone."""
    bare = cleaned(text)
    wrapped = bare.startswith("(") & bare.endswith(")")
    inner = F.when(wrapped, F.substr(bare, F.lit(2), F.greatest(F.length(bare) - 2, F.lit(0)))).otherwise(bare)
    inner = F.trim(F.translate(inner, "$%", ""))
    value = F.regexp_replace(inner, ",", "").cast("double")
    return F.when(~is_nil(text) & inner.rlike(PLAIN_NUMBER), F.when(wrapped, -value).otherwise(value))


def scale_declaration(text: Column) -> Column:
    """(scale, exceptions) of a phrase such as "(in thousands, except percentages)"; null without one. The largest scale named wins."""
    bare = cleaned(text)
    scale = F.coalesce(*(F.when(bare.rlike(rf"(?i)\bin\s+{word}s\b"), F.lit(f"{word}s")) for word in ("billion", "million", "thousand")))
    items = F.nullif(F.trim(F.regexp_extract(bare, r"(?i)\bexcept\s+([^)]+)", 1)), F.lit(""))
    return F.when(scale.isNotNull(), F.struct(scale.alias("scale"), items.alias("exceptions")))


def scale_excludes(exceptions: Column, label: Column) -> Column:
    """Whether a row's label is exempt from the declared scale: an item of the list is in it or holds it, or percentages are exempt and it shows a percent sign."""
    row = F.lower(cleaned(label))
    items = F.transform(F.split(F.lower(exceptions), r",|\band\b"), lambda item: F.trim(F.translate(F.trim(item), ".", "")))
    named = F.exists(items, lambda item: (F.length(item) >= 4) & (F.contains(row, item) | F.contains(item, row)))
    percent = F.contains(F.lower(exceptions), F.lit("percentage")) & F.contains(label, F.lit("%"))
    return F.coalesce((exceptions != "") & (row != "") & (named | percent), F.lit(False))


def scale_factor(scale: Column) -> Column:
    """1 for units and for no scale."""
    return F.coalesce(*(F.when(scale == f"{word}s", F.lit(by)) for word, by in FACTORS.items()), F.lit(1.0))


def money_phrase(text: Column) -> Column:
    """(value, phrase) of the first "$279 million" in prose, with the word applied; null without one."""
    pattern = r"(?i)\$\s*(\d{1,3}(?:,\d{3})*(?:\.\d+)?)\s*(thousand|million|billion)?s?\b"
    bare = cleaned(text)
    value = F.regexp_replace(F.regexp_extract(bare, pattern, 1), ",", "").try_cast("double")
    word = F.lower(F.regexp_extract(bare, pattern, 2))
    factor = F.coalesce(*(F.when(word == name, F.lit(by)) for name, by in FACTORS.items()), F.lit(1.0))
    return F.when(bare.rlike(pattern), F.struct((value * factor).alias("value"), F.trim(F.regexp_extract(bare, pattern, 0)).alias("phrase")))


def percent_phrase(text: Column) -> Column:
    """(value, phrase) of the first percentage in prose; null without one."""
    pattern = r"(-?\d+(?:\.\d+)?)\s*%"
    bare = cleaned(text)
    return F.when(bare.rlike(pattern), F.struct(F.regexp_extract(bare, pattern, 1).try_cast("double").alias("value"), F.trim(F.regexp_extract(bare, pattern, 0)).alias("phrase")))


def printed_magnitude(text: Column) -> Column:
    """(value, scale) of a sentence's one number as printed; null where it prints none or several. Only parentheses around the number itself negate it."""
    number = r"-?\d{1,3}(?:,\d{3})+(?:\.\d+)?|-?\d+(?:\.\d+)?"
    bare = cleaned(text)
    found = F.regexp_extract_all(bare, F.lit(f"({number})"), 1)
    token = F.get(found, F.lit(0))
    value = F.regexp_replace(token, ",", "").try_cast("double")
    wrapped = F.regexp_extract(bare, rf"\(\s*[$€£]?\s*({number})\s*%?\s*\)", 1) == token
    word = F.lower(F.regexp_extract(bare, r"(?i)\b(thousand|million|billion)s?\b", 1))
    scale = F.when(word != "", F.concat(word, F.lit("s")))
    return F.when(F.size(found) == 1, F.struct(F.when(wrapped & (value > 0), -value).otherwise(value).alias("value"), scale.alias("scale")))


def names_its_subject(text: Column) -> Column:
    """Whether a quotation holds two words of three letters or more once its numbers are gone."""
    bare = F.regexp_replace(text, r"-?\d{1,3}(?:,\d{3})+(?:\.\d+)?|-?\d+(?:\.\d+)?", " ")
    return F.coalesce(F.regexp_count(bare, F.lit(r"[A-Za-z]{3,}")) >= 2, F.lit(False))


def strict_number(text: Column) -> Column:
    """The number of a text that is one by itself: no truth value, no space inside, nothing else."""
    bare = F.trim(text)
    return F.when(bare.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), bare.try_cast("double"))


# numerals of a sentence

#: One numeral with what surrounds it: sign or currency before, a scale word, and a unit after.
NUMERAL = (
    r"(?i)(\(\s*)?((?:[-−$] *)+)?(\d{1,3}(?:,\d{3})+|\d+)(?:\.(\d+))?(?: *(thousands?|millions?|billions?|bn|k|m)\b)?"
    r"(?: *(percentage +points?|pp)\b| *(basis +points?|bps)\b|(%)|(x)(?!\w))?"
)
_GROUPS = ("open", "prefix", "integer", "fraction", "word", "points", "basis", "percent", "multiple")
_WORD_FACTORS = {"t": 1e3, "k": 1e3, "m": 1e6, "b": 1e9}


def numerals(text: Column) -> Column:
    """Array of (at, value, unit, figures, negative) for every numeral of a text, in order.

    A unit is USD, percent, percentage_points, basis_points, multiple or none; figures are significant ones,
    zeros at the end of a whole number left out. Only the number's own wording is read.
    """
    whole = F.regexp_extract_all(text, F.lit(NUMERAL), 0)

    def one(token: Column, at: Column) -> Column:
        group = {name: F.regexp_extract(token, NUMERAL, i + 1) for i, name in enumerate(_GROUPS)}
        digits = F.concat(F.translate(group["integer"], ",", ""), F.when(group["fraction"] != "", F.concat(F.lit("."), group["fraction"])).otherwise(""))
        first = F.lower(F.substring(group["word"], 1, 1))
        factor = F.coalesce(*(F.when(first == letter, F.lit(by)) for letter, by in _WORD_FACTORS.items()), F.lit(1.0))
        negative = (group["open"] != "") | group["prefix"].rlike("[-−]")
        size = digits.try_cast("double") * factor
        unit = F.when(group["percent"] != "", "percent").when(group["points"] != "", "percentage_points").when(group["basis"] != "", "basis_points")
        unit = unit.when(group["multiple"] != "", "multiple").when(F.contains(group["prefix"], F.lit("$")), "USD").otherwise("none")
        return F.struct(at.alias("at"), F.when(negative, -size).otherwise(size).alias("value"), unit.alias("unit"), figures(digits).alias("figures"), negative.alias("negative"))

    return F.transform(whole, one)


def figures(digits: Column) -> Column:
    """Significant figures of a plain number text; zeros that end a whole number don't count, zero itself has one."""
    bare = F.regexp_replace(F.translate(digits, ".,", ""), "^0+", "")
    counted = F.when(F.contains(digits, F.lit(".")), bare).otherwise(F.regexp_replace(bare, "0+$", ""))
    return F.greatest(F.length(counted), F.lit(1))


def exponent(value: Column) -> Column:
    """Place of the first digit: 0 for one to ten, and for zero."""
    # through the decimal text, since a logarithm near a power of ten may round across it
    text = F.format_string("%.15e", F.abs(value))
    return F.when(value == 0, F.lit(0)).otherwise(F.regexp_extract(text, r"e([+-]\d+)$", 1).cast("int"))


def window(value: Column, n_figures: Column) -> Column:
    """Half a unit of the last of so many significant figures of a value."""
    return F.lit(0.5) * F.pow(F.lit(10.0), (exponent(value) - n_figures + 1).cast("double"))


def agrees(printed: Column, fact: Column, n_figures: Column, signed: Column) -> Column:
    """Whether a printed number may stand for a fact at its precision; a sign that is shown must be the fact's."""
    near = F.round(F.abs(F.abs(printed) - F.abs(fact)), PLACES) <= window(fact, n_figures)
    return near & (~signed | ((printed < 0) == (fact < 0)))


# change arithmetic


def delta(earlier: Column, later: Column) -> Column:
    return F.round(later - earlier, PLACES)


def across_zero(earlier: Column, later: Column) -> Column:
    """Whether a relative change can't be read: from zero, or from one sign to the other."""
    return (earlier == 0) | ((earlier < 0) != (later < 0))


def relative_change(earlier: Column, later: Column) -> Column:
    """Percent of the earlier size; null across zero."""
    return F.when(~across_zero(earlier, later), (later - earlier) / F.abs(earlier) * 100)


def tolerance(unit: Column, scale: Column) -> Column:
    """What a printed reading may be off by: a tenth of a percent, the scale of an amount, else one."""
    # fixed values
    amount = F.when(scale == "millions", F.lit(1e6)).when(scale == "thousands", F.lit(1e3)).otherwise(F.lit(1.0))
    return F.when(unit == "percent", F.lit(0.1)).when(F.startswith(unit, F.lit("USD")), amount).otherwise(F.lit(1.0))


def within(left: Column, right: Column, most: Column) -> Column:
    return F.round(F.abs(left - right), PLACES) <= most


def ambiguous_percent_change(text: Column) -> Column:
    """Whether a clause of the text gives a percentage beside a verb of change and says neither points nor relative."""
    # fixed values: words of change, of points and of proportion
    verbs = r"(?i)\b(rose|fell|declined|increased|decreased|dropped|improved|widened|narrowed|up|down|higher|lower)\b"
    points = r"(?i)\b(percentage\s+points?|pp|basis\s+points?|bps)\b"
    relative = r"(?i)\b(in\s+relative\s+terms|on\s+a\s+relative\s+basis|in\s+percentage\s+terms|relative\s+to|relative|percentage\s+change|percent\s+change|proportionally|proportionately)\b"
    clauses = F.split(text, r"\.(?!\d)|(?<!\d)\.|[;:—–]")
    return F.coalesce(F.exists(clauses, lambda c: c.rlike(verbs) & c.rlike(r"\d *%") & ~c.rlike(points) & ~c.rlike(relative)), F.lit(False))
