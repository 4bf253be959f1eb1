"""Texts: folding, phrases, windows, identifiers, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quotes go, dashes become one, a hard space becomes a plain one.
QUOTES, LONG_DASHES = "“”‘’\"'", "—–−"


def folded(text: Column) -> Column:
    """Typography made plain: no quotes, one kind of dash, plain spaces."""
    return F.translate(F.coalesce(text, F.lit("")), LONG_DASHES + " " + QUOTES, "--- ")


def without_qualifiers(label: Column) -> Column:
    """A label without footnote numbers at its end and without "(at period end)" or "(unaudited)"."""
    bare = F.trim(F.regexp_replace(label, r"(\s*\(\d+\))+\s*$", ""))
    return F.trim(F.regexp_replace(bare, r"(?i)\s*\((?:at\s+period\s+end|unaudited)\)\s*$", ""))


def collapsed(text: Column) -> Column:
    """Runs of white space, hard spaces among them, as one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def sentences(text: Column) -> Column:
    """Sentences of a collapsed text: after . ! or ? and a space, where a capital, digit or quote follows."""
    return F.split(collapsed(text), r"(?<=[.!?])\s+(?=[A-Z0-9\"'(])")


def has_glued_words(text: Column) -> Column:
    """Whether a lower-case letter is followed by a capital and two more letters in one word, as where a break was lost."""
    return F.coalesce(text.rlike(r"[a-z]{2}[A-Z][a-z]{2}"), F.lit(False))


def slug(value: Column) -> Column:
    """Lower-case letters and digits with single dashes between."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def digest(*parts: Column, length: int = 12) -> Column:
    """First hex digits of the SHA-256 of the parts with a unit separator between; a null part is empty and keeps its place. All parts blank: null."""
    texts = [F.coalesce(part.cast("string"), F.lit("")) for part in parts]
    joined = F.concat_ws("\u001f", *texts)
    some = F.trim(F.concat(*texts)) != ""
    return F.when(some, F.substring(F.sha2(joined.cast("binary"), 256), 1, length))


def reading_id(metric: Column, subject: Column, period: Column, lane: Column, passage: Column, *position: Column) -> Column:
    """Identifier of one reading; null where neither passage nor place tells readings apart."""
    return F.concat(F.lit("obs:"), F.concat_ws(":", slug(metric), slug(subject), period, slug(lane)), F.lit(":"), digest(passage, *position))


def position_parts(accession: Column, concept: Column, year: Column, fiscal: Column, context: Column, unit: Column, dimensions: Column) -> Column:
    """Ordered parts of a tagged fact's place; dimensions (a map) go in the order of their names."""
    blank = lambda c: F.coalesce(F.trim(c.cast("string")), F.lit(""))
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries(dimensions)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    named = (("accession", accession), ("fy", year), ("fp", fiscal), ("concept", concept), ("context", context), ("unit", unit))
    return F.concat_ws("|", *(F.concat(F.lit(f"{name}="), blank(c)) for name, c in named), F.concat(F.lit("dims="), F.coalesce(pairs, F.lit(""))))


def escaped_term(term: Column) -> Column:
    """A search term with the characters that mean something to a query parser escaped; fixed set of characters."""
    return F.regexp_replace(term, r"([+\-&|!(){}\[\]^\"~*?:\\/])", r"\\$1")


def bag_of_terms(text: Column, most: int = 6, least: int = 4) -> Column:
    """Query of the first distinct words of at least so many letters, escaped, quoted and joined by OR."""
    words = F.filter(F.array_distinct(F.split(F.lower(collapsed(F.coalesce(text, F.lit("")))), " ")), lambda w: F.length(w) >= least)
    return F.array_join(F.transform(F.slice(words, 1, most), lambda w: F.concat(F.lit('"'), escaped_term(w), F.lit('"'))), " OR ")


def whole_phrase(surface: str) -> str:
    """Pattern of a phrase with no letter or digit beside it."""
    quoted = "".join(f"\\{c}" if not c.isalnum() and c != " " else c for c in surface)
    return rf"(?i)(?<![a-z0-9]){quoted}(?![a-z0-9])"


def phrase_at(text: Column, phrase: Column) -> Column:
    """Place (from 1) of a phrase with no letter or digit beside it, case aside; 0 if it doesn't occur. Both are columns."""
    return F.regexp_instr(F.lower(text), F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.lower(phrase), F.lit(r"\E(?![a-z0-9])")))


def window(text: Column, needles: list[str], radius: int = 400) -> Column:
    """(text, start, end): what lies up to `radius` characters around the first needle found in the order given; the beginning without one."""
    lower = F.lower(text)
    at = F.coalesce(*(F.when(F.instr(lower, F.lit(n.lower())) > 0, F.struct(F.instr(lower, F.lit(n.lower())).alias("at"), F.lit(len(n)).alias("n"))) for n in needles), F.struct(F.lit(1).alias("at"), F.lit(0).alias("n")))
    start = F.greatest(at["at"] - 1 - radius, F.lit(0))
    end = F.least(at["at"] - 1 + at["n"] + radius, F.length(text))
    return F.when(text.isNotNull(), F.struct(F.substr(text, start + 1, end - start).alias("text"), start.alias("start"), end.alias("end")))


def located(text: Column, candidate: Column) -> Column:
    """(start, found, exact): where a retyped span stands and the characters that stand there; null if nowhere.

    As it is first, else with typography folded: quotes dropped there would move places, so only dashes and
    spaces are made alike, which keeps every character's place.
    """
    alike = lambda c: F.lower(F.translate(c, LONG_DASHES + " ‘’“”", "--- ''\"\""))
    plain, folded_at = F.instr(text, candidate), F.instr(alike(text), alike(candidate))
    at = F.when(plain > 0, plain).otherwise(folded_at)
    return F.when((at > 0) & (F.length(candidate) > 0), F.struct((at - 1).alias("start"), F.substr(text, at, F.length(candidate)).alias("found"), (plain > 0).alias("exact")))


def occurrences(text: Column, needle: Column) -> Column:
    """Places (from 0) of a needle, case aside, not overlapping."""
    parts = F.split(F.lower(text), F.concat(F.lit(r"\Q"), F.lower(needle), F.lit(r"\E")), -1)
    size = F.length(needle)
    ends = F.aggregate(F.slice(parts, 1, F.size(parts) - 1), F.array().cast("array<int>"), lambda acc, p: F.concat(acc, F.array(F.coalesce(F.element_at(F.when(F.size(acc) > 0, acc), -1) + size, F.lit(0)) + F.length(p))))
    return F.when((size > 0) & text.isNotNull(), ends)
