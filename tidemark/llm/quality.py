"""Quality by weak supervision, in DataFrame functions alone (operator 2).

Rules look at a text's statistics and vote good (1), bad (-1) or abstain (0). Expectation-maximisation over
the counts of vote patterns (at most 3 ** rules rows, whatever the size of the corpus) estimates for each
rule how often it votes which way on good and on bad documents, and the share of good ones. A document's
verdict is its posterior probability of being good, a sum of the logarithms its votes select.

Words are runs of characters other than space and tab to carriage return. A null text has none. Repeated
rows are rated alike; ties do not arise. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

# What separates words, and what counts as a symbol.
SPACES = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Repeated windows up to which each window is looked up among them.
FEW = 40
ROUNDS = 60
#: Pseudo-counts of the estimates, as a share of all documents, and what they say: how often a rule votes
#: good, bad or abstains on good and on bad documents before any is seen.
PRIOR_SHARE = 0.02
PRIOR_GOOD = {1: 0.93, -1: 0.002, 0: 0.068}
PRIOR_BAD = {1: 0.75, -1: 0.20, 0: 0.05}
KEEP_AT = 0.5


def statistics(docs: DataFrame) -> DataFrame:
    """docs with a struct column ``_q`` of counts: those of the contract and what the rules look at besides."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # split at every single space character: that many parts less one are the text's spaces
    frame = docs.withColumn("_text", text).withColumn("_parts", F.split("_text", "[\\x20\\x09-\\x0D]"))
    frame = frame.withColumn("_words", F.array_remove("_parts", ""))
    frame = frame.withColumn("_marks", F.regexp_replace("_text", f"[^{SYMBOLS}!]+", ""))
    w, n = F.col("_words"), F.size("_words")
    frame = frame.withColumn("_hash", F.transform(w, lambda x: F.xxhash64(x)))
    h = F.col("_hash")
    # one number per window, from the words' hashes; windows of equal number are compared word by word
    places = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    frame = frame.withColumn("_windows", F.transform(places, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW)))))
    windows = F.col("_windows")
    # Numbers that occur twice are found by a plain sort. With few of them, only their windows are placed;
    # windows of equal number must then come side by side.
    frame = frame.withColumn("_plain", F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.sort_array(windows)))
    plain = F.col("_plain")
    frame = frame.withColumn("_twice", F.array_distinct(F.filter(plain, lambda x, k: F.coalesce(x == F.get(plain, k + 1), F.lit(False)))))
    few = F.size("_twice") <= FEW
    at = F.filter(places, lambda i: ~few | F.array_contains(F.col("_twice"), F.get(windows, i)))
    frame = frame.withColumn("_at", F.when(F.col("_twice").isNotNull(), at))
    frame = frame.withColumn("_sorted", F.sort_array(F.transform("_at", lambda i: F.struct(F.get(windows, i).alias("h"), i.alias("at")))))
    in_order = F.col("_sorted")

    def same(x: Column, y: Column) -> Column:
        return F.coalesce((x["h"] == y["h"]) & (F.slice(w, x["at"] + 1, WINDOW) == F.slice(w, y["at"] + 1, WINDOW)), F.lit(False))

    twice = F.filter(in_order, lambda x, k: same(x, F.get(in_order, k - 1)) | same(x, F.get(in_order, k + 1)))
    frame = frame.withColumn("_starts", F.sort_array(F.transform(twice, lambda x: x["at"])))
    starts = F.col("_starts")
    covered = F.transform(starts, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - x, F.lit(WINDOW))))
    repeated = F.coalesce(F.aggregate(covered, F.lit(0), lambda a, b: a + b), F.lit(0))
    frame = frame.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.length(F.trim(x, F.lit(SPACES))) > 0))
    t = F.col("_text")
    return frame.withColumn(
        "_q",
        F.struct(
            n.cast("long").alias("n_words"),
            (F.length(t) - F.size("_parts") + 1).cast("long").alias("word_chars"),
            F.length(F.replace(F.col("_marks"), F.lit("!"), F.lit(""))).cast("long").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            repeated.cast("long").alias("n_repeat_words"),
            F.size("_lines").cast("long").alias("n_lines"),
            (F.length("_marks") - F.length(F.replace(F.col("_marks"), F.lit("!"), F.lit("")))).cast("long").alias("n_exclaims"),
            F.regexp_count(t, F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
            F.size(F.array_distinct("_hash")).cast("long").alias("n_distinct"),
        ),
    ).drop("_text", "_parts", "_words", "_marks", "_hash", "_windows", "_plain", "_twice", "_at", "_sorted", "_starts", "_lines")


def votes() -> list[Column]:
    """The rules over ``_q``. Each: bad, good, else abstain."""
    q = lambda name: F.col("_q")[name]
    words = F.greatest(q("n_words"), F.lit(1))
    per_word = lambda name: q(name) / words

    def rule(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    length = q("word_chars") / words
    characters = F.greatest(q("word_chars"), F.lit(1))
    return [
        rule(q("n_words") < 5, q("n_words") >= 10),
        rule((length < 2) | (length > 14), (length >= 3) & (length <= 11)),
        rule(per_word("n_symbols") >= 0.15, per_word("n_symbols") <= 0.03),
        rule(q("n_symbols") / characters >= 0.04, q("n_symbols") / characters <= 0.01),
        rule(per_word("n_repeat_words") > 0.2, per_word("n_repeat_words") <= 0.05),
        rule((q("n_words") >= 40) & (per_word("n_distinct") < 0.02 + 1.5 / F.sqrt(words)), (q("n_words") < 40) | (per_word("n_distinct") >= 0.02 + 3 / F.sqrt(words))),
        rule(q("n_upper") / characters > 0.4, q("n_upper") / characters <= 0.15),
        rule(per_word("n_exclaims") >= 0.3, per_word("n_exclaims") <= 0.1),
        rule((q("n_lines") >= 4) & (q("n_dup_lines") / F.greatest(q("n_lines"), F.lit(1)) > 0.3), q("n_dup_lines") == 0),
    ]


def fit(patterns: dict[tuple[int, ...], int]) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """EM over pattern counts: the share of good documents and, per rule and vote, its probability on (good, bad) ones."""
    total = sum(patterns.values())
    size = len(next(iter(patterns), ()))
    tables = [{v: (PRIOR_GOOD[v], PRIOR_BAD[v]) for v in (1, -1, 0)} for _ in range(size)]
    share, weight = 0.85, PRIOR_SHARE * total
    for _ in range(ROUNDS if total else 0):
        good = 0.0
        sums = [{v: [weight * PRIOR_GOOD[v], weight * PRIOR_BAD[v]] for v in (1, -1, 0)} for _ in range(size)]
        for pattern, count in patterns.items():
            z = math.log(share / (1 - share)) + sum(math.log(t[v][0] / t[v][1]) for t, v in zip(tables, pattern))
            p = count / (1 + math.exp(-max(-500.0, min(500.0, z))))
            good += p
            for s, v in zip(sums, pattern):
                s[v][0] += p
                s[v][1] += count - p
        share = (good + 0.85 * weight) / (total + weight)
        tables = [{v: (s[v][0] / (good + weight), s[v][1] / (total - good + weight)) for v in s} for s in sums]
    return share, tables


def _posterior(seen: DataFrame) -> Column:
    """P(good) as a column over ``_q``, estimated from the votes on the rows of seen (a column ``_q``)."""
    rules = votes()
    names = [f"_v{i}" for i in range(len(rules))]
    patterns = seen.select(*(r.alias(v) for r, v in zip(rules, names))).groupBy(*names).count().collect()
    share, tables = fit({tuple(row[v] for v in names): row["count"] for row in patterns})
    z = F.lit(math.log(share / (1 - share)))
    for rule, table in zip(rules, tables):
        z = z + F.element_at(F.create_map(*(F.lit(x) for v in (1, -1, 0) for x in (v, math.log(table[v][0] / table[v][1])))), rule)
    return 1 / (1 + F.exp(-z))


def rated(docs: DataFrame) -> DataFrame:
    """docs with ``_q`` (its counts), ``_p``, the posterior probability of being good, and the verdict ``_keep``.

    Other columns stay, whatever their names; columns of these three names are replaced. It reads the texts
    twice, once for the estimates: writing rows and counts instead takes the size of the texts on disk. It
    moves no row. The verdict names the partition, so that a filter on it isn't rewritten into many copies of
    the counts.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    frame = statistics(docs.select(row, "text")).withColumn("_p", _posterior(statistics(docs.select("text")).select("_q")))
    frame = frame.withColumn("_keep", keep() & (F.spark_partition_id() >= 0))
    others = [F.col(f"_row.`{c}`") for c in docs.columns if c not in ("_q", "_p", "_keep")]
    return frame.select(*others, "_q", "_p", "_keep")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, ``_q`` and ``_p`` of every row, from one reading: the counts are kept in the shared folder."""
    counted = checkpointed(statistics(docs.select("doc_id", "text")).select("doc_id", "_q"))
    return counted.withColumn("_p", _posterior(counted))


def base_failed() -> Column:
    q = F.col("_q")
    return (q["n_words"] < 10) | (100 * q["n_repeat_words"] > 20 * q["n_words"])


def keep() -> Column:
    return ~base_failed() & (F.col("_p") >= KEEP_AT)
