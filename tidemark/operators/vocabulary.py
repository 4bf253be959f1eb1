"""Vocabularies: closure, versions in force, rules as data, and checks of definitions and claims.

A check gives rows (code, subject) of what is wrong; none means that it holds. Row checks gather all codes of
a row in one array, so that a claim is read once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut


def ancestors(edges: DataFrame) -> DataFrame:
    """(child, ancestor, steps) over `child is_a parent`, shortest way first found; steps double every round, and cycles end since only new pairs go on.

    A node of a cycle is its own ancestor, which tells the cycle. Null ends are left out.
    """
    known = cut(edges.where("child IS NOT NULL AND parent IS NOT NULL").select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("steps")).distinct())
    while True:
        further = known.alias("a").join(known.alias("b"), F.col("a.ancestor") == F.col("b.child")).select(F.col("a.child"), F.col("b.ancestor"), (F.col("a.steps") + F.col("b.steps")).alias("steps"))
        after = cut(known.unionByName(further).groupBy("child", "ancestor").agg(F.min("steps").alias("steps")))
        if after.count() == known.count() and not after.join(known, ["child", "ancestor", "steps"], "left_anti").limit(1).count():
            return after
        known = after


def in_force(facts: DataFrame, versions: DataFrame, key: str, day: str, since: str, value: str) -> DataFrame:
    """facts with the value of the version of its key that began last on or before the fact's day; null before the first.

    Both are laid along one line by key and day and the last version seen is carried on, so that no fact meets
    every version of its key. A version that begins on the day is in force; of several that day the greatest value.
    """
    newest = versions.where(F.col(key).isNotNull() & F.col(since).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(since).alias("_day")).agg(F.max(value).alias("_value"))
    fact = F.struct(*(F.col(f"`{c}`") for c in facts.columns)).alias("_row")
    line = facts.select(F.col(key).alias("_key"), F.col(day).alias("_day"), F.lit(1).alias("_kind"), fact).unionByName(newest.select("_key", "_day", F.lit(0).alias("_kind"), "_value"), allowMissingColumns=True)
    carried = F.last("_value", ignorenulls=True).over(Window.partitionBy("_key").orderBy("_day", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    return line.withColumn("_held", carried).where("_kind = 1").select("_row.*", F.when(F.col("_day").isNotNull(), F.col("_held")).alias(f"{value}_in_force"))


def overlaps(intervals: DataFrame, key: str, id_: str, since: str, until: str) -> DataFrame:
    """(key, left, right) of all pairs of one key whose closed intervals meet, an open end being forever; not only neighbours."""
    rows = intervals.select(F.col(key).alias("k"), F.col(id_).alias("i"), F.col(since).alias("s"), F.coalesce(F.col(until), F.lit("9999-12-31").cast("date")).alias("u")).where("k IS NOT NULL AND s IS NOT NULL")
    a, b = rows.alias("a"), rows.alias("b")
    first = (F.col("a.s") < F.col("b.s")) | ((F.col("a.s") == F.col("b.s")) & (F.col("a.i") < F.col("b.i")))
    return a.join(b, (F.col("a.k") == F.col("b.k")) & first & (F.col("b.s") <= F.col("a.u"))).select(F.col("a.k").alias(key), F.col("a.i").alias("left"), F.col("b.i").alias("right"))


#: Predicates that a rule may name: each takes the value asked for and gives a condition on a row of an artifact.
PREDICATES: dict[str, Callable[[object], Column]] = {
    "kind": lambda v: F.col("kind") == v,
    "kind_in": lambda v: F.col("kind").isin(*v),
    "media": lambda v: F.col("media") == v,
    "media_not": lambda v: F.col("media").isNull() | (F.col("media") != v),
    "role_in": lambda v: F.lower("role").isin(*(x.lower() for x in v)),
    "role_starts": lambda v: F.startswith(F.lower("role"), F.lit(v.lower())),
    "role_starts_any": lambda v: reduce(lambda a, b: a | b, (F.startswith(F.lower("role"), F.lit(x.lower())) for x in v)),
    "described_by": lambda v: reduce(lambda a, b: a | b, (F.contains(F.lower("description"), F.lit(x.lower())) for x in v)),
    "items_any": lambda v: F.arrays_overlap("items", F.array(*map(F.lit, v))),
    "form_in": lambda v: F.col("form").isin(*v),
    "size_most": lambda v: F.coalesce("size", F.lit(0)) <= v,
}


def decided(rows: DataFrame, rules: list[dict], default: tuple[str, str], least_size: int) -> DataFrame:
    """rows with `decision`, `reason` and `rule`: the first rule whose predicates all hold; an included row below the least size is excluded.

    A predicate on a null column does not hold. An unknown predicate is an error.
    """
    chosen = []
    for rule in rules:
        unknown = set(rule["when"]) - set(PREDICATES)
        if unknown:
            raise ValueError(f"unknown predicates {sorted(unknown)}")
        holds = reduce(lambda a, b: a & b, (F.coalesce(PREDICATES[name](value), F.lit(False)) for name, value in rule["when"].items()), F.lit(True))
        chosen.append(F.when(holds, F.struct(F.lit(rule["decision"]).alias("decision"), F.lit(rule["reason"]).alias("reason"), F.lit(rule["id"]).alias("rule"))))
    none = F.struct(F.lit(default[0]).alias("decision"), F.lit(default[1]).alias("reason"), F.lit(None).cast("string").alias("rule"))
    rows = rows.withColumn("_d", F.coalesce(*chosen, none))
    small = (F.col("_d.decision") == "include") & (F.coalesce("size", F.lit(0)) < least_size)
    return rows.select(*rows.columns[:-1], F.when(small, "exclude").otherwise(F.col("_d.decision")).alias("decision"), F.when(small, "BELOW_TEXT_FLOOR").otherwise(F.col("_d.reason")).alias("reason"), F.col("_d.rule").alias("rule"))


def codes(*checks: tuple[str, Column]) -> Column:
    """Array of the codes whose condition holds; a condition that is null doesn't."""
    return F.array_compact(F.array(*(F.when(F.coalesce(when, F.lit(False)), code) for code, when in checks)))


def repeated(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that stand more than once, with how often."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def missing(rows: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is not among the known keys; a null reference is none."""
    return rows.where(F.col(column).isNotNull()).join(known.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def snapshot(rows: DataFrame, part: Column) -> DataFrame:
    """One row with a digest of all rows, whatever their order, and their number: lines sorted by their own digest within parts, parts in order.

    part: a number of few values that spreads the rows; no task holds more than a part, the last step one digest a part.
    """
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(rows.columns)]
    each = rows.select(part.alias("part"), F.sha2(F.concat_ws("\u001f", *texts), 256).alias("line"))
    parts = each.groupBy("part").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n"), 256).alias("digest"), F.count(F.lit(1)).alias("n"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "digest"))), lambda p: p["digest"]), "\n"), 256).alias("digest"), F.sum("n").alias("n"))
