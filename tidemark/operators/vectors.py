"""Nearest concepts by cosine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The concepts of a vocabulary are held whole by every task; more than this many are refused.
MOST_CONCEPTS = 10_000


def concepts(rows: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(concept, mean array<double>): the mean vector of every label, summed place by place."""
    each = rows.where(F.col(label).isNotNull()).select(F.col(label).alias("concept"), F.posexplode(vector).alias("place", "x"))
    means = each.groupBy("concept", "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("concept").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("mean"))


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)


def nearest_concepts(rows: DataFrame, concepts: DataFrame, k: int = 2, floor: float = 0.45, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, concept, similarity, place: up to k concepts of at least the floor per vector, ties to the smaller concept.

    The concepts become an array that every row is scored against, so rows aren't multiplied or shuffled.
    Similarities have six places. Null vectors and vectors of length zero have no concepts.
    """
    if concepts.limit(MOST_CONCEPTS + 1).count() > MOST_CONCEPTS:
        raise ValueError(f"more than {MOST_CONCEPTS} concepts")
    held = concepts.agg(F.sort_array(F.collect_list(F.struct("concept", "mean"))).alias("_concepts"))
    size = lambda v: F.sqrt(dot(v, v))
    scored = F.transform("_concepts", lambda c: F.struct((-F.round(dot(F.col(vector), c["mean"]) / (size(F.col(vector)) * size(c["mean"])), 6)).alias("far"), c["concept"].alias("concept")))
    usable = rows.where(F.col(vector).isNotNull()).where(size(F.col(vector)) > 0)
    best = F.slice(F.sort_array(F.filter(scored, lambda s: s["far"] <= -floor)), 1, k)
    out = usable.join(F.broadcast(held)).select(key, F.posexplode(best).alias("_at", "_s"))
    return out.select(key, F.col("_s")["concept"].alias("concept"), (-F.col("_s")["far"]).alias("similarity"), (F.col("_at") + 1).alias("place"))
