"""The portable queries as functions of (spark, sf_dir), and their text for an independent engine."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import run_staged
from .apart import APART
from .portable import PARTS, compose
from .portable import QUERIES as _TEXTS
from .portable import metric_history as _history


#: Parts that are written once in a query that needs them: small aggregates that many parts mention.
STAGES = ("revenue", "gross_revenue", "observation", "gross_observation", "point", "gross_point", "step", "fired", "candidate", "anchored", "scored")


def _run(sql: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    # Spark replaces all matches without the flag that other engines ask for
    parts = {name: text.replace(", 'g')", ")") for name, text in PARTS.items()}
    return run_staged(spark, sf_dir, sql.replace(", 'g')", ")"), parts, STAGES)


def _other(sql: str) -> str:
    """The text for an engine that says ANTI JOIN without LEFT."""
    return sql.replace("LEFT ANTI JOIN", "ANTI JOIN")


def metric_history(spark: SparkSession, sf_dir: str, since: int | None = None, until: int | None = None) -> DataFrame:
    return _run(_history(since, until), spark, sf_dir)


QUERIES = {name: partial(_run, text) for name, text in _TEXTS.items()} | {"metric_history": metric_history}
ORACLES = {name: APART.get(name) or _other(compose(text)) for name, text in _TEXTS.items()}
