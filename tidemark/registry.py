"""All queries of the library with their SQL, gathered from the modules that define them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import built, evidence, lane, named, packages, printed, recorded, stores, story, vocab

_MODULES = (named, built, printed, story, lane, vocab, evidence, stores, packages, recorded)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in _MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
