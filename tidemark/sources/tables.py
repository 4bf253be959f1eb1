"""Tables of a data folder, and Spark SQL over them."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from .shared import cut

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, sql: str, frames: dict[str, DataFrame] | None = None) -> DataFrame:
    """Spark SQL over the tables and frames that the text names; only those are opened.

    Each call has view names of its own and drops them once the text is resolved, so that folders don't meet.
    """
    known = {name: frame for name, frame in (frames or {}).items() if _names(sql, name)}
    known |= {name: read(spark, sf_dir, name) for name in TABLES if name not in known and _names(sql, name)}
    call = uuid.uuid4().hex
    for name in known:
        sql = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 v_{name}_{call}", sql)
    try:
        for name, frame in known.items():
            frame.createOrReplaceTempView(f"v_{name}_{call}")
        return spark.sql(sql)
    finally:
        for name in known:
            spark.catalog.dropTempView(f"v_{name}_{call}")


def _names(sql: str, name: str) -> bool:
    return re.search(rf"\b(?:FROM|JOIN) {name}\b", sql) is not None


def run_staged(spark: SparkSession, sf_dir: str, sql: str, parts: dict[str, str], stages: Iterable[str]) -> DataFrame:
    """Spark SQL over parts (name: text), of which those in stages are written once where the text needs them.

    A relation that many others mention is planned and read once so; its columns are columns, also where its text has constants.
    """
    stages, frames = set(stages), {}

    def needed(text: str) -> list[str]:
        """The parts that a text needs, each after those it needs; what is written already needs nothing."""
        order: list[str] = []

        def visit(text: str) -> None:
            for name in parts:
                if name not in order and name not in frames and _names(text, name):
                    visit(parts[name])
                    if name not in order:
                        order.append(name)

        visit(text)
        return order

    def run(text: str) -> DataFrame:
        while (first := next((name for name in needed(text) if name in stages), None)) is not None:
            frames[first] = cut(run(parts[first]))
        inner = needed(text)
        head = f"WITH {', '.join(f'{name} AS ({parts[name].strip()})' for name in inner)} " if inner else ""
        return run_sql(spark, sf_dir, head + text, frames)

    return run(sql)
