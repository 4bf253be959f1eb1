"""Helpers that the operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut as checkpointed
from ..sources.shared import shared_folder
from .bpe import forget

__all__ = ["checkpointed", "given_back", "read", "tidied", "remainder", "shared_folder"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data folder, by whatever file system its path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str, n: int) -> Column:
    """crc32 of a key's decimal text modulo n; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def given_back() -> None:
    """Memory that this process has freed goes back to the system; glibc keeps it otherwise, a driver for the rest of its life."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run: Callable[[Iterator], Iterator], encodes: bool = False) -> Callable[[Iterator], Iterator]:
    """run over batches, after which the worker gives its freed memory back: workers live through many stages.

    Encoders that an earlier stage has left (135 MB a worker after packing) go first, unless this stage encodes.
    """

    def through(batches: Iterator) -> Iterator:
        if not encodes:
            forget()
            given_back()
        yield from run(batches)
        given_back()

    return through
