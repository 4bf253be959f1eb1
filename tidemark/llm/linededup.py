"""Removal of boilerplate lines by the spread of sites they stand on (operator 4).

A line counts if it has at least LEAST_WORDS words. Its spread is the number of distinct sites among the
documents that hold it. HyperLogLog sketches of sites, filled from the lines where they lie and merged per
line hash, estimate the spread. Only lines whose estimate is near the threshold are counted exactly, after
their rows have been combined by line and site. A line with a spread of MIN_SITES or more is boilerplate: it stays
where it occurs first (smallest document, then place) and goes everywhere else, so that no text is lost.

Lines are compared whole, through 64-bit hashes. Null sites are no site; null texts and ids pass through
unchanged. Repeated rows are one site each time; a first occurrence in repeated rows stays in all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed

MIN_SITES = 5
LEAST_WORDS = 1
#: Precision of the sketches (2 ** LG_K registers, standard error about 1.04 / sqrt(2 ** LG_K)) and the
#: band around the threshold, in standard errors, in which lines are counted exactly.
LG_K, BAND = 10, 5
#: Boilerplate lines that are broadcast at most (40 bytes each); more are joined.
BROADCAST_LINES = 200_000


def lines(docs: DataFrame, site: str = "source") -> DataFrame:
    """(doc_id, site, at, line hash): every line with LEAST_WORDS words or more."""
    each = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.col(site).cast("string").alias("site"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return each.where(F.regexp_count("line", F.lit("[^\\x20\\x09-\\x0D]+")) >= LEAST_WORDS).select("doc_id", "site", "at", F.xxhash64("line").alias("hash"))


def boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(hash, first_doc, first_at, n_sites) of the lines that stand on min_sites sites or more."""
    every = lines(docs, site)
    # sketches are filled where the lines are and merged by line, so a frequent line moves once a task
    sketched = every.groupBy("hash").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min(F.struct("doc_id", "at")).alias("first"))
    margin = BAND * 1.04 / (1 << LG_K) ** 0.5 * min_sites + 1
    estimate = F.hll_sketch_estimate("sketch")
    spread = checkpointed(sketched.select("hash", "first", estimate.alias("estimate")).where(F.col("estimate") >= min_sites - margin))
    near = spread.where(F.col("estimate") <= min_sites + margin).select("hash")
    few = near.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    # combined by line and site before lines meet: what is left of a line near the threshold are a few sites
    sites = every.where(F.col("site").isNotNull())
    if few:
        sites = sites.join(F.broadcast(near), "hash", "left_semi").groupBy("hash", "site").agg(F.count(F.lit(1)).alias("n"))
    else:
        sites = sites.groupBy("hash", "site").agg(F.count(F.lit(1)).alias("n")).join(near, "hash", "left_semi")
    counted = sites.groupBy("hash").agg(F.count(F.lit(1)).alias("n_sites")).where(F.col("n_sites") >= min_sites)
    sure = spread.where(F.col("estimate") > min_sites + margin).select("hash", F.col("estimate").cast("long").alias("n_sites"))
    return sure.unionByName(counted).join(spread, "hash").select("hash", F.col("first.doc_id").alias("first_doc"), F.col("first.at").alias("first_at"), "n_sites")


def cleaned(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """docs with its text less boilerplate, and ``_n_lines``, ``_n_removed`` (columns of these names are replaced); all rows and other columns stay."""
    docs = docs.drop("_n_lines", "_n_removed")
    wide = checkpointed(boilerplate(docs, site, min_sites))
    if wide.count() <= BROADCAST_LINES:
        return _by_broadcast(docs, wide)
    removed = lines(docs, site).join(wide, "hash").where((F.col("doc_id") != F.col("first_doc")) | (F.col("at") != F.col("first_at")))
    gone = removed.groupBy("doc_id").agg(F.collect_set("at").alias("places"))
    joined = docs.alias("d").join(gone.alias("g"), F.col("d.doc_id") == F.col("g.doc_id"), "left")
    places, parts = F.col("g.places"), F.split(F.col("d.text"), "\n")
    kept = F.array_join(F.filter(parts, lambda line, at: ~F.array_contains(F.coalesce(places, F.array().cast("array<int>")), at)), "\n")
    text = F.when(places.isNull(), F.col("d.text")).otherwise(kept).alias("text")
    return joined.select(
        *(text if c == "text" else F.col(f"d.`{c}`") for c in docs.columns), F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("_n_lines"), F.coalesce(F.size(places), F.lit(0)).cast("long").alias("_n_removed"),
    )


def _by_broadcast(docs: DataFrame, wide: DataFrame) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast({row["hash"]: (row["first_doc"], row["first_at"]) for row in wide.toLocalIterator()})
    text_at, key_at = docs.columns.index("text"), docs.columns.index("doc_id")
    names = [*docs.columns, "_n_lines", "_n_removed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        first = shared.value
        for batch in batches:
            texts, counts, removed = [], [], []
            for key, text in zip(batch.column(key_at).to_pylist(), batch.column(text_at).to_pylist()):
                parts = [] if text is None else text.split("\n")
                gone = set()
                for at, line in enumerate(parts) if key is not None else ():
                    if len(line) >= 2 * LEAST_WORDS - 1:
                        number = xxh64_intdigest(line.encode(), 42)
                        where = first.get(number - (1 << 64) if number >> 63 else number)
                        if where is not None and where != (key, at):
                            gone.add(at)
                texts.append("\n".join(p for i, p in enumerate(parts) if i not in gone) if gone else text)
                counts.append(len(parts))
                removed.append(len(gone))
            columns = list(batch.columns)
            columns[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_n_lines", T.LongType()), T.StructField("_n_removed", T.LongType())]))
