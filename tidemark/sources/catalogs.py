"""Sources and sinks of catalogs: nested submissions, headers, runs that are whole or refused, JSON lines, catalogs by key.

Everything is written through Spark to a folder that all machines see. A run's manifest is written last and
is its commit: without it the run is partial and isn't opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class PartialRun(ValueError):
    """A run without its manifest, or with other rows than it says."""


def transposed(rows: DataFrame, arrays: str, *keep: str) -> DataFrame:
    """A struct of parallel arrays as rows, as many as the shortest array has; `at` is the place."""
    names = [f.name for f in rows.schema[arrays].dataType.fields]
    fewest = F.least(*(F.size(F.col(arrays)[n]) for n in names))
    zipped = F.slice(F.arrays_zip(*(F.col(arrays)[n].alias(n) for n in names)), 1, F.greatest(fewest, F.lit(0)))
    out = rows.select(*keep, F.posexplode(zipped).alias("at", "_row"))
    return out.select(*keep, "at", *(F.col("_row")[n].alias(n) for n in names))


def filings(submissions: DataFrame, forms: list[str], since: str, until: str, amendments: bool) -> DataFrame:
    """(company, accession, form, filed) of wanted forms filed in a span, both days included.

    submissions: company, recent (struct of the arrays accession, form, filed). Amendments ("/A") count as their form if asked for.
    """
    rows = transposed(submissions, "recent", "company")
    bare = F.upper(F.trim("form"))
    wanted = F.regexp_replace(bare, "/A$", "") if amendments else bare
    return rows.where(wanted.isin(*forms) & F.col("filed").between(since, until)).select("company", "accession", bare.alias("form"), "filed")


def header_documents(headers: DataFrame, key: str) -> DataFrame:
    """(key, type, sequence, name, description) of every document block of a tagged header text; tags end at the line."""
    blocks = headers.select(key, F.explode(F.regexp_extract_all("text", F.lit(r"(?s)<DOCUMENT>(.*?)</DOCUMENT>"), 1)).alias("b"))
    tag = lambda name: F.nullif(F.trim(F.regexp_extract("b", rf"(?m)^<{name}>([^\r\n]*)", 1)), F.lit(""))
    return blocks.select(key, tag("TYPE").alias("type"), tag("SEQUENCE").try_cast("int").alias("sequence"), tag("FILENAME").alias("name"), tag("DESCRIPTION").alias("description"))


def fetch_plan(expected: DataFrame, landed: DataFrame, key: str) -> DataFrame:
    """expected with `status`: complete, damaged (another digest) or missing; what landed unasked is `unexpected`. Both have key and sha."""
    both = expected.select(key, F.col("sha").alias("_want")).join(landed.select(key, F.col("sha").alias("_have")), key, "full_outer")
    status = F.when(F.col("_want").isNull(), "unexpected").when(F.col("_have").isNull(), "missing").when(F.col("_want") == F.col("_have"), "complete").otherwise("damaged")
    return both.select(key, status.alias("status"))


def write_run(folder: str, frames: dict[str, DataFrame], **facts: str) -> None:
    """Each frame as Parquet, then the manifest with their row counts. An existing run is never written over."""
    spark = next(iter(frames.values())).sparkSession
    counts = []
    for name, frame in sorted(frames.items()):
        frame.write.mode("errorifexists").parquet(f"{folder}/{name}")
        counts.append((name, spark.read.parquet(f"{folder}/{name}").count()))
    rows = spark.createDataFrame(counts, "name string, n long").withColumns({k: F.lit(v) for k, v in sorted(facts.items())})
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{folder}/manifest")


def open_run(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The frames of a run that is whole."""
    try:
        manifest = spark.read.parquet(f"{folder}/manifest").collect()
    except Exception as error:
        raise PartialRun(f"{folder} has no manifest") from error
    frames = {row["name"]: spark.read.parquet(f"{folder}/{row['name']}") for row in manifest}
    for row in manifest:
        if frames[row["name"]].count() != row["n"]:
            raise PartialRun(f"{folder}/{row['name']} has other rows than its manifest says")
    return frames


def write_lines(rows: DataFrame, path: str, *order: str) -> None:
    """JSON lines in order, properties by name."""
    names = sorted(rows.columns)
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def read_lines(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """JSON lines by a stated schema: strict fails at the first bad line, else bad lines stay in `bad` and the rest is null."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    wide = T.StructType([*schema.fields, T.StructField("bad", T.StringType())])
    rows = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad").json(path)
    return rows.select(*(F.when(F.col("bad").isNull(), F.col(f.name)).alias(f.name) for f in schema.fields), "bad")


def catalogued(rows: DataFrame, key: str, order: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, duplicates, without a key): of each key the first row by order, and keys that stand several times.

    A key's rows are combined where they lie, so that a key with very many is no task of its own.
    """
    named = rows.where(F.col(key).isNotNull())
    first = named.groupBy(key).agg(F.min_by(F.struct(*rows.columns), order).alias("r"), F.count(F.lit(1)).alias("n"))
    return first.select("r.*"), first.where("n > 1").select(key, "n"), rows.where(F.col(key).isNull())


def of_latest_run(rows: DataFrame) -> DataFrame:
    """Rows of the greatest run id, without it; rows without a run are of none."""
    latest = rows.agg(F.max("run_id").alias("run_id"))
    return rows.join(F.broadcast(latest), "run_id").drop("run_id")  # one row


def tagged(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows of several kinds as (kind, payload): one text of JSON a row."""
    out = None
    for kind, frame in frames.items():
        rows = frame.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*sorted(frame.columns))).alias("payload"))
        out = rows if out is None else out.unionByName(rows)
    return out


def untagged(rows: DataFrame, kind: str, schema: str) -> DataFrame:
    """Rows of one kind in their columns; a payload that doesn't fit gives nulls."""
    return rows.where(F.col("kind") == kind).select(F.from_json("payload", schema).alias("p")).select("p.*")


def vector_key(text: Column) -> Column:
    """Key of a text's vector: the digest of its words in lower case with single spaces."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")), 256)
