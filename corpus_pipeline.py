"""A training corpus from documents: toxicity, quality, boilerplate lines, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; run() writes it and reads it again as the next
stage's docs. All stages but the last return the columns of documents, extra ones among them, and an empty
table gives an empty one. A null text is an empty text to toxicity, quality (which rejects it for its few
words) and packing, and passes line dedup as it is; a null id takes no part in first occurrences and in
near-duplicate groups, so its rows pass. Repeated rows are judged alike; near-duplicate removal leaves one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import linededup, neardup, packing, quality, toxicity
from tidemark.llm.common import read, remainder, shared_folder
from tidemark.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; the same folds are left out of training as in op5."""
    model = toxicity.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0))
    return toxicity.score(docs, model).where(F.col("_score") < toxicity.THRESHOLD).select(*docs.columns)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are good by the posterior of the weak rules."""
    return quality.rated(docs).where("_keep").select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand on many sites; n_chars follows the text. One that loses all its words so is dropped: its lines stand where they occurred first."""
    done = linededup.cleaned(docs)
    emptied = (F.col("_n_removed") > 0) & ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    done = done.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("_n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by five-word shingles and a similarity of 0.8 or more; of rows repeated under one id the least. Rows without an id stay."""
    gone = neardup.grouped(docs).where(~F.col("kept")).select("doc_id")
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("doc_id IS NOT NULL AND n > 1").select("doc_id")
    if not again.limit(1).count():
        return left
    one = left.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*")
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(one)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return packing.sequences(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_poor),
    ("line dedup", drop_boilerplate),
    ("MinHash near-dedup", drop_near_duplicates),
    ("best-fit packing", pack),
]

#: Training, EM and the genetic algorithm can't be told in SQL; tests hold every stage and the whole against plain formulations on small documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of a data folder."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
