"""The registered queries of this package and their SQL, where SQL can tell the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, langid, linededup, neardup, packing, quality, tokencount, topk, toxicity
from .common import read, remainder


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    asked = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text")
    )
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(asked)
    return chat.digests(chat.format_turns(rows, vocabulary()), vocabulary())


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality.report(read(spark, sf_dir, "documents"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rated.select("doc_id", *(F.col("_q")[n].alias(n) for n in names), quality.base_failed().alias("base_failed"), quality.keep().alias("kept"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.sequences(read(spark, sf_dir, "documents"), vocabulary())


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.cleaned(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return done.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.length("text").cast("long").alias("clean_chars"), F.md5("text").alias("clean_md5"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0))
    scored = toxicity.score(docs, model)
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return scored.select(
        "doc_id", held.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.col("_n_offending").alias("n_offending"), F.col("_worst_start").alias("worst_start"), F.col("_worst_length").alias("worst_length"),
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(read(spark, sf_dir, "documents"), vocabulary())


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), vocabulary())


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.learn(docs.where(remainder("doc_id", 3) != 1))
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op9_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.grouped(read(spark, sf_dir, "documents"), width=2)


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


_SPACE = "\\x20\\x09-\\x0D"

ORACLES: dict[str, str] = {
    # Exact counts; the quality verdict `kept` is left to tests, so SQL for op2 isn't given.
    "op4_line_dedup": f"""
WITH line AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place FROM documents
), rated AS (
  SELECT *, len(regexp_extract_all(line, '[^{_SPACE}]+')) >= 1 AS counts FROM line
), wide AS (
  SELECT line, min((doc_id, place)) AS first_at FROM rated WHERE counts GROUP BY line HAVING count(DISTINCT source) >= 5
), marked AS (
  SELECT r.doc_id, r.place, r.line, r.counts AND w.line IS NOT NULL AND w.first_at <> (r.doc_id, r.place) AS gone
  FROM rated r LEFT JOIN wide w ON r.line = w.line
), clean AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS text
  FROM marked GROUP BY doc_id
)
SELECT doc_id, n_lines, n_removed, length(text) AS clean_chars, md5(text) AS clean_md5 FROM clean
""",
    "op10_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id,
         list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_chat_formatting, op2_quality_rules, op3_best_fit_packing, op4_line_dedup, op5_toxicity,
            op6_token_counts, op7_bpe_round_trip, op8_language_id, op9_minhash_neardup, op10_exact_topk,
        )
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
