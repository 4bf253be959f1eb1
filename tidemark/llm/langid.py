"""Language identification: multinomial naive Bayes over hashed character n-grams (operator 8).

Lower-cased characters give n-grams of one to three; their rolling hashes fall into 2**15 buckets. The
matrix of log probabilities (buckets x languages) is broadcast in blocks of BLOCK languages, 32 MB each;
scoring multiplies a document's non-zero bucket counts by its rows. With more languages than a block holds
every text is scored against one block after the other, so none is left out.

Learning counts whole texts of a sample: rows whose hashed id lies below a share of the language that gives
PER_LANGUAGE rows on average (all rows of smaller languages). Counts are summed where the rows are, so
neither a common language nor a repeated row gathers in one task. Only text is read from a row that is
scored. A null text, or one without a letter, gets ``und`` and score 0; a table with nothing to learn from
gives ``und`` everywhere. Rows stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 15
ORDERS = 3
#: Learning rows of one language, on average over the choice of ids.
PER_LANGUAGE = 1000
#: Languages of one broadcast matrix.
BLOCK = 256
SMOOTHING = 0.1


def buckets(text: str) -> np.ndarray:
    """Bucket numbers of all character n-grams of a text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    hashed, out = np.zeros(len(points), np.uint32), []
    for order in range(min(ORDERS, len(points))):
        hashed = (hashed[: len(points) - order] * np.uint32(0x01000193)) ^ points[order:]
        out.append((hashed * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


Model = list[tuple[list[str], np.ndarray, np.ndarray]]


def learn(rows: DataFrame) -> Model:
    """Blocks of languages, log priors and log-probability matrices from rows (doc_id, text, lang) to learn from."""
    known = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    total = {row["lang"]: row["count"] for row in known.groupBy("lang").count().collect()}
    order = sorted(total)
    return [_learned(known, order[i : i + BLOCK], total) for i in range(0, len(order), BLOCK)]


def _learned(known: DataFrame, order: list[str], total: dict[str, int]) -> tuple[list[str], np.ndarray, np.ndarray]:
    shares = known.sparkSession.createDataFrame([(lang, min(1.0, PER_LANGUAGE / total[lang])) for lang in order], "lang string, share double")
    # unsigned 32 bits of the hash as a number in [0, 1); a null id hashes too
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) / float(1 << 32)
    sample = known.join(F.broadcast(shares), "lang").where(spot < F.col("share"))
    place = {lang: i for i, lang in enumerate(order)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang not in sums:
                    sums[lang] = np.zeros(1 << BITS, np.int64)
                sums[lang] += np.bincount(buckets(text), minlength=1 << BITS)
        for lang, sum_ in sums.items():
            full = np.flatnonzero(sum_)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(full)), pa.array(full.astype(np.int32)), pa.array(sum_[full])], ["lang", "bucket", "n"])

    seen = sample.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    matrix = np.full((1 << BITS, len(order)), SMOOTHING)
    np.add.at(matrix, (seen["bucket"].to_numpy(np.int64), seen["lang"].map(place).to_numpy(np.int64)), seen["n"].to_numpy(float))
    prior = np.log(np.array([total[lang] for lang in order], float) / sum(total.values()))
    return order, prior, (np.log(matrix) - np.log(matrix.sum(0))).astype(np.float32)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""
    kept = docs.select("doc_id", "text")
    if not model:
        return kept.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    for block in model:
        kept = _scored(kept, block)
    return kept.select("doc_id", F.coalesce("_lang", F.lit("und")).alias("lang_pred"), F.coalesce(F.exp(F.col("_z") - F.col("_sum")), F.lit(0.0)).alias("score"))


def _scored(docs: DataFrame, block: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """docs with the best language so far, its log score, and the logarithm of the sum over all languages so far."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    before = "_lang" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, prior, matrix = shared.value
        for batch in batches:
            names, best_z, sums = (batch.column(i).to_pylist() if before else [None] * batch.num_rows for i in (2, 3, 4))
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text is None or not any(map(str.isalpha, text)):
                    continue
                counts = np.bincount(buckets(text), minlength=1 << BITS)
                full = np.flatnonzero(counts)
                z = prior + counts[full].astype(np.float32) @ matrix[full]
                best = int(z.argmax())
                sum_ = float(z[best] + np.log(np.exp(z - z[best]).sum()))
                sums[i] = sum_ if sums[i] is None else float(np.logaddexp(sums[i], sum_))
                if best_z[i] is None or z[best] > best_z[i]:
                    names[i], best_z[i] = languages[best], float(z[best])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(best_z, pa.float64()), pa.array(sums, pa.float64())], ["doc_id", "text", "_lang", "_z", "_sum"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, _lang string, _z double, _sum double")
