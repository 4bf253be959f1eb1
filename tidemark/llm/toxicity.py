"""Toxicity by multiple-instance learning (operator 5).

A document is a bag of sentences. Each sentence's probability is logistic in the words it contains; the
document's is their noisy-or, 1 - prod(1 - p). A word counts as itself and by its beginning. Only document labels are needed to train the weights, and
the sentences that carry a document's score are then located.

Training uses a bounded sample: of the labelled ids the SAMPLE whose hash is smallest, in that order as far
as their hashed words take SAMPLE_BYTES; whole texts, one (the greatest) of an id that is repeated. Sentences
end at newlines and after ``. ! ?``; one without words (marks alone) is none, in training and scoring alike.
A null or empty text is one sentence without words: it gets the score of the bias alone. Rows stay as they
are; with no labelled row every score is 0.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Remembered
from .common import checkpointed, given_back, tidied

BITS = 18
#: Labelled documents that training reads at most.
SAMPLE = 5000
#: Bytes of their hashed words (four each) that the driver takes at most.
SAMPLE_BYTES = 32 << 20
#: Letters of a word's beginning.
PREFIX = 4
#: Screening: a feature stays if the documents of either label that hold it stray so many standard errors.
STRAYS = 1.5
#: Words must occur in so many sampled documents to get a weight.
LEAST_DOCUMENTS = 2
ROUNDS = 200
STEP = 0.25
L1 = 0.2
THRESHOLD = 0.5
_ENDS = str.maketrans(".!?", "\n\n\n")
_MARKS = ".,;:!?\"'()[]{}<>*#$%&|~-_"


def buckets(word: str) -> tuple[int, ...]:
    """The numbers of a word, without case and marks around it, and of its beginning; none if nothing is left."""
    word = word.strip(_MARKS).lower()
    if not word:
        return ()
    return tuple(zlib.crc32(part.encode()) & ((1 << BITS) - 1) for part in ({word, f"{word[:PREFIX]}-"} if len(word) > PREFIX else {word}))


def sentences(text: str | None) -> list[str]:
    return (text or "").translate(_ENDS).split("\n")


def bags(rows: DataFrame) -> DataFrame:
    """(doc_id, toxic, words binary, sizes binary): per document the distinct buckets of its sentences, and how many each has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Remembered(buckets, 60_000)
        for batch in batches:
            words, sizes = [], []
            for text in batch.column(0).to_pylist():
                sets = [{n for w in s.split() for n in numbers[w]} for s in sentences(text)]
                sets = [s for s in sets if s] or [set()]
                words.append(np.array([w for s in sets for w in sorted(s)], np.int32).tobytes())
                sizes.append(np.array([len(s) for s in sets], np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(words, pa.binary()), pa.array(sizes, pa.binary())], ["doc_id", "toxic", "words", "sizes"])

    asked = rows.select("text", "doc_id", F.col("toxic").cast("int").alias("toxic"))
    return asked.mapInArrow(run, f"doc_id {asked.schema['doc_id'].dataType.simpleString()}, toxic int, words binary, sizes binary")


def train(docs: DataFrame, labels: DataFrame) -> tuple[float, np.ndarray]:
    """(bias, weights by bucket) from documents and the labels (doc_id, toxic) that may be learned from."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = bags(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    one = checkpointed(rows.groupBy("doc_id").agg(F.max(F.struct("words", "sizes", "toxic")).alias("r")).select("doc_id", "r.*", F.xxhash64("doc_id").alias("h")))
    room, taken = SAMPLE_BYTES, []
    for row in one.select("doc_id", "h", F.octet_length("words").alias("n")).sort("h", "doc_id").collect():
        room -= row["n"]
        if room < 0:
            break
        taken.append((row["doc_id"],))
    if not taken:
        return fit([])
    kept = one.join(F.broadcast(one.sparkSession.createDataFrame(taken, one.select("doc_id").schema)), "doc_id").collect()
    model = fit([(row["toxic"], np.frombuffer(row["words"], np.int32), np.frombuffer(row["sizes"], np.int32)) for row in kept])
    del kept
    given_back()
    return model


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray]:
    weights = np.zeros(1 << BITS)
    if not rows:
        return -50.0, weights
    rows.sort(key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))
    y = np.array([r[0] for r in rows], bool)
    n_sentences = np.array([len(r[2]) for r in rows])
    document = np.repeat(np.arange(len(rows)), n_sentences)
    # a document at a time, so that words which get no weight are never held all at once
    n, n_toxic = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for toxic, row in zip(y, rows):
        once = np.unique(row[1])
        n[once] += 1
        n_toxic[once] += toxic
    expected = n * y.mean()
    strays = np.abs(n_toxic - expected) >= STRAYS * np.sqrt(np.maximum(expected * (1 - y.mean()), 1e-9))
    names = np.flatnonzero(strays & (n >= LEAST_DOCUMENTS))
    place = np.full(1 << BITS, -1)
    place[names] = np.arange(len(names))
    words, sentence, start = [], [], 0
    for _, found, sizes in rows:
        at = place[found]
        words.append(at[at >= 0])
        sentence.append((start + np.repeat(np.arange(len(sizes)), sizes))[at >= 0])
        start += len(sizes)
    words, sentence = np.concatenate(words), np.concatenate(sentence)
    w, bias = np.zeros(len(names)), math.log(max(y.mean(), 1e-3) / n_sentences.mean())
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for t in range(1, ROUNDS + 1):
        z = bias + np.bincount(sentence, w[words], len(document))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.exp(np.bincount(document, np.log1p(-np.minimum(p, 1 - 1e-9)), len(rows)))
        pull = np.where(y, none / np.maximum(1 - none, 1e-6), -1.0)[document] * p  # of the log likelihood, by z
        gradient = np.append(np.bincount(words, pull[sentence], len(names)), pull.sum())
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        step = STEP / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        moved = np.append(w, bias) + step * m / (1 - 0.9**t)
        w, bias = np.sign(moved[:-1]) * np.maximum(np.abs(moved[:-1]) - step[:-1] * L1, 0), moved[-1]
    weights[names] = w
    return float(bias), weights


def score(docs: DataFrame, model: tuple[float, np.ndarray]) -> DataFrame:
    """docs with ``_score``, ``_n_offending`` (sentences of p >= THRESHOLD), and ``_worst_start``, ``_worst_length``, ``_worst_p`` of the worst one; columns of these names are replaced."""
    bias, weights = model
    docs = docs.drop("_score", "_n_offending", "_worst_start", "_worst_length", "_worst_p")
    full = np.flatnonzero(np.abs(weights) > 1e-3)
    shared = docs.sparkSession.sparkContext.broadcast((bias, dict(zip(full.tolist(), weights[full].tolist()))))
    at = docs.columns.index("text")
    names = [*docs.columns, "_score", "_n_offending", "_worst_start", "_worst_length", "_worst_p"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, known = shared.value
        weight = Remembered(lambda word: sum(known.get(n, 0.0) for n in buckets(word)), 60_000)
        of, told = weight.__getitem__, Remembered(lambda word: bool(buckets(word)), 60_000).__getitem__
        quiet = math.log1p(math.exp(bias))
        for batch in batches:
            out = []
            for text in batch.column(at).to_pylist():
                log_none, offending, worst, start = 0.0, 0, (-1.0, 0, 0), 0
                for s in sentences(text):
                    words = s.split()
                    z = sum(map(of, words))
                    if z:
                        # what words share counts once, as in training
                        z = bias + sum(known.get(n, 0.0) for n in {n for word in words if of(word) for n in buckets(word)})
                        loss, p = math.log1p(math.exp(min(z, 30.0))), 1 / (1 + math.exp(-max(-30.0, min(z, 30.0))))
                    else:
                        loss, p = (quiet if any(map(told, words)) else 0.0), 1 / (1 + math.exp(-bias))
                    log_none -= loss
                    offending += p >= THRESHOLD
                    if p > worst[0]:
                        worst = (p, start, len(s))
                    start += len(s) + 1
                out.append((1 - math.exp(log_none or -quiet), offending, worst[1], worst[2], worst[0]))
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.float64(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    kinds = (T.DoubleType(), T.IntegerType(), T.LongType(), T.LongType(), T.DoubleType())
    return docs.mapInArrow(tidied(run), T.StructType([*docs.schema.fields, *map(T.StructField, names[-5:], kinds)]))
