"""Near duplicates by MinHash and a multi-index Hamming join (operator 9).

A document's set holds its distinct WIDTH-word shingles (ASCII letters lower-cased; fewer words: the whole
sequence as one shingle; no word: empty, linked with nothing). Documents of equal sets are one class from
the start. A class gets a signature of CHUNKS * SYMBOLS minima, 16 bits each. The signature is split into
chunks; by the pigeonhole principle two signatures that differ in at most CHUNKS * (ERRORS + 1) - 1 = 17
places have a chunk with at most ERRORS = 1 differing place. Every chunk is therefore indexed once per
place left out, and such a pair shares a key for certain. At a similarity of 0.8 a pair shares none of its
54 keys with probability 7e-5, above it less.

No bucket is ever expanded into its pairs. Rounds link bucket members to one pivot of the bucket (the least
class first, then the greatest), confirm the links on the full sets, and join components. Only buckets
that still hold several components are then compared inside, between components alone, in blocks of
signatures and of sketches of the sets; what may be linked is confirmed likewise. A pair within one component
needs no check.

Repeated rows of one id count as one document with all their sets; null ids are left out of linking.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Remembered
from .common import checkpointed, tidied

CHUNKS, SYMBOLS, ERRORS = 9, 6, 1
#: Differing places beyond which two signatures are not compared in full (4.5 standard errors above the mean at 0.8).
FAR = 24
PERCENT = 80
#: Shingles up to which a sketch holds the whole set, and members of one bucket that are compared in one block.
SKETCH, BLOCK = 512, 2048
#: Bits of the fixed-size filter of the documents whose sets are needed (2 MB).
FILTER_BITS = 24
_LEFT_OUT = [left for left in itertools.combinations(range(SYMBOLS), ERRORS)]
_random = np.random.RandomState(20240229)
_A = (_random.randint(0, 1 << 62, CHUNKS * SYMBOLS).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _random.randint(0, 1 << 62, CHUNKS * SYMBOLS).astype(np.uint64)
_M = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Rows whose texts or sets are held as Python objects at once, and words a worker remembers: workers live through many stages.
ROWS, WORDS = 256, 60_000
#: Rows that Spark hands a worker at once: whole sets of very long texts take some 160 kB each, on both sides of a pair.
HANDED = 128


def _word_numbers() -> Remembered:
    from xxhash import xxh3_64_intdigest

    return Remembered(xxh3_64_intdigest, WORDS)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most ROWS."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def shingles(text: str | None, width: int, numbers: dict) -> np.ndarray:
    """The sorted 64-bit numbers of a whole text's set."""
    words = text.encode().lower().split() if text else []  # bytes: only ASCII letters change, only ASCII space splits
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(numbers.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    number = np.full(len(words) - width + 1, np.uint64(width))
    for i in range(width):
        number = _mixed(number * _M + each[i : len(words) - width + 1 + i])
    return np.unique(number)


def signature(numbers: np.ndarray) -> np.ndarray:
    least = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(numbers), 4096):
        least = np.minimum(least, (numbers[None, i : i + 4096] * _A[:, None] + _B[:, None]).min(1))
    return (_mixed(least) >> np.uint64(48)).astype(np.uint16)


def signed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_id binary (null for an empty set), signature binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        numbers = _word_numbers()
        for batch in _sliced(batches):
            sizes, names, signatures = [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, width, numbers)
                sizes.append(len(found))
                names.append(xxh3_128_digest(found.tobytes()) if len(found) else None)
                signatures.append(signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(signatures, pa.binary())], ["doc_id", "n_shingles", "set_id", "signature"])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return kept.mapInArrow(tidied(run), "doc_id long, n_shingles long, set_id binary, signature binary")


def _chunk_keys(symbols: np.ndarray, number: int) -> np.ndarray:
    """(n, CHUNKS) keys of signatures (n, CHUNKS, SYMBOLS) for the number-th choice of places left out."""
    start = np.uint64(number + 1) + np.arange(CHUNKS, dtype=np.uint64) * np.uint64(len(_LEFT_OUT))
    key = np.repeat(start[None, :], len(symbols), 0)
    for place in range(SYMBOLS):
        if place not in _LEFT_OUT[number]:
            key = _mixed(key * _M + symbols[:, :, place])
    return key.view(np.int64)


def keys(classes: DataFrame) -> DataFrame:
    """(key, id): a key for every chunk and every choice of places left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                ids = part.column(0).to_numpy()
                symbols = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(len(ids), CHUNKS, SYMBOLS).astype(np.uint64)
                for number in range(len(_LEFT_OUT)):
                    yield pa.RecordBatch.from_arrays([pa.array(_chunk_keys(symbols, number).ravel()), pa.array(np.repeat(ids, CHUNKS))], ["key", "id"])

    return classes.select("id", "signature").mapInArrow(run, "key long, id long")


def sketch(numbers: np.ndarray) -> bytes:
    """Set size and the upper halves of the least numbers, as 32-bit integers: whole sets up to SKETCH, else a share 2 ** -t of them."""
    kept = np.unique((numbers[: np.searchsorted(numbers, np.uint64((1 << 64 >> _cut(len(numbers))) - 1), "right")] >> np.uint64(32)).astype(np.uint32))
    return np.concatenate([np.array([len(numbers)], np.uint32), kept]).tobytes()


def _cut(size: int) -> int:
    return max(0, math.ceil(math.log2(max(size, 1) / SKETCH)))


def likely(x: np.ndarray, y: np.ndarray, percent: int, spread: float = 5.0) -> bool:
    """Whether two sketches allow a similarity of percent: exact but for two hash collisions if no set is cut, else by `spread` standard errors."""
    t = max(_cut(int(x[0])), _cut(int(y[0])))
    x, y = x[1:], y[1:]
    if t:
        top = np.uint32((1 << 32 >> t) - 1)
        x, y = x[: np.searchsorted(x, top, "right")], y[: np.searchsorted(y, top, "right")]
    common = len(np.intersect1d(x, y, assume_unique=True))
    union, share = len(x) + len(y) - common, percent / 100
    return common + 2 >= share * union - (spread * math.sqrt(share * (1 - share) * union) if t else 0)


def sets_of(ids: DataFrame, docs: DataFrame, width: int, make: Callable[[np.ndarray], bytes]) -> DataFrame:
    """(id, set): make(shingle numbers) of the documents of ids (id), and perhaps of a few others."""
    spot = F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS))
    maps = ids.select(F.bitmap_bucket_number(spot).alias("n"), F.bitmap_bit_position(spot).alias("p")).groupBy("n").agg(F.bitmap_construct_agg("p").alias("bits")).collect()
    filter_ = {row["n"]: bytes(row["bits"]) for row in maps}  # at most 2 ** FILTER_BITS bits
    shared = docs.sparkSession.sparkContext.broadcast(filter_)

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, bits = _word_numbers(), shared.value
        for batch in _sliced(batches):
            buckets, places = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            hit = [n in bits and bool(bits[n][p >> 3] >> (p & 7) & 1) for n, p in zip(buckets, places)]
            held = batch.filter(pa.array(hit, pa.bool_()))
            sets = [make(shingles(text, width, numbers)) for text in held.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([held.column(0), pa.array(sets, pa.binary())], ["id", "set"])

    spots = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), "text")
    return spots.select("id", "text", F.bitmap_bucket_number(spot), F.bitmap_bit_position(spot)).mapInArrow(tidied(needed), "id long, set binary")


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")), docs, width, np.ndarray.tobytes)
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            hit = []
            for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                fits = 100 * min(len(x), len(y)) >= percent * max(len(x), len(y))
                common = len(np.intersect1d(x, y, assume_unique=True)) if fits else 0
                hit.append(fits and 100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return both.select("a", "b", "set_a", "set_b").mapInArrow(tidied(check), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every end of the links (a, b): the least id that can be reached."""
    both = checkpointed(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        around = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        moved = labels.join(around, "id").select("id", F.least("component", "near").alias("to"), F.col("component").alias("was"))
        jump = labels.select(F.col("id").alias("to"), F.col("component").alias("on"))
        after = checkpointed(moved.join(jump, "to", "left").select("id", F.least("to", F.coalesce("on", "to")).alias("component"), "was"))
        changed = after.where("component <> was").limit(1).count()
        labels = after.select("id", "component")
        if not changed:
            return labels


def _between(buckets: DataFrame, signatures: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components in one bucket whose sketches allow a link; buckets: (key, id, component).

    A bucket's members are dealt into blocks, and blocks meet in pairs, so a task never holds more than about
    two BLOCKs of one bucket. Of the buckets a pair shares it is looked at in one: that of the first chunk with
    at most one differing place, leaving out that place (the first, if none differs).
    """
    known = checkpointed(buckets)
    sketches = sets_of(known.select("id").distinct(), docs, width, sketch).groupBy("id").agg(F.collect_set("set").alias("sets"))
    blocks = known.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    rows = known.join(blocks, "key").withColumn("mine", mine).join(signatures, "id").join(sketches, "id")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "id", "component", "signature", "sets")
    rows = rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")

    def pairs(group: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(group)
        block, ids, of = (table.column(name).to_numpy() for name in ("mine", "id", "component"))
        symbols = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(len(ids), CHUNKS, SYMBOLS)
        here = table.column("key")[0].as_py()
        left, chunk = np.argwhere(np.concatenate([_chunk_keys(symbols[:1].astype(np.uint64), number) for number in range(len(_LEFT_OUT))]) == here)[0]
        sets = [[np.frombuffer(value, np.uint32) for value in several] for several in table.column("sets").to_pylist()]
        least = np.array([min(int(x[0]) for x in several) for several in sets])
        most = np.array([max(int(x[0]) for x in several) for several in sets])
        across = table.column("x")[0].as_py() != table.column("y")[0].as_py()
        for i in range(len(ids) - 1):
            rest = np.arange(i + 1, len(ids))
            fits = (of[rest] != of[i]) & (100 * most[rest] >= percent * least[i]) & (100 * most[i] >= percent * least[rest])
            if across:
                fits &= block[rest] != block[i]
            rest = rest[fits]
            differ = (symbols[rest] != symbols[i]).sum(2)
            near = (differ.sum(1) <= FAR) & ((differ <= ERRORS).argmax(1) == chunk) & ((differ[:, chunk] > 0) | (left == 0))
            hit = [j for j in rest[near] if any(likely(x, y, percent) for x in sets[i] for y in sets[j])]
            if hit:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), ids[i])), pa.array(ids[hit])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(3)]
            changes = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            cuts = [0, *changes.tolist(), batch.num_rows]
            for begin, end in zip(cuts[:-1], cuts[1:]):
                if begin == end:
                    continue
                now = tuple(int(c[begin]) for c in columns)
                if held and now != last:
                    yield from pairs(held)
                    held = []
                last = now
                held.append(batch.slice(begin, end - begin))
        if held:
            yield from pairs(held)

    return rows.mapInArrow(run, "a long, b long").distinct()


@contextmanager
def _handed(docs: DataFrame, rows: int) -> Iterator[None]:
    """Batches of so many rows for the Python stages that are planned within; the session's setting is put back."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, str(rows))
    try:
        yield
    finally:
        conf.set(name, before)


def grouped(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per id that is not null."""
    with _handed(docs, HANDED):  # every Python stage is written within
        return _grouped(docs, width, percent)


def _grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    known = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    each = checkpointed(signed(known, width))
    full = each.where(F.col("set_id").isNotNull())
    classes = checkpointed(full.groupBy("set_id").agg(F.min("doc_id").alias("id"), F.min("signature").alias("signature")))
    # an id with several sets joins their classes
    several = full.groupBy("doc_id").agg(F.min("set_id").alias("x"), F.max("set_id").alias("y")).where("x <> y").select("doc_id")
    twins = full.join(several, "doc_id").join(classes, "set_id").select(F.col("doc_id").alias("a"), F.col("id").alias("b")).where("a <> b").distinct()
    signatures = classes.select("id", "signature")
    index = keys(classes)
    shared = index.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high")
    buckets = checkpointed(index.join(shared, "key").select("key", "id", "low", "high", "n"))
    tested = checkpointed(buckets.where("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct())
    links = checkpointed(confirmed(tested, known, width, percent).union(twins))
    labels = components(links)

    def unresolved(labels: DataFrame) -> DataFrame:
        rows = buckets.where("n > 2").join(labels, "id", "left").select("key", "id", "low", "high", F.coalesce("component", "id").alias("component"))
        mixed = rows.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
        return rows.join(mixed, "key", "left_semi")

    rest = checkpointed(unresolved(labels))
    of_high = rest.where("id = high").select("key", F.col("component").alias("high_component"))
    again = rest.join(of_high, "key").where("component <> high_component").select(F.col("id").alias("a"), F.col("high").alias("b")).distinct()
    again = checkpointed(again.join(tested, ["a", "b"], "left_anti"))
    links = checkpointed(links.union(confirmed(again, known, width, percent)))
    labels = components(links)
    last = checkpointed(_between(unresolved(labels).select("key", "id", "component"), signatures, known, width, percent))
    found = checkpointed(confirmed(last, known, width, percent))
    if found.limit(1).count():
        links = checkpointed(links.union(found))
        labels = components(links)
    named = classes.join(labels, "id", "left").select("set_id", F.coalesce("component", "id").alias("component_id"))
    members = full.join(named, "set_id").select("doc_id", "n_shingles", "component_id")
    empty = each.where(F.col("set_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = members.unionByName(empty)
    return out.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
