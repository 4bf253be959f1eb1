"""Packing into sequences by a grouping genetic algorithm on islands (operator 3).

Every document becomes its ids and an end id; one longer than a sequence is cut into full pieces, the first
taking what is left over. Full pieces are sequences of their own. The others go into blocks of about BLOCK
pieces. Each block is evolved on ISLANDS islands: a chromosome is a set of bins; crossover injects whole
well-filled bins of one parent into the other, removes the bins that then hold a piece twice, and best-fits
the displaced pieces. After an epoch each island sends its elite to the next island; after the last the
fittest of a block's islands wins. Pieces of a block's poorly filled bins are packed once more together
with those of other blocks, so that blocks cost no sequences.

A null or empty text is its end id alone. Repeated rows are packed each; a null id stays null.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import RankMerger, encoder, forget
from .common import checkpointed, given_back, tidied

LENGTH = 1024
END = 2
BLOCK = 4000
ISLANDS, EPOCHS, POPULATION = 3, 2, 4
#: An epoch ends after so many generations in succession without a fitter chromosome.
PATIENCE = 24
#: Bins with more free room than this are dissolved and packed once more.
SLACK = 8


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and key, which tells pieces apart."""
    kept = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, RankMerger)
        closing = end.to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                packed = coder.packed(text) + closing
                n = len(packed) // 4
                begin, piece = 0, 0
                while begin < n:
                    stop = begin + ((n - begin) % length or length)
                    rows.append((key, piece, begin, stop - begin, zlib.crc32(packed[4 * begin : 4 * stop])))
                    begin, piece = stop, piece + 1
            columns = list(zip(*rows)) or [()] * 5
            kinds = [batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return kept.mapInArrow(tidied(run, encodes=True), f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def best_fit(bins: list[list[int]], sizes: list[int], items: list[int], length: int) -> None:
    """Put items (longest first) where they leave least room, opening bins as needed."""
    room: list[list[int]] = [[] for _ in range(length + 1)]
    mask = 0
    for at, held in enumerate(bins):
        left = length - sum(sizes[i] for i in held)
        if left:
            room[left].append(at)
            mask |= 1 << left
    for item in sorted(items, key=lambda i: (-sizes[i], i)):
        size = sizes[item]
        fits = mask >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            at = room[left].pop()
            if not room[left]:
                mask ^= 1 << left
            bins[at].append(item)
        else:
            left, at = length, len(bins)
            bins.append([item])
        left -= size
        if left:
            room[left].append(at)
            mask |= 1 << left


def fitness(bins: list[list[int]], sizes: list[int], length: int) -> tuple[int, int]:
    """Fewer bins first, then fuller ones."""
    return len(bins), -sum(sum(sizes[i] for i in held) ** 2 for held in bins)


def crossed(mother: list[list[int]], father: list[list[int]], sizes: list[int], length: int, chance: random.Random) -> list[list[int]]:
    """Injects well-filled bins of the father into the mother; whom that displaces is best-fitted."""
    fill = lambda held: sum(sizes[i] for i in held)
    well = [held for held in father if fill(held) >= length - SLACK] or sorted(father, key=fill)[-1:]
    share = chance.uniform(0.2, 0.6)
    injected = [held for held in well if chance.random() < share]
    taken = {i for held in injected for i in held}
    kept, displaced = [], []
    for held in mother:
        if taken.isdisjoint(held) and (fill(held) >= length - SLACK or chance.random() < 0.5):
            kept.append(list(held))
        else:
            displaced += [i for i in held if i not in taken]
    child = [*map(list, injected), *kept]
    best_fit(child, sizes, displaced, length)
    return child


def evolve(sizes: list[int], first: list[list[list[int]]], length: int, seed: int) -> list[list[list[int]]]:
    """The population, fittest first, once PATIENCE generations brought nothing fitter or the bins can't be fewer."""
    chance = random.Random(seed)
    least = -(-sum(sizes) // length)
    population = [[list(held) for held in one] for one in first]
    while len(population) < POPULATION:
        one: list[list[int]] = []
        order = list(range(len(sizes)))
        if population:  # a different start: some pieces come first, in any order
            chance.shuffle(order)
            best_fit(one, sizes, order[: len(order) // 4], length)
            order = order[len(order) // 4 :]
        best_fit(one, sizes, order, length)
        population.append(one)
        if len(one) <= least:
            break
    rated = sorted(((fitness(one, sizes, length), at, one) for at, one in enumerate(population)), key=lambda x: x[:2])
    made, idle = len(rated), 0
    while len(rated) > 1 and idle < PATIENCE and rated[0][0][0] > least:
        mother, father = chance.sample(rated[: max(2, len(rated) // 2 + 1)], 2)
        child = crossed(mother[2], father[2], sizes, length, chance)
        best = rated[0][0]
        rated = sorted([*rated, (fitness(child, sizes, length), made, child)], key=lambda x: x[:2])[:POPULATION]
        made, idle = made + 1, 0 if rated[0][0] < best else idle + 1
    return [one for _, _, one in rated]


def _chromosomes(table: pd.DataFrame) -> tuple[list[int], list[list[list[int]]]]:
    """Sizes by item number, and the bins of each elite that came in."""
    items = table.drop_duplicates("item").sort_values("item")
    place = {item: at for at, item in enumerate(items["item"].tolist())}
    first = []
    for _, one in table[table["bin"] >= 0].groupby("elite"):
        bins: dict[int, list[int]] = {}
        for item, number in zip(one["item"].tolist(), one["bin"].tolist()):
            bins.setdefault(number, []).append(place[item])
        if sum(map(len, bins.values())) == len(place):
            first.append(list(bins.values()))
    return items["size"].tolist(), first


_STATE = "block int, island int, elite int, item int, size int, bin int"


def packed_blocks(numbered: DataFrame, length: int = LENGTH) -> DataFrame:
    """(block, item, bin, offset, free) from (block, item, size): the winner of each block's islands."""
    islands = F.explode(F.array(*(F.lit(i) for i in range(ISLANDS)))).alias("island")
    state = numbered.select("block", islands, F.lit(0).alias("elite"), "item", "size", F.lit(-1).alias("bin"))

    def epoch(number: int):
        def run(key: tuple[int, ...], table: pd.DataFrame) -> pd.DataFrame:
            forget()
            given_back()
            block, island = int(key[0]), int(key[1])
            sizes, first = _chromosomes(table)
            names = np.sort(table["item"].unique())
            best = evolve(sizes, first, length, seed=(block * ISLANDS + island) * EPOCHS + number)[0]
            item = np.array([names[i] for held in best for i in held], np.int32)
            size = np.array([sizes[i] for held in best for i in held], np.int32)
            bins = np.repeat(np.arange(len(best), dtype=np.int32), [len(held) for held in best])
            # the elite stays, and a copy of it migrates to the next island
            out = [pd.DataFrame({"block": block, "island": to, "elite": island, "item": item, "size": size, "bin": bins}) for to in ([island] if number == EPOCHS - 1 else [island, (island + 1) % ISLANDS])]
            return pd.concat(out)

        return run

    for number in range(EPOCHS):
        state = state.groupBy("block", "island").applyInPandas(epoch(number), _STATE)
        if number < EPOCHS - 1:
            state = checkpointed(state)

    def winner(key: tuple[int, ...], table: pd.DataFrame) -> pd.DataFrame:
        def rank(one: pd.DataFrame) -> tuple[int, int]:
            fill = one.groupby("bin")["size"].sum().to_numpy(np.int64)
            return len(fill), -int((fill**2).sum())

        _, _, best = min(((rank(one), island, one) for island, one in table.groupby("island")), key=lambda x: x[:2])
        best = best.sort_values(["bin", "item"])
        ends = best.groupby("bin")["size"].cumsum()
        free = length - best.groupby("bin")["size"].transform("sum")
        return pd.DataFrame({"block": best["block"], "item": best["item"], "bin": best["bin"], "offset": ends - best["size"], "free": free})

    return state.groupBy("block").applyInPandas(winner, "block int, item int, bin int, offset long, free int")


def _numbered(rows: DataFrame, n: int) -> DataFrame:
    """rows with ``block`` and ``item``, a number within the block that any run of the job gives alike."""
    from pyspark.sql import Window

    blocks = max(1, -(-n // BLOCK))
    block = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(blocks)).cast("int")
    order = Window.partitionBy("block").orderBy("doc_id", "piece", "length", "ids_crc32")
    return rows.withColumn("block", block).withColumn("item", F.row_number().over(order))


def sequences(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    every = checkpointed(pieces(docs, path, length, end))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    done = []
    rows, level = every, 0
    # level 0: all pieces in blocks; level 1: what stood in poorly filled bins, once more
    while level < 2:
        n = rows.count()
        numbered = checkpointed(_numbered(rows, n))
        part = numbered.where(F.col("length") < length).select("block", "item", F.col("length").cast("int").alias("size"))
        placed = packed_blocks(part, length)
        joined = checkpointed(numbered.join(placed, ["block", "item"], "left"))
        full = F.col("bin").isNull()
        # ids: level, block, then the number of a full piece or a bin
        name = F.lit(level).cast("long") * (1 << 60) + F.col("block").cast("long") * (1 << 26) + F.when(full, F.col("item") * F.lit(2)).otherwise(F.col("bin") * F.lit(2) + 1)
        joined = joined.withColumn("sequence_id", name).withColumn("offset", F.coalesce("offset", F.lit(0)).cast("long"))
        again = (F.col("free") > SLACK) if level == 0 else F.lit(False)
        done.append(joined.where(~F.coalesce(again, F.lit(False))).select(*columns))
        rows, level = joined.where(again).select("doc_id", "piece", "start", "length", "ids_crc32"), level + 1
    return done[0].unionByName(done[1])
