"""Token counts under a unigram model by dynamic programming over a shared trie (operator 6).

The pieces are a byte-level vocabulary's tokens; tokenizers are not trained here, so a piece's probability
follows from its place r in the vocabulary by Zipf's law, p = 1 / (H * (r + 1)). Distinct pre-tokens go
into a trie of bytes. A node's forward score is the best sum of log probabilities over the ways to cut the
path to it; it is computed once when the node is made and serves every pre-token with that prefix. The
number of pieces on the best way, kept at the node where a pre-token ends, is its token count (of equal
ways the one with fewer pieces).

A null or empty text has no tokens. Rows stay as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import PATTERN, Cutter, Remembered, encoder

#: Trie nodes of a Python worker; beyond, a new trie begins (counts of past parts stay remembered).
NODES = 250_000


class TrieCounter(Cutter):
    """Counts pieces of texts; parts remember one number, (pre-tokens << 32) + tokens, so that they can be summed."""

    def __init__(self, path: str):
        import regex

        super().__init__(path)
        harmonic = sum(1 / (r + 1) for r in range(len(self.bytes_of)))
        # every end of a piece, with its score if it is a piece itself, else 0
        self.tails = {tail: 0.0 for number in self.plain.values() for piece in (self.bytes_of[number],) for tail in (piece[i:] for i in range(1, len(piece)))}
        self.tails |= {self.bytes_of[number]: -math.log(harmonic * (number + 1)) for number in self.plain.values()}
        self.pattern = regex.compile(PATTERN)
        self.words = Remembered(self._count, 50_000)
        self._clear()

    @cached_property
    def score(self) -> dict[bytes, float]:
        """The log probability of each piece; made when asked for, counting reads tails alone."""
        return {piece: one for piece, one in self.tails.items() if one}

    def _clear(self) -> None:
        """An empty trie: node numbers by (node << 8) + byte, and the best score and count of each node."""
        self.below: dict[int, int] = {}
        self.best, self.pieces = [0.0], [0]

    def _count(self, pretoken: str) -> int:
        """Pieces of one pre-token: walks the trie, making and scoring the nodes that are not there yet."""
        if len(self.best) >= NODES:
            self._clear()
        text, below, node, path = pretoken.encode(), self.below.get, 0, [0]
        for byte in text:
            after = below(node << 8 | byte)
            if after is None:
                break
            node = after
            path.append(node)
        else:
            return self.pieces[node]
        score = self.tails.get
        scores, counts = [self.best[x] for x in path], [self.pieces[x] for x in path]
        for end in range(len(path), len(text) + 1):
            best, count = -math.inf, 0
            for begin in range(end - 1, -1, -1):
                one = score(text[begin:end])
                if one is None:  # no longer piece ends like this
                    break
                if one:
                    z = scores[begin] + one
                    if z > best or z == best and counts[begin] + 1 < count:
                        best, count = z, counts[begin] + 1
            scores.append(best)
            counts.append(count)
            self.below[node << 8 | text[end - 1]] = node = len(self.best)
            self.best.append(best)
            self.pieces.append(count)
        return count

    def _plain(self, text: str) -> int:
        found = self.pattern.findall(text)
        return (len(found) << 32) + sum(map(self.words.__getitem__, found))

    def _word(self, part: str) -> int:
        return (1 << 32) + self._count(part)

    def counts(self, text: str | None) -> tuple[int, int]:
        """(pre-tokens, tokens) of a whole text; a special token in it is one of each."""
        if not text:
            return 0, 0
        if self.cut is not None and any(token in text for token in self.special):
            both = sum((1 << 32) + 1 if piece in self.special else self._segment(piece) for piece in self.cut.split(text) if piece)
        else:
            both = self._segment(text)
        return both >> 32, both & 0xFFFFFFFF

    def _segment(self, text: str) -> int:
        keys = self._keys(text)
        if keys is None:
            return self._plain(text)
        try:
            return sum(map(self.parts.__getitem__, keys))
        except TypeError:  # a None
            return self._plain(text)


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every whole text."""
    kept = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = encoder(path, TrieCounter)
        for batch in batches:
            pairs = [counter.counts(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_pretokens long, n_tokens long")
