"""Byte-level BPE, encoded by a dynamic programme over prefixes (operator 7).

Every prefix of a pre-token has one last token in its BPE encoding. An automaton over the vocabulary
lists the tokens that end at a position; of these the one that may stand after the last token of the
prefix before it is the prefix's own last token. Following back-pointers from the end gives the ids,
without any list of merges in progress.

Two neighbouring tokens may stand side by side exactly if BPE, run on their joined bytes, gives the two
back. That is tested by undoing merges from the latest to the earliest on both sides of the border and
looking whether an earlier merge would have crossed it.

A text is first cut at its single spaces and newlines and before full stops and commas. A part that
neither begins nor ends with further white space, nor ends with other marks, is encoded alike wherever it
stands, so parts are looked up in a bounded table; a text with any other part goes through the
tokenizer's pattern as a whole.
"""

from __future__ import annotations

import gc
import hashlib
import json
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The pre-token pattern and the special token of the public 50k byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Parts and pre-tokens that a Python worker remembers in each of two generations (about 200 bytes each).
PARTS, WORDS = 250_000, 50_000
#: Token pairs whose compatibility a worker remembers.
PAIRS = 400_000


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte value."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters, extra = [""] * 256, 0
    for value in range(256):
        if value in plain:
            letters[value] = chr(value)
        else:
            letters[value] = chr(256 + extra)
            extra += 1
    return letters


class Remembered(dict):
    """make(key) for every key asked for, remembered for two generations of at most `most` keys."""

    def __init__(self, make, most: int):
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        if key in self.older:
            value = self.older[key]
        else:
            value = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Cutter:
    """Reads a vocabulary file; cuts texts into parts and remembers their ids. Subclasses encode a part."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.vocabulary: dict[str, int] = spec["model"]["vocab"]
        self.merge_list: list = spec["model"]["merges"]
        letters = byte_letters()
        value_of = {letter: value for value, letter in enumerate(letters)}
        self.special = {token["content"]: token["id"] for token in spec["added_tokens"]}
        self.plain = {token: number for token, number in self.vocabulary.items() if token not in self.special}
        self.bytes_of = [b""] * (1 + max([*self.vocabulary.values(), *self.special.values()]))
        for token, number in self.plain.items():
            self.bytes_of[number] = bytes(value_of[letter] for letter in token)
        for token, number in self.special.items():
            self.bytes_of[number] = token.encode()
        self.letters = dict(enumerate(letters))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.parts = Remembered(self._part, PARTS)

    def _plain(self, text: str) -> bytes:
        """Packed ids of a text without looking at special tokens."""
        raise NotImplementedError

    def _word(self, part: str) -> bytes:
        """Packed ids of letters, perhaps after one space: a single pre-token."""
        return self._plain(part)

    def _part(self, part: str) -> bytes | None:
        """Packed ids of a part between cuts; None if its encoding may hang on what stands around it."""
        letters = part[1:] if part[:1] == " " else part
        if letters.isalpha():
            return self._word(part)
        if part in ("\n", ".", ","):
            return self._plain(part)
        if not letters or letters[0].isspace() or not letters[-1].isalnum():
            return None
        return self._plain(part)

    def packed(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; special tokens in it count as such."""
        if not text:
            return b""
        if self.cut is not None and any(token in text for token in self.special):
            pieces = self.cut.split(text)
            return b"".join(self.special[piece].to_bytes(4, "little") if piece in self.special else self._segment(piece) for piece in pieces if piece)
        return self._segment(text)

    def ordinary(self, text: str | None) -> bytes:
        """As packed(), but the strings of special tokens are ordinary text."""
        return self._segment(text) if text else b""

    def _keys(self, text: str) -> list[str] | None:
        """The parts of a text; None if it can't be cut so."""
        if any(run in text for run in ("\0", "..", ",,", ".,", ",.")):
            return None
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").replace(".", "\0.").replace(",", "\0,").split("\0")

    def _segment(self, text: str) -> bytes:
        keys = self._keys(text)
        if keys is None:
            return self._plain(text)
        try:
            return b"".join(map(self.parts.__getitem__, keys))
        except TypeError:  # a None
            return self._plain(text)

    def decode(self, packed: bytes) -> str:
        """Text of packed ids, special tokens included; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, memoryview(packed).cast("I"))).decode("utf-8", "replace")


class Encoder(Cutter):
    """Encodes pre-tokens by the dynamic programme over prefixes."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        super().__init__(path)
        # rank of the merge that makes a token (-1: a single byte), its two halves, and ranks by pair
        self.rank = [-1] * len(self.bytes_of)
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(len(self.bytes_of))]
        self.merges: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(self.merge_list):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            made = self.plain[left + right]
            self.merges[self.plain[left], self.plain[right]] = rank
            if self.rank[made] < 0:
                self.rank[made], self.halves[made] = rank, (self.plain[left], self.plain[right])
        self.automaton = ahocorasick.Automaton()
        for token, number in self.plain.items():
            self.automaton.add_word(token, (len(token), number))
        self.automaton.make_automaton()
        self.pattern = regex.compile(PATTERN)
        self.pairs: dict[int, bool] = {}
        self.words = Remembered(lambda pretoken: array("I", self.word(pretoken)).tobytes(), WORDS)

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves these two tokens side by side."""
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        rank, halves, merges = self.rank, self.halves, self.merges
        # Merges at or after this rank come too late to cross the border. On the left side a merge of
        # equal rank would have happened first, since BPE goes from left to right.
        limit = 1 << 60
        while True:
            crossing = merges.get((left, right))
            if crossing is not None and crossing < limit:
                return False
            a, b = rank[left], rank[right]
            if a < 0 and b < 0:
                return True
            if a >= b:
                # undo the later merge; of equal ones the right one happened later
                if a == b:
                    limit, right = b + 1, halves[right][0]
                else:
                    limit, left = a, halves[left][1]
            else:
                limit, right = b + 1, halves[right][0]

    def word(self, pretoken: str) -> list[int]:
        """Ids of one pre-token."""
        if pretoken.isascii() and pretoken.isprintable():
            text = pretoken.replace(" ", self.letters[32])
        else:
            text = pretoken.encode().decode("latin-1").translate(self.letters)
        n = len(text)
        last = [-1] * (n + 1)
        compatible, pairs = self.compatible, self.pairs
        lengths = [0] * (n + 1)
        for end, (length, token) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            begin = end - length
            before = last[begin]
            if begin:
                if before < 0:
                    continue
                known = pairs.get(before << 20 | token)
                if known is None:
                    known = compatible(before, token)
                if not known:
                    continue
            last[end], lengths[end] = token, length
        ids = []
        while n:
            ids.append(last[n])
            n -= lengths[n]
        ids.reverse()
        return ids

    def _word(self, part: str) -> bytes:
        return array("I", self.word(part)).tobytes()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.pattern.findall(text)))


class RankMerger(Cutter):
    """The same ids, with parts encoded by tiktoken's compiled merges over the file's own vocabulary.

    In this vocabulary ids follow the order of merges, which is the order tiktoken merges by.
    """

    def __init__(self, path: str):
        import tiktoken

        super().__init__(path)
        ranks = {self.bytes_of[number]: number for number in self.plain.values()}
        self.encoding = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _plain(self, text: str) -> bytes:
        return array("I", self.encoding.encode_ordinary(text)).tobytes()


_ENCODERS: dict[tuple[type, str], Cutter] = {}


def encoder(path: str, kind: type[Cutter] = Encoder) -> Cutter:
    """This process's encoder for a vocabulary file."""
    if (kind, path) not in _ENCODERS:
        _ENCODERS[kind, path] = kind(path)
    return _ENCODERS[kind, path]


def forget() -> None:
    """This process's encoders go; whoever asks for one again makes it anew."""
    if _ENCODERS:
        _ENCODERS.clear()
        gc.collect()  # their tables refer back to them


def with_ids(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids binary): the ids of every whole text, packed as little-endian unsigned 32-bit integers.

    A null or empty text has no ids. Rows stay as they are, repeated ones and null keys included.
    """
    kept = docs.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            ids = [coder.packed(value) for value in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], [key, "ids"])

    return kept.mapInArrow(run, f"`{key}` {kept.schema[key].dataType.simpleString()}, ids binary")


def decoded(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, text): texts of packed ids; null ids give an empty text."""
    kept = encoded.select(key, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, Cutter)  # decoding has a Python process of its own; it needs no automaton
        for batch in batches:
            texts = [coder.decode(value or b"") for value in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return kept.mapInArrow(run, f"`{key}` {kept.schema[key].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every whole text, the text decoded from the ids alone."""
    kept = with_ids(docs, path, key=key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, Cutter)  # decoding has a Python process of its own; it needs no automaton
        for batch in batches:
            packed = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(ids) // 4 for ids in packed], pa.int64()),
                    pa.array([hashlib.sha256(ids).hexdigest() for ids in packed]),
                    pa.array([hashlib.sha256(coder.decode(ids).encode()).hexdigest() for ids in packed]),
                ],
                [key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return kept.mapInArrow(run, f"`{key}` {kept.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
