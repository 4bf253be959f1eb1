"""Chat formatting by token-level assembly (operator 1).

Every turn becomes segments: reserved ids that mark it, and the ids of its text, encoded on their own, so
that no text can produce a reserved id or merge with a mark. The loss mask is the prefix sum of +1 at the
start and -1 at the end of every segment under loss. In the rendered text the reserved ids appear as
control strings; one that occurs inside a text gets a backslash after its first character (one more, if
backslashes stand there already), which reading back takes away again.

A user turn is ``[INST]text[/INST]``, an assistant turn ``<s>text</s>``, any other one
``[ROLE]role[TEXT]text[/ROLE]``. Under loss are an assistant's text and the ``</s>`` after it.

Null roles and texts count as empty. Rows with equal conversation and turn stand in the order of role and
text; a null turn comes first; null conversation ids make one conversation. A conversation may hold any
number of turns: encoding happens before rows are brought together, and what follows reads turn by turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder

# The control strings. Their reserved ids follow the vocabulary's own, in this order.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[TEXT]", "[/ROLE]")
BEGIN, END, USER, USER_END, ROLE, TEXT, ROLE_END = range(len(CONTROLS))

_HIDE = re.compile("|".join(f"({re.escape(c[0])})(\\\\*)({re.escape(c[1:])})" for c in CONTROLS))
_SHOW = re.compile("|".join(f"({re.escape(c[0])}\\\\*)\\\\({re.escape(c[1:])})" for c in CONTROLS))


def escape(text: str) -> str:
    """The text with no control string in it; unescape() gives it back."""
    return _HIDE.sub(lambda m: "".join(x for x in m.groups() if x is not None).replace(m[0][0], m[0][0] + "\\", 1), text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _SHOW.sub(lambda m: "".join(x for x in m.groups() if x is not None), text) if "\\" in text else text


def segments(role: str, text: str) -> list[tuple[int | str, bool]]:
    """A turn's reserved marks (numbers) and texts, each with whether it is under loss."""
    if role == "user":
        return [(USER, False), (text, False), (USER_END, False)]
    if role == "assistant":
        return [(BEGIN, False), (text, True), (END, True)]
    return [(ROLE, False), (role, False), (TEXT, False), (text, False), (ROLE_END, False)]


def format_turns(conversations: DataFrame, path: str) -> DataFrame:
    """Per turn: conv_id, turn, role, text, ids binary (unsigned 32-bit), loss_mask binary (a byte per id), formatted string."""
    kept = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        base = len(coder.bytes_of)
        for batch in batches:
            packed, sizes, loss, counts, shown = [], [], [], [], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                turn, string = segments(role, text), []
                for what, under in turn:
                    if isinstance(what, int):
                        ids, string_of = (base + what).to_bytes(4, "little"), CONTROLS[what]
                    else:
                        string_of = escape(what)
                        ids = coder.ordinary(string_of)
                    packed.append(ids)
                    sizes.append(len(ids) // 4)
                    loss.append(under)
                    string.append(string_of)
                counts.append(len(turn))
                shown.append("".join(string))
            ends = np.cumsum(np.array(sizes, np.int64))
            step = np.zeros((ends[-1] if len(ends) else 0) + 1, np.int8)
            under = np.array(loss, bool)
            np.add.at(step, (ends - sizes)[under], 1)
            np.add.at(step, ends[under], -1)
            mask = np.cumsum(step, dtype=np.int8).tobytes()
            last = np.cumsum(np.array(counts, np.int64)) - 1
            upto = ends[last] if len(last) else ends
            first = np.concatenate([[0], upto[:-1]]).astype(np.int64) if len(upto) else upto
            everything = b"".join(packed)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([everything[4 * a : 4 * b] for a, b in zip(first, upto)], pa.binary()),
                    pa.array([mask[a:b] for a, b in zip(first, upto)], pa.binary()),
                    pa.array(shown, pa.string()),
                ],
                ["conv_id", "turn", "role", "text", "ids", "loss_mask", "formatted"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    return kept.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, ids binary, loss_mask binary, formatted string")


def in_order(turns: DataFrame) -> DataFrame:
    """The turns of format_turns() with each conversation's rows together and in order within one partition."""
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("role", "text")


def assembled(turns: DataFrame) -> DataFrame:
    """Per turn, in order: conv_id, token_start, char_start, ids, loss_mask, formatted; the starts count from the conversation's first id."""
    kept = in_order(turns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tokens, chars = object(), 0, 0
        for batch in batches:
            at, at_char = [], []
            ids, mask, shown = (batch.column(batch.schema.get_field_index(c)) for c in ("ids", "loss_mask", "formatted"))
            for conv, n, text in zip(batch.column(0).to_pylist(), ids.to_pylist(), shown.to_pylist()):
                if conv != now:
                    now, tokens, chars = conv, 0, 0
                at.append(tokens)
                at_char.append(chars)
                tokens += len(n) // 4
                chars += len(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.int64()), pa.array(at_char, pa.int64()), ids, mask, shown], ["conv_id", "token_start", "char_start", "ids", "loss_mask", "formatted"])

    return kept.mapInArrow(run, f"conv_id {kept.schema['conv_id'].dataType.simpleString()}, token_start long, char_start long, ids binary, loss_mask binary, formatted string")


def read_turn(ids: bytes, mask: bytes, coder) -> tuple[str, str, list[str]]:
    """(role, text, texts under loss) of one turn, from its ids and mask alone."""
    base = len(coder.bytes_of)
    numbers, under = np.frombuffer(ids, np.uint32), np.frombuffer(mask, np.int8)
    marks = np.flatnonzero(numbers >= base)
    texts = [unescape(coder.decode(ids[4 * (a + 1) : 4 * b])) for a, b in zip(marks[:-1], marks[1:])]
    kind = int(numbers[marks[0]]) - base
    role = "user" if kind == USER else "assistant" if kind == BEGIN else texts[0]
    spans = [text for text, a, b in zip(texts, marks[:-1], marks[1:]) if b > a + 1 and under[a + 1 : b].all()]
    return role, texts[-1], spans


def digests(turns: DataFrame, path: str) -> DataFrame:
    """Per conversation what reading the assembled ids, mask and text back gives: counts and digests."""
    kept = assembled(turns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        done: list[tuple] = []
        now, state = None, None

        def close() -> None:
            if state is not None:
                n, whole, loss_n, loss, chars = state
                done.append((now, n, whole.hexdigest(), loss_n, loss.hexdigest(), chars))

        def out() -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * 6
            kinds = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        key_type = pa.int64()
        for batch in batches:
            key_type = batch.schema.field(0).type
            for conv, start, _, ids, mask, shown in zip(*(c.to_pylist() for c in batch.columns)):
                if not start:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, spans = read_turn(ids, mask, coder)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                for span in spans:
                    state[2] += len(span)
                    state[3].update(span.encode())
                state[4] += len(shown)
            if done:
                yield out()
        close()
        if done:
            yield out()

    return kept.mapInArrow(run, f"conv_id {kept.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
