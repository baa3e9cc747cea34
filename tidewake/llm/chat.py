"""Chat formatting: token-level assembly of conversations with a loss mask.

Each turn's role and text are encoded apart, wherever the row lies. Turns then meet in order, one
conversation after the other (in one task for each conversation, as digests run over its turns in order), and are spliced with reserved ids that no text can produce. The loss
mask is the prefix sum of +1 where an assistant's text begins and -1 where it ends. The rendering puts
``### `` before a role, ``:`` and a line end after it and ``</turn>`` after a text; inside texts a backslash
goes before backslashes and before what would read as one of these marks, so that reading inverts it.

A conversation is assembled as a stream of pieces of bounded size in (turn, role, text) order, so one
of any length takes bounded memory; the order is made by Spark's sort.

Cases: null text and null role are empty; a null turn comes first; rows that repeat (conv_id, turn)
are turns of their own, in order of role and text; a null conv_id is a conversation of its own; other
columns are ignored; texts of any length are encoded whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.bpe import LibraryEncoder, library_encoder
from tidewake.llm.shared import small_batches

BEGIN, MIDDLE, CLOSE = "### ", ":\n", "\n</turn>\n"
LOSS_ROLE = "assistant"
#: Tokens of one piece of a conversation; a longer turn makes a piece of its own.
PIECE = 1 << 16

_CONTROL = re.compile(r"\\|#(?=##)|<(?=/turn>)|:(?=\n)")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)

TURNS = "conv_id long, turn long, role string, text string, role_ids binary, text_ids binary"
PIECES = "conv_id long, piece long, ids binary, mask binary, formatted string"
DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"
)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = library_encoder(path)
    for batch in batches:
        roles, texts = ([escape(x or "") for x in batch.column(c).to_pylist()] for c in ("role", "text"))
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in ("conv_id", "turn")), pa.array(roles, pa.string()), pa.array(texts, pa.string()),
                pa.array(encoder.encode(roles), pa.binary()), pa.array(encoder.encode(texts), pa.binary()),
            ],
            ["conv_id", "turn", "role", "text", "role_ids", "text_ids"],
        )


def _assembled(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Pieces of whole turns: ids with reserved ids spliced in, mask by prefix sums, rendering."""
    begin, middle, close = (np.array([size + k], "<u4") for k in range(3))
    conv, piece, held, length = None, 0, [], 0

    def out() -> pa.RecordBatch:
        parts, change, at = [], np.zeros(length + 1, np.int8), 0
        for role, _, role_ids, text_ids in held:
            parts += [begin, role_ids, middle, text_ids, close]
            first = at + len(role_ids) + 2
            at = first + len(text_ids) + 1
            if role == LOSS_ROLE:
                change[first] += 1
                change[at - 1] -= 1
        mask = np.cumsum(change[:-1], dtype=np.int8)
        shown = "".join(f"{BEGIN}{role}{MIDDLE}{text}{CLOSE}" for role, text, _, _ in held)
        values = [conv, piece, np.concatenate(parts).tobytes(), mask.tobytes(), shown]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["conv_id", "piece", "ids", "mask", "formatted"])

    for batch in batches:
        for row in batch.to_pylist():
            ids = [np.frombuffer(row[c], "<u4") for c in ("role_ids", "text_ids")]
            more = len(ids[0]) + len(ids[1]) + 3
            if held and (row["conv_id"] != conv or length + more > PIECE):
                yield out()
                piece = piece + 1 if row["conv_id"] == conv else 0
                held, length = [], 0
            conv = row["conv_id"]
            held.append((row["role"], row["text"], *ids))
            length += more
    if held:
        yield out()


def _text(encoder: LibraryEncoder, ids: np.ndarray) -> str:
    return unescape(encoder.text(ids))


def _read(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Digests of the conversations, from the ids and masks of their pieces alone."""
    encoder = library_encoder(path)
    conv, open_ = None, False
    turns = loss = None
    n = chars = shown = tokens = masked = 0

    def out() -> pa.RecordBatch:
        values = [conv, n, turns.hexdigest(), chars, loss.hexdigest(), shown, tokens, masked]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        names = [x.split()[0] for x in DIGESTS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

    for batch in batches:
        for row in batch.to_pylist():
            if not open_ or row["conv_id"] != conv:
                if open_:
                    yield out()
                conv, open_, turns, loss = row["conv_id"], True, hashlib.sha256(), hashlib.sha256()
                n = chars = shown = tokens = masked = 0
            ids, mask = np.frombuffer(row["ids"], "<u4"), np.frombuffer(row["mask"], np.int8)
            begins, middles, closes = (np.flatnonzero(ids == encoder.size + k) for k in range(3))
            for a, b, c in zip(begins, middles, closes, strict=True):
                text = _text(encoder, ids[b + 1 : c])
                turns.update(f"{_text(encoder, ids[a + 1 : b])}\n{text}\n".encode())
            edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
            for a, b in zip(edges[::2], edges[1::2], strict=True):
                text = _text(encoder, ids[a:b])
                loss.update(text.encode())
                chars += len(text)
            n += len(begins)
            shown += len(row["formatted"])
            tokens += len(ids)
            masked += int(mask.sum())
    if open_:
        yield out()


def formatted(conversations: DataFrame, path: str) -> DataFrame:
    """The pieces of every conversation: token ids, loss mask (a byte a token) and rendering.

    The rows are sorted by conv_id and piece within partitions, and a conversation is in one partition.
    """
    small_batches(conversations.sparkSession)
    rows = conversations.select(*(F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))))
    turns = rows.mapInArrow(partial(_encoded, path=path), TURNS)
    order = ["conv_id", "turn", "role", "text"]
    return turns.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(partial(_assembled, size=library_encoder(path).size), PIECES)


def read_back(pieces: DataFrame, path: str) -> DataFrame:
    """One row of counts and digests per conversation, decoded from the pieces of ``formatted``."""
    return pieces.mapInArrow(partial(_read, path=path), DIGESTS)


def parse(shown: str) -> list[tuple[str, str]]:
    """Roles and texts of a rendering: each mark is looked for in its turn, past escaped characters."""
    found, at = [""], 0
    marks = [re.compile(r"\\.|" + re.escape(m), re.DOTALL) for m in (BEGIN, MIDDLE, CLOSE)]
    while at < len(shown):
        for mark in marks:
            m = next(m for m in mark.finditer(shown, at) if m[0][0] != "\\")
            found.append(unescape(shown[at : m.start()]))
            at = m.end()
    return list(zip(found[2::3], found[3::3], strict=True))
