"""Words and lines of many texts at once: spans and hashes, on the bytes of Arrow columns.

Hashes are polynomials over bytes or over unit hashes modulo 2**64, mixed at the end; prefix sums give
the hash of any span at once. Two independent ones are taken where a match decides something.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is a round of its own.
ROUND = 1 << 20
LINE_END = 10

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Odd multipliers of the polynomials, for bytes and for units, and the constants of the mixer (fixed values).
BYTE_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
UNIT_BASES = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_1
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_2
    return x ^ (x >> np.uint64(31))


@functools.cache
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def _sized(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    if size <= ROUND * 2:
        return _powers(base, ROUND * 2)
    return _powers.__wrapped__(base, size)  # a very long text; not kept


class Spans:
    """Hashes of spans of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, base: int) -> None:
        up, self.down = _sized(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], dtype=np.uint64, out=self.sums[1:])

    def hashes(self, first: np.ndarray, after: np.ndarray) -> np.ndarray:
        length = (after - first).astype(np.uint64)
        return mixed((self.sums[after] - self.sums[first]) * self.down[first] + length * MIX_2)


_BYTES = [mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(b)) for b in BYTE_BASES]


class Units:
    """Words (or lines with a word, and how many words they have) of some texts: byte spans, and the number of units before
    each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lines: bool = False) -> None:
        self.data, self.offsets = data, offsets
        solid = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        word = solid.copy()
        word[1:] &= ~solid[:-1] | edge[1:-1]
        if lines:
            cut = data == LINE_END
            begins, stops = np.ones(len(data), bool), np.ones(len(data), bool)
            begins[1:] = cut[:-1]
            stops[:-1] = cut[1:]
            begins |= edge[:-1]
            stops |= edge[1:]
            first, after = np.flatnonzero(begins & ~cut), np.flatnonzero(stops & ~cut) + 1
            count = np.append(0, np.cumsum(solid))
            kept = count[after] > count[first]
            self.first, self.after = first[kept], after[kept]
            count = np.append(0, np.cumsum(word))
            self.words = count[self.after] - count[self.first]
        else:
            stops = solid.copy()
            stops[:-1] &= ~solid[1:] | edge[1:-1]
            self.first, self.after = np.flatnonzero(word), np.flatnonzero(stops) + 1
        self.before = np.searchsorted(self.first, offsets)

    def hashes(self, which: int) -> np.ndarray:
        return Spans(_BYTES[which][self.data], BYTE_BASES[which]).hashes(self.first, self.after)


def rounds(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, following row, bytes and text offsets of parts of a batch; null texts are empty."""
    texts = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    if not len(texts):
        return
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + ROUND, "right")) - 1)
        yield a, b, whole[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
