"""Token ids in files, compressed by Re-Pair grammars.

Documents are sorted by doc_id over range partitions, encoded, closed with an end id and collected into
shards of bounded size. In each shard frequent adjacent pairs of ids are replaced by nonterminals, round after
round, until no pair is frequent; pairs never span two documents. A shard holds, little-endian: a magic word,
the counts (of documents, of those that have a doc_id, and of the ids below the rules), the doc_ids, the number of symbols
before each document, the two sides of each rule, the length of each rule's expansion, and the symbols; numbers have 16
bits and planes for the bits above. Expansion lengths say which symbols hold a range of ids, so any range is decoded alone.

Shards are rows of a Parquet table in a shared folder, which Spark writes and reads wherever it lies.

Cases: a null text is an empty one and has the end id alone; a null doc_id comes last, stays null and is no other id;
rows of one doc_id follow each other in order of their texts; a document longer than a shard makes a shard
of its own; other columns never enter; an empty table gives no shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewake.llm.bpe import library_encoder
from tidewake.llm.shared import small_batches, written

#: Ids of one shard, pairs replaced in a round, and times that a pair must occur.
SHARD, PAIRS, LEAST = 1 << 18, 1 << 11, 8
MAGIC = b"RPAIR\0\2\0"
SHARDS = "part int, nth int, n_tokens long, data binary"
ROWS = "part int, nth int, doc_id long, inner long, n_tokens long, ids_crc32 long"
#: Letters of a text by which rows of one doc_id are dealt to ranges; their order within is by whole texts.
DEALT = 64


def compressed(ids: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, how many are before each document and in all, and rules (pairs of symbols; the first is ``size``).

    Only places that can hold a frequent pair are looked at: a pair of symbols that both were there before occurs no
    oftener after a round, so beside those that were frequent already only the neighbours of new symbols are open.
    """
    symbols, last = ids.astype(np.uint32), np.zeros(len(ids), bool)
    last[ends - 1] = True
    rules: list[np.ndarray] = []
    free = size
    open_ = ~last
    open_[-1:] = False
    while len(at := np.flatnonzero(open_)):  # a round shortens the symbols, or is the last
        pairs = symbols[at].astype(np.uint64) << np.uint64(32) | symbols[at + 1]
        # A table of counts by hash tells which pairs can be frequent; only those are sorted.
        bits = min(18, len(pairs).bit_length() + 1)
        slot = (pairs * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)
        likely = (np.bincount(slot, minlength=1 << bits) >= LEAST)[slot]
        open_[at[~likely]] = False
        at, pairs = at[likely], pairs[likely]
        order = np.argsort(pairs)
        begins = np.flatnonzero(np.append(True, pairs[order[1:]] != pairs[order[:-1]])[: len(order)])
        counts = np.diff(np.append(begins, len(order)))
        found, frequent = pairs[order[begins]], counts >= LEAST
        if not frequent.any():
            break
        # The place of each pair among those replaced in this round, or -1.
        best = np.flatnonzero(frequent)
        best = np.sort(best[np.argsort(-counts[best], kind="stable")[:PAIRS]])
        chosen = found[best]
        number = np.full(len(found), -1)
        number[best] = np.arange(len(best))
        # In the order of pairs: rare ones are closed, those replaced are put back in the order of their places.
        open_[at[order[np.repeat(~frequent, counts)]]] = False
        rank = np.repeat(number, counts)
        hit = rank >= 0
        at, rank = at[order[hit]], rank[hit]
        back = np.argsort(at)
        at, rank = at[back], rank[back]
        # Of places that overlap, every other one from the left is replaced.
        begins = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        run = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
        at, rank = at[run % 2 == 0], rank[run % 2 == 0]
        symbols[at] = free + rank
        last[at] |= last[at + 1]
        kept = np.ones(len(symbols), bool)
        kept[at + 1] = False
        now = at - np.arange(len(at))  # one symbol less for each place before
        symbols, last, open_ = symbols[kept], last[kept], open_[kept]
        open_[now] = True
        open_[np.maximum(now - 1, 0)] = True
        open_ &= ~last
        open_[-1:] = False
        rules.append(np.stack([chosen >> np.uint64(32), chosen & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        free += len(chosen)
    return symbols, np.append(0, np.flatnonzero(last) + 1), np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def expansion_lengths(rules: np.ndarray, size: int) -> np.ndarray:
    """Ids that each nonterminal stands for; a rule's sides come before it."""
    out = np.ones(size + len(rules), np.int64)
    done = 0
    while done < len(rules):  # all rules whose sides are known already
        ready = done + int(np.argmax(np.append((rules[done:] >= size + done).any(1), True)))
        out[size + done : size + ready] = out[rules[done:ready]].sum(1)
        done = ready
    return out[size:]


def _packed(values: np.ndarray) -> bytes:
    """Numbers as their count, how many bits they have above the lowest 16, the lowest 16 bits of each, and a plane of
    bits for each further one."""
    more = max(0, int(values.max(initial=0)).bit_length() - 16)
    planes = [np.packbits((values >> np.uint32(16 + k) & np.uint32(1)).astype(np.uint8)).tobytes() for k in range(more)]
    return np.array([len(values), more], "<i8").tobytes() + b"".join([(values & np.uint32(0xFFFF)).astype("<u2").tobytes(), *planes])


def _unpacked(data: bytes, at: int) -> tuple[np.ndarray, int]:
    """The numbers packed at a place, and the place after them."""
    n, more = np.frombuffer(data, "<i8", 2, at).tolist()
    values, at = np.frombuffer(data, "<u2", n, at + 16).astype(np.uint32), at + 16 + 2 * n
    for k in range(more):
        plane = np.frombuffer(data, np.uint8, -(-n // 8), at)
        values |= np.unpackbits(plane, count=n).astype(np.uint32) << np.uint32(16 + k)
        at += len(plane)
    return values, at


class Shard:
    """A shard that is read; ``ids`` decodes a document, ``range`` any ids of the shard. The first ``known`` documents
    have a doc_id, the others a null one."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a shard")
        docs, self.known, self.size = np.frombuffer(data, "<i8", 3, 8).tolist()
        self.doc_ids, at = np.frombuffer(data, "<i8", docs, 32), 32 + 8 * docs
        self.before, at = _unpacked(data, at)
        rules, at = _unpacked(data, at)
        self.rules = rules.reshape(-1, 2)
        lengths, at = _unpacked(data, at)
        self.symbols, _ = _unpacked(data, at)
        self.lengths = np.append(np.ones(self.size, np.int64), lengths)

    def expanded(self, symbols: np.ndarray) -> np.ndarray:
        while len(wide := np.flatnonzero(symbols >= self.size)):
            sides = self.rules[symbols[wide] - self.size]
            width = np.ones(len(symbols), np.int64)
            width[wide] = 2
            place = np.cumsum(width) - width
            out = np.empty(len(symbols) + len(wide), np.uint32)
            out[place] = symbols
            out[place[wide]], out[place[wide] + 1] = sides[:, 0], sides[:, 1]
            symbols = out
        return symbols

    def starts(self) -> np.ndarray:
        """Ids before each document, and all."""
        return np.append(0, np.cumsum(self.lengths[self.symbols]))[self.before]

    def ids(self, doc: int) -> np.ndarray:
        return self.expanded(self.symbols[self.before[doc] : self.before[doc + 1]])

    def range(self, start: int, stop: int) -> np.ndarray:
        after = np.cumsum(self.lengths[self.symbols])
        low, high = np.searchsorted(after, [start, stop - 1], "right")
        skipped = int(after[low - 1]) if low else 0
        return self.expanded(self.symbols[low : high + 1])[start - skipped : stop - skipped]


def shard(doc_ids: list[int | None], ids: list[bytes], size: int) -> bytes:
    ends = np.cumsum([len(x) // 4 for x in ids])
    symbols, before, rules = compressed(np.frombuffer(b"".join(ids), "<u4"), ends, size)
    known = [i for i in doc_ids if i is not None]
    counts = np.array([len(doc_ids), len(known), size, *known, *[0] * (len(doc_ids) - len(known))], "<i8")
    parts = [before, rules.ravel(), expansion_lengths(rules, size), symbols]
    return MAGIC + counts.tobytes() + b"".join(_packed(p.astype(np.uint32)) for p in parts)


def _shards(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder, part, nth = library_encoder(path), TaskContext.get().partitionId(), 0
    end = np.array([end_id], "<u4").tobytes()
    held_ids: list[int | None] = []
    held: list[bytes] = []
    total = 0

    def out() -> pa.RecordBatch:
        values = [part, nth, total, shard(held_ids, held, encoder.size)]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["part", "nth", "n_tokens", "data"])

    for batch in batches:
        texts = [x or "" for x in batch.column("text").to_pylist()]
        for i, ids in zip(batch.column("id").to_pylist(), encoder.encode_added(texts), strict=True):
            if held and total + len(ids) // 4 + 1 > SHARD:
                yield out()
                nth, held_ids, held, total = nth + 1, [], [], 0
            held_ids.append(i)
            held.append(ids + end)
            total += len(ids) // 4 + 1
    if held:
        yield out()


def write(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """The shards of all documents, written as a table and read from it."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.asc_nulls_last("id"), F.col("text")]
    ordered = texts.repartitionByRange(order[0], F.substring("text", 1, DEALT)).sortWithinPartitions(*order)
    return written(ordered.mapInArrow(partial(_shards, path=path, end_id=end_id), SHARDS), "id-shards")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, nth, data in zip(*(batch.column(c).to_pylist() for c in ("part", "nth", "data")), strict=True):
            block = Shard(data)
            starts = block.starts()
            whole, ends = block.expanded(block.symbols).astype("<u4", copy=False).tobytes(), (4 * starts).tolist()
            sums = [zlib.crc32(whole[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            n = len(sums)
            columns = [np.full(n, part, np.int32), np.full(n, nth, np.int32), starts[:-1], np.diff(starts), np.array(sums, np.int64)]
            arrays = list(map(pa.array, columns))
            arrays.insert(2, pa.array(block.doc_ids, mask=np.arange(n) >= block.known))
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in ROWS.split(", ")])


def read(shards: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, from the shards."""
    # Ranges are numbered in their order; there are as many as there were tasks.
    sums = shards.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    sums = sums.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("base"))
    each = Window.partitionBy("part").orderBy("nth")
    before = shards.select("part", "nth", (F.sum("n_tokens").over(each) - F.col("n_tokens")).alias("within")).join(sums, "part")
    rows = shards.select("part", "nth", "data").mapInArrow(_read, ROWS)
    start = F.col("base") + F.col("within") + F.col("inner")
    return rows.join(before, ["part", "nth"]).select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")
