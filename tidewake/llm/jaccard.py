"""N-gram Jaccard join: documents whose sets of word n-grams overlap enough, as classes.

Documents are rows and n-grams are columns of an incidence matrix A; two documents link when the entry
of A times its transpose, their overlap, reaches the threshold's share of their union. The product is
taken in blocks only:

1. Documents of equal sets become one row (a 64-bit fingerprint with the size). Only distinct rows go on.
2. Columns are put in an order, rare ones first: a table of counts by the leading bits of the column's hash, of fixed
   size and summed over all documents, says how common a column can be. (The order decides the work alone; results are
   the same with any.) Of each row so many leading columns are given out that two linked rows have one of them in
   common: all but as many as their overlap needs.
3. The product of these leading parts: in each column the rows are paired, and each pair's columns in common are
   summed. From both sizes follows how much of its leading part a row can miss; pairs below that bound, or of too
   different sizes, are discarded. A column of more than ``HOT`` rows isn't paired; its rows are left over.
   As a linked pair with a row that isn't left over has a leading column of that row in common, only links between two
   rows that are left over are open.
   Where these are many, the same is done among them alone, with an order by their own counts: the larger the input, the less
   the fixed table tells of a column's rarity, and the more rows would be left over that have rare columns enough.
4. What is left then comes from bands: a linked pair's sets differ by a share of both sizes, at most D elements. Columns are dealt by
   hash into more than D bands, so the pair is equal in at least one. Sizes are cut into classes so that a pair lies in one
   or in two adjacent ones, and each row gives a hash of each of its bands for both. A band in which a row has no
   column says nothing and is left out; that is safe while at least D + 1 bands of the row are in use. A row with
   fewer uses the next of several dealings too, and after the last its empty bands count. Rows of one Arrow batch
   that meet in a band are combined before the shuffle, so a band that very many rows have brings one row a batch.
5. Rows that are paired or have equal bands are joined to blocks, and blocks are dealt into tiles of
   bounded rows and columns. In each tile the sparse product is computed row by row over an inverted
   index: the overlap of a row with all others is accumulated column by column, and pairs outside the size bound
   are discarded. Rows that are known to be connected aren't compared again.
6. Blocks of one tile are done then. Of others the least row of each class found so far is multiplied with
   those of the other tiles; what is still apart after that, all rows but those of the block's largest class, is
   multiplied with all rows of the block, tile by tile. A large group of near copies thus costs each row one or two
   products, and no pair of rows of two classes is left uncompared.
7. Links found become classes by rounds of contraction: nodes go over to their least neighbours, in tables.

Cases: a null or empty text, or one without words, has no set and stands alone; with fewer words than n
the whole sequence is one n-gram; a very long text is a round of its own; repeated rows are equal sets, and rows are
told apart by doc_id and a hash of the text, so null or repeated doc_ids with different texts don't meet; a null
doc_id stays null and counts as the largest one; other columns never enter, whatever their names; an empty table gives
an empty result. The parameter ``most`` of ``propagated`` ends a run with an error, never with part of the result.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.llm.quality import SPACES
from tidewake.llm.shared import as_row, cleaned, drop, small_batches, written
from tidewake.llm.words import UNIT_BASES, MIX_1, MIX_2, Spans, Units, mixed, rounds, signed

#: Dealings of columns into bands that are tried before empty bands count.
DEALINGS = 3
#: Rows, and entries of the matrix, that a tile holds on average.
TILE, ENTRIES = 512, 1 << 19

#: Cells of the table of counts (2 ** CELL_BITS), how many of them make a row of it, and rows of a column that are still paired.
CELL_BITS, CHUNK, HOT = 20, 1 << 16, 32
#: Rows left over from which on another order is tried among them, as long as each leaves less than three quarters of them.
AGAIN = 20_000
#: Tasks over which the rows of one block are spread where they are joined with a fact on it.
SALTS = 128

SETS = "id long, th long, n long, print long, chunk int, cells binary"
CELLS = "chunk int, cells binary"
COLUMNS = "column long, print long, n int"
BANDS = "band long, print long"
LINKS = "a long, b long"


class Threshold:
    """overlap / union >= num / den, for sets of n-grams of ``words`` words."""

    def __init__(self, words: int, num: int, den: int, lower: bool) -> None:
        self.words, self.num, self.den, self.lower = words, num, den, lower

    @functools.cached_property
    def edges(self) -> np.ndarray:
        edges = [1]
        while edges[-1] < 1 << 40:  # the largest size that can link to the class's least, and one
            edges.append(edges[-1] * self.den // self.num + 1)
        return np.array(edges)

    def size_class(self, n: int | np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, n, "right") - 1

    def differing(self, of: int) -> int:
        """The most elements in which linked sets differ whose larger one is of this class."""
        most = int(self.edges[of + 1]) - 1
        return 2 * most * (self.den - self.num) // (self.den + self.num)

    def lead(self, n: np.ndarray) -> np.ndarray:
        """Columns of which a row of this size shares one with each that it links to: all but the overlap, and one."""
        return n + (-n * self.num) // self.den + 1

    @functools.cached_property
    def _bands(self) -> dict[int, int]:
        return {}

    def bands(self, of: int) -> int:
        """Bands of this class: more than ``differing``, and as many as its smallest sets need to use that many."""
        if of not in self._bands:
            d, least = self.differing(of), int(self.edges[max(0, of - 1)])
            m = np.arange(d + 2, max(d + 3, 2 * least))
            empty = (1 - 1 / m) ** least
            spread = m * empty * (1 - (1 + least / m) * empty)
            enough = m * (1 - empty) - 2 * np.sqrt(np.maximum(spread, 0)) >= d + 1
            self._bands[of] = int(m[np.argmax(enough)] if enough.any() else m[0]) if d else 0
        return self._bands[of]


def _sets(words: Units, threshold: Threshold) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    spans, k = Spans(words.hashes(0), UNIT_BASES[0]), threshold.words
    first = np.arange(max(0, len(words.first) - k + 1))
    grams = spans.hashes(first, first + k)
    short = spans.hashes(words.before[:-1], words.before[1:])
    out = []
    for d, n in enumerate(np.diff(words.before).tolist()):
        low = words.before[d]
        out.append(np.unique(grams[low : low + n - k + 1]) if n >= k else short[d : d + 1] if n else short[:0])
    return out


def _prints_of(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and prints of sets; the print of an empty one means nothing."""
    sizes = np.array([len(s) for s in sets], np.int64)
    sums = np.zeros(sizes.sum() + 1, np.uint64)
    np.cumsum(mixed(np.concatenate(sets) ^ MIX_1), dtype=np.uint64, out=sums[1:])
    after = np.cumsum(sizes)
    total = sums[after] - sums[after - sizes]
    return sizes, mixed(total + MIX_2 * sizes.astype(np.uint64)).view(np.int64)


def _round_sets(data: np.ndarray, offsets: np.ndarray, threshold: Threshold) -> list[np.ndarray]:
    if threshold.lower:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    return _sets(Units(data, offsets), threshold)


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _counted(counts: np.ndarray, sets: list[np.ndarray]) -> None:
    counts += np.bincount(_cells(np.concatenate(sets)), minlength=len(counts)).astype(np.uint32)


def _chunks(counts: np.ndarray) -> list[pa.Array]:
    """A task's counts by cell, as chunks and cells."""
    chunks = counts.reshape(-1, CHUNK)
    some = np.flatnonzero(chunks.any(1))
    return [pa.array(some.astype(np.int32)), pa.array([zlib.compress(chunks[k].tobytes(), 1) for k in some], pa.binary())]


def _counts(batches: Iterator[pa.RecordBatch], threshold: Threshold) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << CELL_BITS, np.uint32)
    for batch in batches:
        for _, _, data, offsets in rounds(batch):
            _counted(counts, _round_sets(data, offsets, threshold))
    yield pa.RecordBatch.from_arrays(_chunks(counts), ["chunk", "cells"])


def _prints(batches: Iterator[pa.RecordBatch], threshold: Threshold) -> Iterator[pa.RecordBatch]:
    """A row for each document, and at the end the task's counts of columns by cell, in chunks."""
    names, counts = [x.split()[0] for x in SETS.split(", ")], np.zeros(1 << CELL_BITS, np.uint32)
    for batch in batches:
        for a, b, data, offsets in rounds(batch):
            sets = _round_sets(data, offsets, threshold)
            sizes, prints = _prints_of(sets)
            _counted(counts, sets)
            own = batch.slice(a, b - a)
            none = [pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.binary())]
            yield pa.RecordBatch.from_arrays([own.column("id"), own.column("th"), pa.array(sizes), pa.array(prints, mask=sizes == 0), *none], names)
    chunk, cells = _chunks(counts)
    yield pa.RecordBatch.from_arrays([*[pa.nulls(len(chunk), pa.int64())] * 4, chunk, cells], names)


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(x), np.uint32).astype(np.uint64) for x in rows["cells"])
    return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "cells": [zlib.compress(total.astype("<u8").tobytes(), 1)]})


def _cell_ranks(sets: DataFrame) -> bytes:
    """The place of each cell in the order of their counts; of a fixed size, whatever the input's."""
    # A task's chunk counts occurrences in fewer than 2 ** 32 documents; sums are wider.
    summed = sets.where("chunk IS NOT NULL").select("chunk", "cells").groupBy("chunk").applyInPandas(_summed, "chunk int, cells binary")
    counts = np.zeros((1 << CELL_BITS) // CHUNK * CHUNK, np.uint64).reshape(-1, CHUNK)
    with cleaned(sets.sparkSession):
        found = summed.collect()  # one for each chunk
    for row in found:
        counts[row["chunk"]] = np.frombuffer(zlib.decompress(row["cells"]), "<u8")
    ranks = np.empty(1 << CELL_BITS, np.uint32)
    ranks[np.argsort(counts.ravel(), kind="stable")] = np.arange(1 << CELL_BITS, dtype=np.uint32)
    return ranks.tobytes()


def _leading(batches: Iterator[pa.RecordBatch], threshold: Threshold, ranks: bytes) -> Iterator[pa.RecordBatch]:
    """The leading columns of each distinct set. Of a column that is hot in a round already as many rows go on as show
    that it is; all its rows are told to be left over, by a column of their own with a size of -1."""
    rank, seen = np.frombuffer(ranks, np.uint32), set()  # bounded, as it only saves work
    for batch in batches:
        for _, _, data, offsets in rounds(batch):
            sets = _round_sets(data, offsets, threshold)
            sizes, prints = _prints_of(sets)
            new = {p: d for d, p in enumerate(prints.tolist()) if sizes[d] and p not in seen}
            if len(seen) < 200_000:
                seen.update(new)
            if not new:
                continue
            own = np.array(list(new.values()))
            n = sizes[own]
            lead = threshold.lead(n)
            first = [sets[d][np.argsort(rank[_cells(sets[d])], kind="stable")[:q]] for d, q in zip(own.tolist(), lead.tolist(), strict=True)]
            columns, owner, size = np.concatenate(first), np.repeat(prints[own], lead), np.repeat(n, lead).astype(np.int32)
            order = np.argsort(columns, kind="stable")
            begins = np.flatnonzero(np.append(True, columns[order[1:]] != columns[order[:-1]]))
            counts = np.diff(np.append(begins, len(order)))
            nth = np.arange(len(order)) - np.repeat(begins, counts)
            over = np.unique(owner[order[np.repeat(counts > HOT, counts)]])
            go = np.sort(order[nth <= HOT])
            arrays = [
                signed(np.concatenate([columns[go], mixed(over.view(np.uint64) ^ MIX_2)])), pa.array(np.concatenate([owner[go], over])),
                pa.array(np.concatenate([size[go], np.full(len(over), -1, np.int32)])),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["column", "print", "n"])


def _band_hashes(sets: list[np.ndarray], threshold: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """The set (its place) and the hash of each band that is given out."""
    sizes = np.array([len(s) for s in sets], np.int64)
    all_hashes, stop = np.concatenate(sets), np.cumsum(sizes)
    place, out = [], []
    own = threshold.size_class(sizes)
    for of in np.unique(np.concatenate([own, own + 1])).tolist():
        m, d = threshold.bands(of), threshold.differing(of)
        which = np.flatnonzero((own == of) | (own == of - 1)) if m else np.zeros(0, np.int64)
        for dealing in range(DEALINGS):
            if not len(which):
                break
            salt = np.uint64(((of << 8) + dealing + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
            n = sizes[which]
            before = np.cumsum(n) - n
            dealt = mixed(all_hashes[np.repeat(stop[which] - n - before, n) + np.arange(n.sum())] ^ salt)
            band = ((dealt >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            slot = np.repeat(np.arange(len(which)) * m, n) + band
            total = np.zeros(len(which) * m, np.uint64)
            np.add.at(total, slot, mixed(dealt ^ MIX_2))
            used = (np.bincount(slot, minlength=len(which) * m) > 0).reshape(-1, m)
            enough = used.sum(1) > d
            if dealing == DEALINGS - 1:
                used[~enough] = True
            row, band = np.nonzero(used)
            out.append(mixed(total.reshape(-1, m)[row, band] ^ mixed(band.astype(np.uint64) * MIX_1 + salt)))
            place.append(which[row])
            which = which[~enough]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(place), np.concatenate(out)


def _bands(batches: Iterator[pa.RecordBatch], threshold: Threshold) -> Iterator[pa.RecordBatch]:
    """band and print; sets that meet in a band here are rows of a band of their own, and one of them stands for all."""
    seen: set[int] = set()  # a set that this task has given already; bounded, as it only saves work
    for batch in batches:
        for _, _, data, offsets in rounds(batch):
            sets = _round_sets(data, offsets, threshold)
            sizes, prints = _prints_of(sets)
            new = {p: d for d, p in enumerate(prints.tolist()) if sizes[d] and p not in seen}
            if len(seen) < 200_000:
                seen.update(new)
            if not new:
                continue
            place, bands = _band_hashes([sets[d] for d in new.values()], threshold)
            owner = np.array(list(new), np.int64)[place]
            order = np.argsort(bands, kind="stable")
            bands, owner = bands[order], owner[order]
            fresh = np.append(True, bands[1:] != bands[:-1])[: len(bands)]
            stands = owner[fresh][np.cumsum(fresh) - 1]
            met = np.unique(np.stack([stands, owner])[:, ~fresh], axis=1)
            met = met[:, met[0] != met[1]]
            pair = mixed(met[0].view(np.uint64) * MIX_1 ^ mixed(met[1].view(np.uint64) ^ MIX_2))
            band = np.concatenate([bands[fresh], pair, pair])
            if len(band):
                yield pa.RecordBatch.from_arrays([signed(band), pa.array(np.concatenate([owner[fresh], met[0], met[1]]))], ["band", "print"])


def _gathered(columns: np.ndarray, index: np.ndarray, holder: np.ndarray) -> np.ndarray:
    """The rows that hold each of these columns, one after the other."""
    n = index[columns + 1] - index[columns]
    before = np.cumsum(n) - n
    return holder[np.repeat(index[columns] - before, n) + np.arange(n.sum())]


def _multiplied(rows: pd.DataFrame, threshold: Threshold) -> pd.DataFrame:
    """Links between rows of different ``label`` that connect all such rows which link; those with ``search`` are
    compared with all rows, and others with them alone."""
    num, den = threshold.num, threshold.den
    data = [t.encode() for t in rows["text"]]
    offsets = np.append(0, np.cumsum([len(x) for x in data]))
    sets = _round_sets(np.frombuffer(b"".join(data), np.uint8), offsets, threshold)
    prints, search = rows["print"].to_numpy(), rows["search"].to_numpy(bool)
    sizes = np.array([len(s) for s in sets])
    columns, column = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.append(0, np.cumsum(sizes))
    holder = np.repeat(np.arange(len(sets)), sizes)[np.argsort(column, kind="stable")]
    height = np.bincount(column, minlength=len(columns))
    index = np.append(0, np.cumsum(height))
    _, label = np.unique(rows["label"].to_numpy(), return_inverse=True)
    waiting = np.ones(len(sets), bool)  # not searched itself yet
    a, b = [], []
    for row in np.flatnonzero(search).tolist():
        waiting[row] = False
        n, own = sizes[row], column[starts[row] : starts[row + 1]]
        may = waiting & (label != label[row]) & (sizes * den >= n * num) & (sizes * num <= n * den)
        if not may.any():
            continue
        # A linked row has one of these columns: all but so many as the overlap needs, the rarest first.
        lead = own[np.argsort(height[own], kind="stable")[: n - -(-num * n // den) + 1]]
        near = np.unique(_gathered(lead, index, holder))
        near = near[may[near]]
        if not len(near):
            continue
        overlap = np.bincount(_gathered(own, index, holder), minlength=len(sets))[near]
        near = near[den * overlap >= num * (n + sizes[near] - overlap)]
        _, one = np.unique(label[near], return_index=True)
        near = near[one]
        label[np.isin(label, label[near])] = label[row]
        a += [prints[row]] * len(near)
        b += prints[near].tolist()
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def propagated(edges: DataFrame, name: str, most: int = 60) -> DataFrame:
    """node and label: the least node that edges (a, b) lead to. In each round a node goes over to its least
    neighbour, and to where that one goes; edges are then drawn between the nodes that are left, so they
    become few at once."""

    def drawn(df: DataFrame) -> DataFrame:
        ordered = df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
        return written(ordered.distinct(), f"{name}-edges")

    left, labels = drawn(edges), None
    for _ in range(most):
        both = left.unionAll(left.select("b", "a"))
        near = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("near")), f"{name}-near")
        far = near.select(F.col("a").alias("near"), F.col("near").alias("far"))
        step = written(near.join(far, "near").select(F.col("a").alias("node"), F.col("far").alias("to")), f"{name}-steps")
        if labels is None:
            labels = step.withColumnRenamed("to", "label")
        else:
            moved = labels.join(step.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
            labels = written(moved, f"{name}-labels")
        ends = left.join(step.select(F.col("node").alias("a"), F.col("to").alias("to_a")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("to_b")), "b")
        left = drawn(ends.select(F.col("to_a").alias("a"), F.col("to_b").alias("b")))
        if left.isEmpty():
            return labels
    raise RuntimeError(f"edges are left after {most} rounds")


def _tiles(rows: DataFrame, tile: int) -> DataFrame:
    """The number of tiles of each block, from its rows and their sizes."""
    rows_, entries = F.count(F.lit(1)) / tile, F.sum("n") / ENTRIES
    return rows.groupBy("block").agg(F.ceil(F.greatest(rows_, entries)).cast("int").alias("tiles"))


def _by_block(rows: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
    """The rows with what is known of their block. Rows of a block go to many tasks, to each of which its fact is sent."""
    salted = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("print", F.lit("salt")), F.lit(SALTS)).cast("int")).join(salted, ["block", "salt"], how).drop("salt")


def _tiled(rows: DataFrame, tile: int) -> DataFrame:
    """The rows with ``tiles`` of their block. Only blocks of several are joined, of which there are few."""
    wide = _tiles(rows, tile).where("tiles > 1")
    return _by_block(rows, wide, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))


def _own(tiles: str = "tiles") -> Column:
    return F.pmod(F.xxhash64("print"), F.col(tiles)).cast("int")


def _links(rows: DataFrame, by: list[str], threshold: Threshold) -> DataFrame:
    """Products of the groups of rows that agree in ``by``. They are grouped by a hash of it: rows that lie by block
    already would otherwise stay so, and all tiles of a block be worked on by one task. Groups of equal hash are one."""
    rows = rows.select(F.xxhash64(*by).alias("group"), "print", "text", "label", "search")
    return rows.groupBy("group").applyInPandas(lambda x: _multiplied(x, threshold), LINKS)


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows with the least print of their class so far."""
    known = labels.select(F.col("node").alias("print"), F.col("label").alias("to"))
    return rows.drop("label").join(known, "print", "left").withColumn("label", F.coalesce("to", "print")).drop("to")


def _found(full: DataFrame, threshold: Threshold, tile: int) -> DataFrame:
    """node and label of all rows (block, print, n, text) that link to others."""
    dealt = _tiled(full, tile).withColumns({"own": _own(), "label": F.col("print"), "search": F.lit(True)})
    links = written(_links(dealt, ["block", "own"], threshold), "jaccard-links")
    labels = propagated(links, "jaccard-classes")
    wide = dealt.where("tiles > 1")
    if wide.isEmpty():
        return labels
    # The least row of each class of each tile against those of the other tiles.
    heads_ = _labelled(wide, labels).where("label = print")
    pairs = _paired(_tiled(heads_.drop("tiles"), tile))
    links = links.unionByName(written(_links(pairs, ["block", "i", "j"], threshold), "jaccard-heads"))
    labels = propagated(links, "jaccard-classes")
    # What is apart still: all rows but those of the largest class, against all rows.
    wide = _labelled(wide, labels)
    counts = written(wide.groupBy("block", "label").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")), "jaccard-counts")
    largest = counts.groupBy("block").agg(F.max(F.struct("rows", "label"))["label"].alias("largest"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    apart = counts.join(largest, "block").where("label != largest").groupBy("block").agg(
        F.first("largest").alias("largest"), F.ceil(F.greatest(F.sum("rows") / tile, F.sum("n") / ENTRIES)).cast("int").alias("parts")
    )
    wide = written(_by_block(wide, apart).withColumn("search", F.col("label") != F.col("largest")), "jaccard-apart")
    if wide.isEmpty():
        return labels
    searched = wide.where("search").select("block", _own("parts").alias("i"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("j"), "print", "text", "label", "search", "own")
    others = wide.select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.col("own").alias("j"), "print", "text", "label", F.lit(False).alias("search"), _own("parts").alias("part"), F.col("search").alias("both"))
    # A row that is searched in this part already is not there twice.
    others = others.where("NOT (both AND part = i)").drop("part", "both")
    links = links.unionByName(written(_links(searched.drop("own").unionByName(others), ["block", "i", "j"], threshold), "jaccard-rest"))
    return propagated(links, "jaccard-classes")


def _paired(rows: DataFrame) -> DataFrame:
    """The rows in each pair of tiles that their own one is part of."""
    rows = rows.withColumn("own", _own()).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _paired_columns(texts: DataFrame, threshold: Threshold, ranks: bytes) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs (a, b) of rows that can link by what their leading columns say, the rows (print) that are left over, and the
    table that the pairs are read from."""
    num, den = threshold.num, threshold.den
    leading = texts.select("text").mapInArrow(partial(_leading, threshold=threshold, ranks=ranks), COLUMNS)
    nth = F.row_number().over(Window.partitionBy("column").orderBy("print"))
    # Members of a column stand in parts of bounded size: the first holds all of them, unless the column is hot.
    parts = leading.repartition("column").dropDuplicates(["column", "print"]).withColumn("part", F.floor((nth - 1) / (HOT + 1)))
    parts = parts.groupBy("column", "part").agg(F.sort_array(F.collect_list(F.struct("print", "n"))).alias("rows"))
    parts = written(parts.where("part > 0 OR size(rows) > 1 OR rows[0].n < 0").drop("column"), "jaccard-columns")
    hot = F.expr(f"part > 0 OR size(rows) > {HOT} OR rows[0].n < 0")
    over = written(parts.where(hot).select(F.explode("rows.print").alias("print")).distinct(), "jaccard-over")
    one = parts.where(~hot).select("rows", F.posexplode("rows").alias("k", "x"))
    two = one.select("x", F.explode(F.slice("rows", F.col("k") + 2, F.lit(HOT))).alias("y")).select(F.col("x.print").alias("a"), F.col("y.print").alias("b"), F.col("x.n").cast("long").alias("na"), F.col("y.n").cast("long").alias("nb"))
    near = two.where((F.least("na", "nb") * den >= F.greatest("na", "nb") * num))
    met = near.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("both"))
    overlap = F.expr(f"({num} * (na + nb) + {num + den - 1}) div {num + den}")

    def least(n: str) -> Column:
        """How many columns of its leading part a row must share: it can miss no more than its size less the overlap."""
        return F.expr(f"{n} - ({num} * {n} + {den - 1}) div {den} + 1") - (F.col(n) - overlap)

    return met.where(F.col("both") >= F.least(least("na"), least("nb"))).select("a", "b"), over, parts


def _own_texts(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows (print, first and more) with the texts that they stand for, once each."""
    held = rows.withColumns({"own_id": F.col("first.id"), "own_th": F.col("first.th")}).drop("first")
    # Always by a sorted merge: a broadcast would hold for small inputs alone. Texts travel, as their sets are larger.
    met = (F.col("th") == F.col("own_th")) & F.col("id").eqNullSafe(F.col("own_id"))
    found = texts.where("text IS NOT NULL").join(held.hint("merge"), met).drop("id", "th", "own_id", "own_th")
    return found.dropDuplicates(["print"])  # a row may be there many times


def _classes(docs: DataFrame, threshold: Threshold, tile: int) -> tuple[DataFrame, DataFrame]:
    """Sets (id, th, n, print; one row per input row), and of each distinct one print, first (its least row: late,
    id and th) and label (its class)."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = _texts(docs)
    all_ = written(texts.mapInArrow(partial(_prints, threshold=threshold), SETS), "jaccard-sets")
    sets = all_.where("chunk IS NULL").select("id", "th", "n", "print")
    row = F.struct(F.isnull("id").alias("late"), "id", "th")
    rows = sets.where("print IS NOT NULL").groupBy("print").agg(F.min(row).alias("first"), F.min("n").alias("n"))

    pairs, over, parts = _paired_columns(texts, threshold, _cell_ranks(all_))
    read, n = [parts], over.count()
    left = written(_own_texts(texts, rows.join(over, "print", "left_semi")).select("print", "text"), "jaccard-left-over")
    fewer = True
    while fewer and n >= AGAIN:
        ranks = _cell_ranks(left.select("text").mapInArrow(partial(_counts, threshold=threshold), CELLS))
        more, over, parts = _paired_columns(left, threshold, ranks)
        read, pairs, before, n = [*read, parts], pairs.unionByName(more), n, over.count()
        fewer = 4 * n < 3 * before
        if n < before:
            old, left = left, written(left.join(over.hint("merge"), "print", "left_semi"), "jaccard-left-over")
            drop(old)
    bands = written(left.select("text").mapInArrow(partial(_bands, threshold=threshold), BANDS), "jaccard-bands")
    drop(left)
    # Each row meets the least one of its band. Least ones are combined before they are shuffled, and the join's sides
    # are plain shuffles, so that Spark can split the rows of a band that very many share.
    low = bands.groupBy("band").agg(F.min("print").alias("low"), F.max("print").alias("high")).where("low < high").drop("high")
    low = written(low, "jaccard-lows")
    edges = bands.join(low.hint("merge"), "band").where("low < print").select(F.col("low").alias("a"), F.col("print").alias("b")).distinct()
    blocks = propagated(pairs.unionByName(edges), "jaccard-blocks").select(F.col("node").alias("print"), F.col("label").alias("block"))
    drop(bands, low, *read)

    full = written(_own_texts(texts, rows.join(blocks, "print")).select("block", "print", "n", "text"), "jaccard-texts")
    found = _found(full, threshold, tile)
    drop(full)
    return sets, rows.join(found.withColumnRenamed("node", "print"), "print", "left").select("print", "first", F.coalesce("label", "print").alias("label"))


def linked(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100, lower: bool = True, tile: int = TILE) -> DataFrame:
    """id (doc_id), n_shingles and component_id, one row per input row; null where a class has null ids alone."""
    sets, classes = _classes(docs, Threshold(words, num, den, lower), tile)
    heads_ = classes.groupBy("label").agg(F.min("first").alias("head"))
    classes = classes.join(heads_, "label").select("print", F.col("head.id").alias("component_id"))
    component = F.when(F.isnull("print"), F.col("id")).otherwise(F.col("component_id")).alias("component_id")
    return sets.join(classes, "print", "left").select("id", F.col("n").alias("n_shingles"), component)


def heads(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100, lower: bool = True, tile: int = TILE) -> DataFrame:
    """Exactly one row of ``docs`` of each class, one of least doc_id (of several the one whose text has the least
    hash, and of repeated ones one); rows whose text has no word all stay."""
    _, classes = _classes(docs, Threshold(words, num, den, lower), tile)
    first = written(classes.groupBy("label").agg(F.min("first").alias("head")).select("head.id", "head.th"), "jaccard-kept")
    text = F.col("text").cast("string")
    # Names of the input stay within a struct, so that none can clash with these.
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("th"), as_row(docs).alias("row"), F.coalesce(F.btrim(text, F.lit(SPACES)), F.lit("")).alias("words"))
    some = rows.where("words != ''").select("id", "th", "row", F.xxhash64("row").alias("place"), F.lit(False).alias("head"))
    # Heads meet the rows in one grouping, as a row without a place: texts are shuffled once, copies of a row combined before.
    none = F.lit(None)
    both = some.unionByName(first.select("id", "th", none.cast(rows.schema["row"].dataType).alias("row"), none.cast("long").alias("place"), F.lit(True).alias("head")))
    one = both.groupBy("id", "th").agg(F.min_by("row", "place").alias("row"), F.max("head").alias("head")).where("head").select("row")
    return one.unionByName(rows.where("words = ''").select("row")).select("row.*")
