"""Spelling variants: words that are one edit apart, grouped under the far more frequent of them.

Words are runs of Latin letters, counted over all texts. Two words are near where the longest common prefix and suffix
together reach the longer length minus one. Pairs are looked for within tiles of padded code-point matrices, block by
block. What makes blocks small is the same bound: of two near words, the shorter of length s, and at any place m, either
the first m code points agree or the last s - m do. So each word goes into groups of words that agree outside a stretch
of places; a group that is too large is halved into two of shorter stretches, until groups are small or the stretch is one
place, where the alphabet bounds them. The place of a pair's edit lies in one stretch alone, so each pair is found once.

Cases: a null text has no words; a null doc_id counts as the word ``null``; repeated rows count each; texts and words of
any length are read whole (a tile of long words has fewer rows); ties between forms go to the smallest word in code-point
order; other columns never enter; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm.shared import small_batches, written

MODULUS, LEAST_LENGTH, LEAST_COUNT, RATIO = 199, 6, 5, 5
#: Rows of a group that is not halved, rows and code points of a block.
GROUP, BLOCK, CELLS = 2048, 256, 1 << 20
#: Different words that a counting task holds before it hands their counts on.
HELD = 1 << 18

_RUN = re.compile("[a-zÀ-ÿ]+")

COUNTS = "word string, n long"
PAIRS = "word string, n long, near string, near_n long"


def without_one(word: str, h: int) -> str:
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def _counted(batches: Iterator[pa.RecordBatch], modulus: int) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            start = zlib.crc32(b"%b:" % str("null" if doc_id.as_py() is None else doc_id).encode())
            runs = _RUN.findall(text.as_py().lower().decode("utf-8", "replace"))  # bytes: lower-cases A-Z alone
            for run, k in Counter(runs).items():
                h = zlib.crc32(run.encode(), start)
                held[run if h % modulus else without_one(run, h)] += k
            if len(held) > HELD:
                yield out()
                held.clear()
    yield out()


def words(docs: DataFrame, modulus: int = MODULUS, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """Different words with their counts, of those long and frequent enough."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).where("text IS NOT NULL")
    counts = rows.mapInArrow(partial(_counted, modulus=modulus), COUNTS).where(F.char_length("word") >= least_length)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _grouped(rows: DataFrame) -> DataFrame:
    """``key``: what agrees within a group, the places before ``lo`` and those from ``hi`` on, counted in the shorter word."""
    kept = F.col("s") - F.col("hi")
    head, tail = F.substr("word", F.lit(1), F.col("lo")), F.substr("word", F.col("size") - kept + 1, kept)
    return rows.withColumn("key", F.xxhash64("s", "lo", "hi", head, tail))


def _stretches(*cuts: tuple[Column, Column]) -> Column:
    return F.inline(F.array(*[F.struct(a.alias("lo"), b.alias("hi")) for a, b in cuts]))


def groups(found: DataFrame, most: int = GROUP) -> DataFrame:
    """The rows of ``found`` (word, n) in all their groups, none of which has more than ``most`` rows unless its stretch is
    one place."""
    sized = found.select("word", "n", F.char_length("word").alias("size"))
    rows = sized.select("*", F.explode(F.array("size", F.col("size") - 1)).alias("s"))
    half, zero = F.floor(F.col("s") / 2).cast("int"), F.lit(0)
    rows = rows.select("*", _stretches((zero, half), (half, F.col("s"))))
    ready = None
    while True:
        rows = written(_grouped(rows), "spelling-groups")
        counts = rows.groupBy("key").agg(F.count("*").alias("rows"), F.count_if(F.col("size") == F.col("s")).alias("shorter"))
        # Written, so that both sides of the joins are plain shuffles, of which Spark can split a hot group's rows.
        counts = written(counts.where("rows > 1 AND shorter > 0"), "spelling-counts")
        paired = rows.join(counts, "key").withColumn("large", (F.col("rows") > most) & (F.col("hi") - F.col("lo") > 1))
        paired = written(paired.drop("rows", "shorter"), "spelling-paired")
        small = paired.where("NOT large").drop("large")
        ready = small if ready is None else ready.unionByName(small)
        large = paired.where("large")
        if large.isEmpty():
            return ready
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        rows = large.select("word", "n", "size", "s", _stretches((F.col("lo"), middle), (middle, F.col("hi"))))


def matrices(found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of the words, and their code points in rows that begin, or end, together."""
    sizes = np.array([len(w) for w in found], np.int64)
    flat = np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.uint8 if not len(flat) or flat.max() < 256 else np.uint32
    width = int(sizes.max(initial=0))
    row = np.repeat(np.arange(len(found)), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left, right = np.zeros((len(found), width), kind), np.zeros((len(found), width), kind)
    left[row, at] = flat
    right[row, at + (width - sizes)[row]] = flat
    return sizes, left, right


def _agreeing(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each row of ``a`` and each of ``b``: the number of leading columns that agree, ``least`` at most."""
    alive, count = np.ones(least.shape, bool), np.zeros(least.shape, np.int32)
    for k in range(min(a.shape[1], b.shape[1])):
        alive &= a[:, k, None] == b[None, :, k]
        if not alive.any():
            break
        count += alive
    return np.minimum(count, least)


def near(one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Whether each word of one block is near each of another, and the length of their common prefix."""
    (la, left_a, right_a), (lb, left_b, right_b) = one, two
    least, most = np.minimum(la[:, None], lb[None]), np.maximum(la[:, None], lb[None])
    before = _agreeing(left_a, left_b, least)
    after = _agreeing(right_a[:, ::-1], right_b[:, ::-1], least)
    same = (before == least) & (least == most)
    return (before + after >= most - 1) & (most - least <= 1) & ~same, before


def _block_pairs(key: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Blocks of rows in the order of keys, each with itself and with those after it that its last group goes on in."""
    step = max(1, min(BLOCK, CELLS // max(1, int(sizes.max(initial=1)))))
    for a in range(0, len(key), step):
        b = min(a + step, len(key))
        yield slice(a, b), slice(a, b)
        begin = a + int(np.argmax(key[a:b] == key[b - 1]))
        for c in range(b, len(key), step):
            if key[c] != key[b - 1]:
                break
            d = min(c + step, len(key))
            yield slice(begin, b), slice(c, c + int(np.count_nonzero(key[c:d] == key[c])))


def _pairs(rows: pa.Table) -> pa.RecordBatch | None:
    found = rows.column("word").to_pylist()
    key, s, lo, hi, n = (rows.column(c).to_numpy() for c in ("key", "s", "lo", "hi", "n"))
    sizes = np.array([len(w) for w in found], np.int64)
    firsts, seconds = [], []
    for x, y in _block_pairs(key, sizes):
        one = matrices(found[x])
        two = one if x == y else matrices(found[y])
        close, before = near(one, two)
        place = np.minimum(before, s[x, None] - 1)
        close &= (key[x, None] == key[None, y]) & (place >= lo[x, None]) & (place < hi[x, None])
        close &= (sizes[x, None] == s[x, None]) | (sizes[None, y] == s[x, None])
        if x == y:
            close = np.triu(close, 1)
        i, j = np.nonzero(close)
        firsts += [i + x.start, j + y.start]
        seconds += [j + y.start, i + x.start]
    if not firsts:
        return None
    i, j = np.concatenate(firsts), np.concatenate(seconds)
    column = pa.array(found, pa.string())
    return pa.RecordBatch.from_arrays([column.take(pa.array(i)), pa.array(n[i]), column.take(pa.array(j)), pa.array(n[j])], ["word", "n", "near", "near_n"])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both directions of all near pairs; a group that goes on in the next batch waits for it."""
    held: list[pa.RecordBatch] = []

    def out(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _pairs(pa.Table.from_batches(parts)) if parts else None
        if found is not None:
            yield found

    for batch in batches:
        key = batch.column("key").to_numpy()
        if not len(key):
            continue
        last = int(np.argmax(key == key[-1]))  # its rows stand together, at the end
        if last or (held and held[-1].column("key")[-1].as_py() != key[0]):
            if last:
                yield from out([*held, batch.slice(0, last)])
            else:
                yield from out(held)
            held = []
        held.append(batch.slice(last))
    yield from out(held)


def pairs(found: DataFrame, most: int = GROUP) -> DataFrame:
    """word, n, near, near_n: each two near words in both directions."""
    small_batches(found.sparkSession)
    rows = groups(found, most).repartition("key").sortWithinPartitions("key")
    return rows.select("key", "word", "n", "s", "lo", "hi").mapInArrow(_tiles, PAIRS)


def roots(links: DataFrame) -> DataFrame:
    """word, root: the last word that the links (word, form) lead to. Counts grow along a link, so that none leads back;
    each round doubles the links that are followed at once."""
    chains = written(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = chains.select(F.col("word").alias("root"), F.col("root").alias("further"))
        chains = chains.select("word", "root")
        chains = written(chains.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), "further"), "spelling-roots")
        if chains.where("further IS NOT NULL").isEmpty():
            return chains.select("word", "root")


def grouped(docs: DataFrame, ratio: int = RATIO, most: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of the texts."""
    found = written(words(docs), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    close = pairs(found, most).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    form_n = -F.col("best.n")
    strong = form_n >= ratio * F.col("n")
    close = written(
        close.select("word", "n_near", F.when(strong, F.col("best.word")).alias("form"), F.when(strong, form_n).alias("form_n")), "spelling-near"
    )
    ends = roots(close.where("form IS NOT NULL"))
    return (
        found.join(close, "word", "left").join(ends, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")
    )
