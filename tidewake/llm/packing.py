"""Packing token sequences by non-negative least squares.

A document's ids, closed with an end id, are cut into full windows and a tail. Tails are counted by
length in a histogram of coarse bins (lengths rounded up). Combinations of few bins that fill a window are
enumerated, and non-negative least squares finds how often each should be repeated so that the counts meet the
histogram. Rounded counts are lowered where a bin runs out, so every combination can be filled; what is left is
packed greedily, one tail after the other, cut where a window is full.

The solver sees the histogram alone (a row for each length). Tails take their places in distributed fashion: each has a
rank among those of its bin, from counts by (bin, bucket) and a window over a bucket, and its sequence and
offset follow from the rank. No bin, however many tails have it, meets in one task.

Cases: a null text is an empty one and has the end id alone; repeated rows, and rows of one doc_id, are packed each;
texts of any length are cut into as many windows as they need; other columns never enter; an empty table gives
no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewake.llm.bpe import library_encoder
from tidewake.llm.shared import small_batches, written

WINDOW = 1024
#: Tokens of a bin of tail lengths, the most tails of a combination, and documents of a bucket by which tails are ranked
#: (on average; there are 256 buckets at least).
BIN, DEPTH, BUCKET_ROWS = 4, 3, 1 << 16

TAILS = "uid long, doc_id long, doc_tokens long, full array<long>, tail int, tail_crc32 long, tail_ids binary"


def _tokenised(batches: Iterator[pa.RecordBatch], path: str, end_id: int, window: int) -> Iterator[pa.RecordBatch]:
    encoder, uid = library_encoder(path), TaskContext.get().partitionId() << 40
    end, narrow = np.array([end_id], "<u4").tobytes(), encoder.size <= 1 << 16
    for batch in batches:
        rows = []
        for ids in encoder.encode_added([x or "" for x in batch.column("text").to_pylist()]):
            data, step = ids + end, 4 * window
            cut = len(data) // step * step
            tail = data[cut:]
            kept = np.frombuffer(tail, "<u4").astype("<u2").tobytes() if narrow else tail
            rows.append((uid, len(data) // 4, [zlib.crc32(data[k : k + step]) for k in range(0, cut, step)], len(tail) // 4, zlib.crc32(tail), kept))
            uid += 1
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.binary()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([arrays[0], batch.column("doc_id"), *arrays[1:]], [x.split()[0] for x in TAILS.split(", ")])


def combinations(units: int, depth: int) -> list[tuple[int, ...]]:
    """Up to ``depth`` positive numbers, in falling order, that sum to ``units``."""

    def below(left: int, most: int, depth: int) -> Iterator[tuple[int, ...]]:
        if 0 < left <= most:
            yield (left,)
        if depth > 1:
            for k in range(min(left - 1, most), -(-left // depth) - 1, -1):
                for rest in below(left - k, k, depth - 1):
                    yield (k, *rest)

    return list(below(units, units, depth))


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, most: int = 3_000) -> np.ndarray:
    """x >= 0 that makes a @ x nearest to b, by active sets: few columns have a positive x."""
    x = np.zeros(a.shape[1])
    inside: list[int] = []
    tolerance = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(most):
        pull = a.T @ (b - a @ x)
        pull[inside] = -np.inf
        j = int(pull.argmax())
        if pull[j] <= tolerance:
            break
        inside.append(j)
        while inside:
            part = a[:, inside]
            z = np.linalg.solve(part.T @ part + 1e-10 * np.eye(len(inside)), part.T @ b)
            if (z > 1e-9).all():
                break
            now = x[inside]
            down = z <= 1e-9
            step = np.min(now[down] / np.maximum(now[down] - z[down], 1e-30))
            now = now + step * (z - now)
            x[:] = 0
            x[inside] = np.maximum(now, 0)
            inside = [k for k, v in zip(inside, now, strict=True) if v > 1e-9]
        x[:] = 0
        if inside:
            x[inside] = z
    return x


@dataclass
class Plan:
    """Slots (bin, first and following rank, first sequence, offset) and, by bin, how many ranks they use."""

    slots: list[tuple[int, int, int, int, int]]
    used: dict[int, int]
    sequences: int


def plan(histogram: dict[int, int], units: int, width: int, depth: int = DEPTH) -> Plan:
    """How the bins of the histogram are to be combined; a bin's tails have at most bin * width tokens."""
    present = {k for k, v in histogram.items() if v}
    made = [c for c in combinations(units, depth) if present.issuperset(c)]
    slots, used, at = [], dict.fromkeys(sorted(present), 0), 0
    if made:
        bins = sorted(present)
        row = {k: i for i, k in enumerate(bins)}
        a = np.zeros((len(bins), len(made)))
        for j, c in enumerate(made):
            for k in c:
                a[row[k], j] += 1
        x = non_negative_least_squares(a, np.array([histogram[k] for k in bins], float))
        for j in np.argsort(-x, kind="stable"):
            wanted = int(np.rint(x[j]))
            need = {k: made[j].count(k) for k in made[j]}
            count = min([wanted, *((histogram[k] - used[k]) // n for k, n in need.items())])
            if count <= 0:
                continue
            offset = 0
            for k in made[j]:
                slots.append((k, used[k], used[k] + count, at, offset))
                used[k] += count
                offset += k
            at += count
    return Plan(slots, used, at)


def packed(docs: DataFrame, path: str, end_id: int = 0, window: int = WINDOW) -> DataFrame:
    """A row for each piece: doc_id, start and length in its document, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(texts.mapInArrow(partial(_tokenised, path=path, end_id=end_id, window=window), TAILS), "packing-tails")
    buckets = max(256, rows.count() // BUCKET_ROWS)  # the count is of a written table
    ranked = rows.select(
        "uid", "doc_id", "doc_tokens", "tail", "tail_crc32",
        F.ceil(F.col("tail") / BIN).cast("int").alias("bin"),
        F.size("full").cast("long").alias("n_full"),
        F.pmod(F.xxhash64("uid"), F.lit(buckets)).cast("int").alias("bucket"),
    )
    sums = ranked.groupBy("bin", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("n_full").alias("f"), F.sum("tail").alias("t"))
    sums = written(sums, "packing-sums")
    # At most a row for each bin: what the solver sees.
    bins = {r["bin"]: r for r in sums.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("f").alias("f"), F.sum("t").alias("t")).collect()}
    made = plan({k: r["n"] for k, r in bins.items() if k}, window // BIN, BIN)
    fulls, base = 0, {}
    for k in sorted(bins):
        base[k] = fulls
        fulls += bins[k]["f"]
    known = spark.createDataFrame([(k, base[k], made.used.get(k, 0)) for k in bins], "bin int, full_base long, used long")
    over = Window.partitionBy("bin").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("bin", "bucket", *[F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"{c}_before") for c in ("n", "f")])
    before = before.join(F.broadcast(known), "bin")
    each = Window.partitionBy("bin", "bucket").orderBy("uid")
    ranked = ranked.withColumns({
        "nth": F.row_number().over(each) - 1,
        "f_own": F.sum("n_full").over(each.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_full"),
    }).join(before, ["bin", "bucket"])
    ranked = ranked.select(
        "uid", "doc_id", "doc_tokens", "tail", "tail_crc32", "bin", "used",
        (F.col("nth") + F.col("n_before")).alias("rank"),
        (F.col("full_base") + F.col("f_before") + F.col("f_own")).alias("first_full"),
    )
    ranked = written(ranked, "packing-ranks")

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = rows.where("size(full) > 0").select("uid", "doc_id", "doc_tokens", F.posexplode("full").alias("k", "ids_crc32"))
    whole = whole.join(ranked.select("uid", "first_full"), "uid").select(
        "doc_id", (F.col("k").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("first_full") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    start = (F.col("doc_tokens") - F.col("tail")).alias("start")
    length = F.col("tail").cast("long").alias("length")

    # Tails within a combination: equal bins in one slot after the other, so places are shared by no two.
    slots = spark.createDataFrame(
        [(k, a, b, fulls + s, o) for k, a, b, s, o in made.slots] or [(0, 0, 0, 0, 0)],
        "bin int, low long, high long, sequence long, units long",
    )
    filled = ranked.where("tail > 0 AND rank < used").join(F.broadcast(slots), "bin").where("rank >= low AND rank < high")
    filled = filled.select(
        "uid", "doc_id", "doc_tokens", start, length, F.col("tail_crc32").alias("ids_crc32"),
        (F.col("sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), "units",
    )
    # Bins are rounded lengths: within a sequence a tail begins where the one before really ends.
    in_order = Window.partitionBy("sequence_id").orderBy("units").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = filled.withColumn("offset", F.sum("length").over(in_order) - F.col("length")).select(*names)

    rest = _rest(ranked.where("tail > 0 AND rank >= used"), rows, window, fulls + made.sequences, buckets)
    return whole.unionByName(filled).unionByName(rest.select(*names))


def _rest(tails: DataFrame, rows: DataFrame, window: int, first: int, buckets: int) -> DataFrame:
    """Tails that no combination took, strung together by bucket and cut at the windows' ends."""
    tails = tails.withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(buckets)).cast("int"))
    sums = tails.groupBy("bucket").agg(F.sum("tail").alias("t"))
    before = sums.select("bucket", (F.sum("t").over(Window.orderBy("bucket")) - F.col("t")).alias("base"))
    own = F.sum("tail").over(Window.partitionBy("bucket").orderBy(F.desc("tail"), "uid").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = tails.withColumn("own", own - F.col("tail")).join(before, "bucket").withColumn("place", F.col("base") + F.col("own"))
    placed = placed.select("uid", "doc_id", "doc_tokens", "tail", "tail_crc32", "place")
    fits = f"place % {window} + tail <= {window}"
    whole = placed.where(fits).select(
        "doc_id", "doc_tokens", (F.col("doc_tokens") - F.col("tail")).alias("start"), F.col("tail").cast("long").alias("length"),
        F.col("tail_crc32").alias("ids_crc32"), (first + F.floor(F.col("place") / window)).alias("sequence_id"), (F.col("place") % window).alias("offset"),
    )
    cut = placed.where(f"NOT ({fits})").join(rows.select("uid", "tail_ids"), "uid").mapInArrow(
        partial(_cut, window=window, first=first),
        "doc_id long, doc_tokens long, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
    return whole.unionByName(cut)


def _cut(batches: Iterator[pa.RecordBatch], window: int, first: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            ids = np.frombuffer(r["tail_ids"], "<u2" if len(r["tail_ids"]) == 2 * r["tail"] else "<u4").astype("<u4")
            a = 0
            while a < len(ids):
                sequence, offset = divmod(r["place"] + a, window)
                part = ids[a : a + window - offset]
                out.append((r["doc_id"], r["doc_tokens"], r["doc_tokens"] - r["tail"] + a, len(part), zlib.crc32(part.tobytes()), first + sequence, offset))
                a += len(part)
        columns = list(zip(*out, strict=True)) or [()] * 7
        names = ["doc_id", "doc_tokens", "start", "length", "ids_crc32", "sequence_id", "offset"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)
