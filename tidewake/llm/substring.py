"""Substring dedup by level-wise doubling: words covered by long windows that an earlier document has.

Lengths double from a quarter of the final one (13, 26 and 50 words), and only what is repeated at one length is
looked at with the next:

1. Windows of a quarter. Of those that begin in one full window only the one of least hash is taken: equal full
   windows have equal least ones, so nothing is lost. Those that only one document has are done, with all full windows
   around them.
2. Windows of a half: each survivor is extended to twice its length, forward for the full windows in which that fits
   and backward for the others. Full windows whose half only one document has are done.
3. Full windows. Those that are left around a survivor are looked at together first, as one span: equal spans settle every document
   but the first at once. Single full windows are compared only for the first documents of spans whose
   survivor other spans share, at all places where they have them. Longer repeats are unions of full windows, so the
   doubling ends there, and it ends before wherever no candidate is left.

Cases: a null text has no words; a null doc_id counts as the largest one; rows of one doc_id are judged
each by its own text, and never against each other, so repeated rows are cut alike; texts shorter than the window stay;
texts of any length are read whole; columns other than doc_id and text never enter, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from tidewake.llm.shared import as_row, drop, small_batches, written
from tidewake.llm.words import UNIT_BASES, Spans, Units, rounds, signed

WINDOW = 50
LAST_ID = (1 << 63) - 1

ANCHORS = "anchor long, right long, left long, id long, th long, start int, cut int, length int, span long, span_right long, span_left long"
WINDOWS = "x1 long, x2 long, id long, th long, start int"


def _spans(words: Units) -> tuple[Spans, Spans]:
    return Spans(words.hashes(0), UNIT_BASES[0]), Spans(words.hashes(1), UNIT_BASES[1])


def _batch(names: str, *columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [x.split()[0] for x in names.split(", ")])


def _lengths(window: int) -> tuple[int, int]:
    """A quarter of the window, rounded up, and twice that."""
    quarter = -(-window // 4)
    return quarter, min(window, 2 * quarter)


def _anchors(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The least quarter of each run of full windows that share it, its extension forward and backward, and the span of
    those windows: whole, and what of it each extension stands for (``cut`` windows backward, the others forward)."""
    quarter, half = _lengths(window)
    for batch in batches:
        ids, th = batch.column("id").to_numpy(), batch.column("th").to_numpy()
        for a, _, data, offsets in rounds(batch):
            words = Units(data, offsets)
            one, two = _spans(words)
            first = np.arange(max(0, len(words.first) - quarter + 1))
            quarters = one.hashes(first, first + quarter)
            found = []
            for d in np.flatnonzero(np.diff(words.before) >= window).tolist():
                low, high = words.before[d], words.before[d + 1]
                views = sliding_window_view(quarters[low : high - quarter + 1], window - quarter + 1)
                least = views.argmin(1) + np.arange(len(views))  # the leftmost of the least, for each window
                turn = np.flatnonzero(np.diff(least)) + 1
                start, last = np.append(0, turn), np.append(turn, len(least)) - 1
                found.append((np.full(len(start), d), low + least[start], low + start, low + last))
            if not found:
                continue
            d, at, start, last = map(np.concatenate, zip(*found, strict=True))
            forward = np.maximum(start, at - (window - half))  # the first full window in which the extension forward fits
            cut = np.minimum(forward, last + 1) - start
            ahead, behind = start + cut <= last, cut > 0
            right = np.where(ahead, one.hashes(at, np.minimum(at + half, len(words.first))).view(np.int64), 0)
            left = np.where(behind, one.hashes(np.maximum(at + quarter - half, 0), at + quarter).view(np.int64), 0)
            stop = last + window
            yield _batch(
                ANCHORS, signed(quarters[at]), pa.array(right, mask=~ahead), pa.array(left, mask=~behind), ids[a + d], th[a + d],
                (start - words.before[d]).astype(np.int32), cut.astype(np.int32), (stop - start).astype(np.int32),
                signed(two.hashes(start, stop)), signed(two.hashes(np.minimum(start + cut, last), stop)), signed(two.hashes(start, np.maximum(start + cut - 1, start) + window)),
            )


def _doubled(left: DataFrame, window: int) -> DataFrame:
    """Level two: of each survivor the full windows whose half other documents have too, as (anchor, span, id, th, start,
    length)."""
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("right").alias("half")), F.struct(F.lit(1).alias("side"), F.col("left").alias("half")))
    halves = left.select("id", F.inline(sides)).where("half IS NOT NULL").groupBy("side", "half").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    halves = written(halves.where("low < high").select("side", "half"), "substring-halves")
    for side, name in ((0, "right"), (1, "left")):
        known = halves.where(F.col("side") == side).select(F.col("half").alias("key"), F.lit(True).alias(f"{name}_too"))
        # Rows without this side would all have one key; they get any of their own.
        left = left.withColumn("key", F.coalesce(name, F.xxhash64("id", "th", "start"))).join(known, "key", "left").drop("key")
    forward = F.isnotnull("right") & F.coalesce("right_too", F.lit(False))
    backward = F.isnotnull("left") & F.coalesce("left_too", F.lit(False))
    # What falls away at the one side is the windows that only the other extension stands for.
    whole = (forward | F.isnull("right")) & (backward | F.isnull("left"))
    start = F.when(whole | backward, F.col("start")).otherwise(F.col("start") + F.col("cut"))
    length = F.when(whole, F.col("length")).when(backward, F.col("cut") + (window - 1)).otherwise(F.col("length") - F.col("cut"))
    span = F.when(whole, F.col("span")).when(backward, F.col("span_left")).otherwise(F.col("span_right"))
    return left.where(forward | backward).select("anchor", span.alias("span"), "id", "th", start.alias("start"), length.alias("length"))


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Both hashes of each full window in the listed spans."""
    for batch in batches:
        ids, th, lists = batch.column("id").to_numpy(), batch.column("th").to_numpy(), batch.column("spans").to_pylist()
        for a, b, data, offsets in rounds(batch):
            words = Units(data, offsets)
            one, two = _spans(words)
            rows, starts = [], []
            for d in range(b - a):
                own = [np.arange(s["start"], s["start"] + s["length"] - window + 1) for s in lists[a + d]]
                if own:
                    at = np.unique(np.concatenate(own))
                    rows.append(np.full(len(at), d))
                    starts.append(at)
            if rows:
                d, at = np.concatenate(rows), np.concatenate(starts)
                first = words.before[d] + at
                yield _batch(
                    WINDOWS, signed(one.hashes(first, first + window)), signed(two.hashes(first, first + window)), ids[a + d], th[a + d], at.astype(np.int32)
                )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists, counts = batch.column("spans").to_pylist(), []
        for a, b, data, offsets in rounds(batch):
            text = data.tobytes()
            for d in range(b - a):
                own = text[offsets[d] : offsets[d + 1]].split()  # at the same six characters
                n, change = len(own), np.zeros(len(own) + 1, np.int32)
                for s in lists[a + d] or ():
                    change[s["start"]] += 1
                    change[s["start"] + s["length"]] -= 1
                gone = np.cumsum(change[:-1]) > 0 if change.any() else None
                kept = own if gone is None else [own[k] for k in np.flatnonzero(~gone).tolist()]
                counts.append((n, n - len(kept), b" ".join(kept).decode()))
        n, removed, kept = zip(*counts, strict=True) if counts else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["row", "n_words", "n_removed", "kept"]
        )


def key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))


def _text(of: Column) -> Column:
    return F.coalesce(of.cast("string"), F.lit(""))


def keyed(docs: DataFrame, with_row: bool = False) -> DataFrame:
    """id, th and text or the whole row. Rows are found again by id and a hash of the text, so many rows of one
    id (null ones above all) don't meet; a null text and an empty one are alike."""
    text = _text(F.col("text"))
    return docs.select(key().alias("id"), F.xxhash64(text).alias("th"), as_row(docs).alias("row") if with_row else text.alias("text"))


def with_found(docs: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """row, text and what was found by id and th, as ``name``. The text is taken out of the row after the join, so that it is shuffled once."""
    return keyed(docs, with_row=True).join(found, ["id", "th"], "left").select("row", _text(F.col("row")["text"]).alias("text"), name)


def cut_schema(df: DataFrame, units: str) -> StructType:
    return StructType([df.schema["row"]]).add(units, LongType()).add("n_removed", LongType()).add("kept", StringType())


def removable(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """id, th (what tells rows of one id apart: a hash of the text) and spans (start, length, in words) that earlier
    documents have."""
    texts = keyed(docs)
    small_batches(docs.sparkSession)
    # Level one.
    anchors = texts.mapInArrow(partial(_anchors, window=window), ANCHORS)
    shared = anchors.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("anchor")
    # Written, so that the join's sides are plain shuffles, of which Spark can split a hot key's rows.
    shared = written(shared, "substring-shared")
    quarters = written(anchors.join(shared, "anchor", "left_semi"), "substring-quarters")
    # Level two.
    left = written(_doubled(quarters, window), "substring-anchors")
    drop(shared, quarters)
    # Level three.
    spans = left.groupBy("anchor", "span").agg(F.min("id").alias("first"))
    spans = written(spans, "substring-spans")
    whole = left.join(spans, ["anchor", "span"]).where("id > first").select("id", "th", "start", "length")
    several = spans.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    several = written(several, "substring-several")
    opened = written(spans.join(several, "anchor", "left_semi").withColumnRenamed("first", "id"), "substring-opened")
    # A document can have a span at several places, and no earlier one has settled any of them.
    open_ = left.join(opened, ["anchor", "span", "id"], "left_semi")
    open_ = open_.groupBy("id", "th").agg(F.collect_set(F.struct("start", "length")).alias("spans"))
    windows = written(texts.join(open_, ["id", "th"]).mapInArrow(partial(_windows, window=window), WINDOWS), "substring-windows")
    early = windows.groupBy("x1", "x2").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("x1", "x2", "low")
    early = written(early, "substring-early")
    single = windows.join(early, ["x1", "x2"]).where("id > low").select("id", "th", "start", F.lit(window).alias("length"))
    found = whole.unionByName(single).groupBy("id", "th").agg(F.collect_set(F.struct("start", "length")).alias("spans"))
    found = written(found, "substring-removable")
    drop(left, spans, several, opened, windows, early)
    return found


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``row`` (a struct of all columns of ``docs``), n_words, n_removed and kept, the kept words joined by a space."""
    small_batches(docs.sparkSession)
    cut = with_found(docs, removable(docs, window), "spans")
    return cut.mapInArrow(_cut, cut_schema(cut, "n_words"))
