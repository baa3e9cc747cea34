"""Line dedup by winnowing: later occurrences of runs of lines are deleted.

Units are the lines that have a word, compared exactly; blank lines are neither counted nor deleted.
Any run of ``guarantee`` lines, or of ``words`` words in fewer lines, that also occurs earlier (in a document of
smaller doc_id, or further up in the same one) is deleted; runs are judged on the input. Hashes of ``noise``
neighbouring lines are winnowed: of those within a run of ``guarantee`` lines, the leftmost least one is its
fingerprint, so every repeated run has a fingerprint in common with its first occurrence. A shorter run with enough
words is a fingerprint of its own. Fingerprints that occur once go; the places of the
others are joined, each extended by the lines left and right of it that its runs reach to, and the runs
that begin later than their first occurrence are deleted. Overlapping runs merge into maximal ones.

Cases: a null text has no lines; a null doc_id counts as the largest one; repeated rows (same doc_id and
text) are judged alike, so one never deletes the other; texts of fewer lines and words than a run stay; texts of any
length are read whole; other columns never enter, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.shared import drop, small_batches, written
from tidewake.llm.substring import cut_schema, keyed, with_found
from tidewake.llm.words import UNIT_BASES, Spans, Units, rounds, signed

NOISE, GUARANTEE, WORDS = 2, 3, 50

PRINTS = "print long, id long, th long, runs array<struct<at: int, size: int, x1: long, x2: long>>"


def _short_runs(lines: Units, guarantee: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """First lines and sizes of the runs of fewer lines that have enough words, none across two texts."""
    owner = np.repeat(np.arange(len(lines.before) - 1), np.diff(lines.before))
    total = np.append(0, np.cumsum(lines.words))
    firsts, sizes = [], []
    for size in range(1, guarantee):
        at = np.arange(max(0, len(owner) - size + 1))
        at = at[(total[at + size] - total[at] >= words) & (owner[at] == owner[at + size - 1])]
        firsts.append(at)
        sizes.append(np.full(len(at), size))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *firsts]), np.concatenate([none, *sizes])


def _prints(batches: Iterator[pa.RecordBatch], noise: int, guarantee: int, words: int) -> Iterator[pa.RecordBatch]:
    """The fingerprints of each text, with the runs around them that they stand for."""
    for batch in batches:
        ids, th = batch.column("id").to_numpy(), batch.column("th").to_numpy()
        for a, _, data, offsets in rounds(batch):
            lines = Units(data, offsets, lines=True)
            one, two = (Spans(lines.hashes(k), UNIT_BASES[k]) for k in (0, 1))
            at = np.arange(max(0, len(lines.first) - noise + 1))
            grams = one.hashes(at, at + noise)
            least_, runs_ = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for d in np.flatnonzero(np.diff(lines.before) >= guarantee).tolist():
                low, high = lines.before[d], lines.before[d + 1]
                views = sliding_window_view(grams[low : high - noise + 1], guarantee - noise + 1)
                least_.append(low + np.arange(len(views)) + views.argmin(1))
                runs_.append(low + np.arange(len(views)))
            least, first = np.concatenate(least_), np.concatenate(runs_)
            short, sizes = _short_runs(lines, guarantee, words)
            # Runs of one winnowed fingerprint stand together; each short run stands alone.
            turn = np.append(np.flatnonzero(np.append(True, np.diff(least) != 0)[: len(least)]), np.arange(len(least), len(least) + len(short)))
            size = np.append(np.full(len(first), guarantee), sizes)
            first = np.append(first, short)
            if not len(first):
                continue
            x1, x2 = (s.hashes(first, first + size) for s in (one, two))
            print_ = np.append(grams[least], x2[len(least) :])[turn]
            d = np.searchsorted(lines.before, first, "right") - 1
            at = (first - lines.before[d]).astype(np.int32)
            runs = pa.StructArray.from_arrays([pa.array(at), pa.array(size.astype(np.int32)), signed(x1), signed(x2)], names=["at", "size", "x1", "x2"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(turn, len(first)).astype(np.int32)), runs)
            own = a + d[turn]
            yield pa.RecordBatch.from_arrays([signed(print_), pa.array(ids[own]), pa.array(th[own]), lists], ["print", "id", "th", "runs"])


def deletable(docs: DataFrame, noise: int = NOISE, guarantee: int = GUARANTEE, words: int = WORDS) -> DataFrame:
    """id, th and the places and sizes (in lines that have a word) of the runs that occur earlier."""
    small_batches(docs.sparkSession)
    texts = keyed(docs)
    prints = written(texts.mapInArrow(partial(_prints, noise=noise, guarantee=guarantee, words=words), PRINTS), "line-prints")
    places = prints.select("print", F.struct("id", "th", F.col("runs")[0]["at"].alias("at")).alias("place"))
    # Written, so that the join's sides are plain shuffles, of which Spark can split a hot key's rows.
    again = places.groupBy("print").agg(F.min("place").alias("low"), F.max("place").alias("high")).where("low < high").select("print")
    again = written(again, "line-repeated")
    runs = prints.join(again, "print", "left_semi").select("id", "th", F.inline("runs"))
    place = F.struct("id", "at", "th")
    first = runs.groupBy("x1", "x2").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low < high").select("x1", "x2", "low")
    first = written(first, "line-first")
    late = runs.join(first, ["x1", "x2"]).where("struct(id, at) > struct(low.id, low.at)")
    late = written(late.groupBy("id", "th").agg(F.collect_set(F.struct("at", "size")).alias("late")), "line-late")
    drop(prints, again, first)
    return late


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        late, found = batch.column("late"), []
        ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(late), 0).to_numpy()))
        places, sizes = (late.flatten().field(name).to_numpy() for name in ("at", "size"))
        for a, b, data, offsets in rounds(batch):
            lines = Units(data, offsets, lines=True)
            text, counts = data.tobytes(), np.diff(lines.before)
            for d in range(b - a):
                own, low = text[offsets[d] : offsets[d + 1]], lines.before[d]
                change = np.zeros(counts[d] + 1, np.int32)
                those = slice(ends[a + d], ends[a + d + 1])
                np.add.at(change, places[those], 1)
                np.add.at(change, places[those] + sizes[those], -1)
                gone = np.flatnonzero(np.cumsum(change[:-1]) > 0)
                if len(gone):
                    all_lines = own.split(b"\n")
                    begins = np.cumsum([0, *(len(x) + 1 for x in all_lines)])[:-1]
                    drop = set(np.searchsorted(begins, lines.first[low + gone] - offsets[d]).tolist())
                    own = b"\n".join(x for k, x in enumerate(all_lines) if k not in drop)
                found.append((int(counts[d]), len(gone), own.decode()))
        n, removed, kept = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["row", "n_lines", "n_removed", "kept"]
        )


def deduplicated(docs: DataFrame, noise: int = NOISE, guarantee: int = GUARANTEE, words: int = WORDS) -> DataFrame:
    """``row`` (a struct of all columns of ``docs``), n_lines, n_removed and kept, the text without those lines."""
    small_batches(docs.sparkSession)
    cut = with_found(docs, deletable(docs, noise, guarantee, words), "late")
    return cut.mapInArrow(_cut, cut_schema(cut, "n_lines"))
