"""Fill-in-middle: texts are stored as independent zstandard frames, cut at units and put together in another order.

``stored`` compresses each text in frames of at most ``FRAME`` bytes, each with the number of units (letter runs, or
single other code points) and of code points that begin before it. ``transformed`` finds the two cuts by these counts,
decompresses only the frames that are cut, and lists the output's frames: whole ones as they are, parts of cut ones
compressed anew, marks between. ``digests`` streams an output's frames in order; ``Frames.span`` gives any stretch of it,
so the text is restored from output and form alone: marks are looked for in one pass, the parts are read in a second.

Cases: a null text is empty and stays plain, as do empty ones and those with a mark in them; a null doc_id draws from
the word ``null``; repeated rows each get a row, all alike; texts of any length are cut anywhere, a frame at a time; other
columns never enter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.shared import small_batches, written

#: Bytes of text in a frame.
FRAME = 1 << 16
PREFIX, SUFFIX, MIDDLE = MARKS = b"<P>", b"<S>", b"<M>"
#: The output's marks in order, and where its three parts go when the text is restored.
FORMS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: Hundredths of texts that are transformed, and of those that get the form ``spm``.
CHANGED, SPM = 90, 20
SEED = 1

STORED = "doc_id long, marked boolean, n long, n_chars long, frames array<struct<units: long, chars: long, letter: boolean, data: binary>>"
CUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output array<binary>"
DIGESTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


def unit_starts(data: bytes, letter: bool) -> np.ndarray:
    """The bytes at which a unit begins; ``letter``: whether a letter stands right before ``data``."""
    raw = np.frombuffer(data, np.uint8)
    letters = _LETTER[raw]
    inside = np.append(letter, letters[:-1])[: len(raw)]
    return np.flatnonzero(((raw & 0xC0) != 0x80) & ~(letters & inside))


def n_chars(data: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def pieces(data: bytes) -> Iterator[bytes]:
    """``data`` in parts of at most FRAME bytes that end where a code point does."""
    at = 0
    while at < len(data):
        stop = min(len(data), at + FRAME)
        while stop < len(data) and data[stop] & 0xC0 == 0x80:
            stop -= 1
        yield data[at:stop]
        at = stop


class Frames:
    """A sequence of independent frames as one sequence of bytes."""

    def __init__(self, frames: list[bytes]) -> None:
        self.frames, self.open = frames, zstandard.ZstdDecompressor()
        self.ends = np.cumsum([zstandard.frame_content_size(x) for x in frames], dtype=np.int64).tolist()
        self.size = self.ends[-1] if frames else 0

    def span(self, first: int, after: int) -> Iterator[bytes]:
        """The bytes from ``first`` up to ``after``, from the frames that hold some of them."""
        k = bisect_right(self.ends, first)
        while first < after:
            begin = self.ends[k - 1] if k else 0
            data = self.open.decompress(self.frames[k])
            yield data[first - begin : after - begin]
            first, k = self.ends[k], k + 1

    def find(self, mark: bytes, first: int) -> int:
        """Where ``mark`` first stands at or after ``first``, across frames too."""
        held, at = b"", first
        for part in self.span(first, self.size):
            held += part
            k = held.find(mark)
            if k >= 0:
                return at + k
            keep = min(len(held), len(mark) - 1)
            at, held = at + len(held) - keep, held[len(held) - keep :]
        raise ValueError(f"no {mark.decode()} in an output")


def restored(output: Frames, form: str) -> Iterator[bytes]:
    """The text that an output was made of, a part at a time."""
    if form == "plain":
        yield from output.span(0, output.size)
        return
    marks, at = FORMS[form], len(FORMS[form][0])
    part, begin = {}, at
    for mark, following in zip(marks, (*marks[1:], None), strict=True):
        stop = output.size if following is None else output.find(following, begin)
        part[mark] = (begin, stop)
        begin = stop + len(following or b"")
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from output.span(*part[mark])


def drawn(doc_id: int | None, n: int, empty_or_marked: bool, seed: int = SEED) -> tuple[str, int, int]:
    """Form and both cuts (in units) of a text of ``n`` units."""
    name = "null" if doc_id is None else str(doc_id)
    h = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    one, two, three, four = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    a, b = sorted((one % (n + 1), two % (n + 1)))
    if empty_or_marked or three % 100 >= CHANGED:
        return "plain", a, b
    return ("spm" if four % 100 < SPM else "psm"), a, b


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor()
    frame = pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("letter", pa.bool_()), ("data", pa.binary())])
    kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.list_(frame)]
    for batch in batches:
        rows = []
        for value in batch.column("text"):
            data = value.as_py()
            units = chars = 0
            letter, frames = False, []
            for part in pieces(data):
                frames.append({"units": units, "chars": chars, "letter": letter, "data": squeeze.compress(part)})
                units, chars = units + len(unit_starts(part, letter)), chars + n_chars(part)
                letter = bool(_LETTER[part[-1]])
            rows.append((any(m in data for m in MARKS), units, chars, frames))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns, kinds)], ["doc_id", "marked", "n", "n_chars", "frames"])


def stored(docs: DataFrame) -> DataFrame:
    """The texts as frames with running counts, a table in the shared folder."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b"")).alias("text"))
    return written(rows.mapInArrow(_stored, STORED), "fim-frames")


class _Store:
    """A text's frames with running counts of units and code points."""

    def __init__(self, frames: list[dict], n: int, chars: int) -> None:
        self.data = [x["data"] for x in frames]
        self.units, self.chars, self.letter = ([x[k] for x in frames] for k in ("units", "chars", "letter"))
        self.n, self.n_chars, self.open = n, chars, zstandard.ZstdDecompressor()

    def place(self, unit: int) -> tuple[int, int, int]:
        """Frame, byte in it and code points before the beginning of a unit; after the last one, the end."""
        if unit == self.n:
            return len(self.data), 0, self.n_chars
        k = bisect_right(self.units, unit) - 1
        data = self.open.decompress(self.data[k])
        at = int(unit_starts(data, self.letter[k])[unit - self.units[k]])
        return k, at, self.chars[k] + n_chars(data[:at])

    def between(self, first: tuple[int, int, int], after: tuple[int, int, int], squeeze: zstandard.ZstdCompressor) -> list[bytes]:
        """The frames of a stretch: those wholly in it as they are, parts of others compressed anew."""
        found = []
        for k in range(first[0], min(after[0] + 1, len(self.data))):
            begin, stop = first[1] if k == first[0] else 0, after[1] if k == after[0] else None
            if stop == 0:
                break
            whole = not begin and stop is None
            found.append(self.data[k] if whole else squeeze.compress(self.open.decompress(self.data[k])[begin:stop]))
        return found


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor()
    mark = {m: squeeze.compress(m) for m in MARKS}
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.binary())]
    for batch in batches:
        rows = []
        for doc_id, marked, n, chars, frames in zip(*(batch.column(c) for c in ("doc_id", "marked", "n", "n_chars", "frames")), strict=True):
            text = _Store(frames.as_py(), n.as_py(), chars.as_py())
            form, a, b = drawn(doc_id.as_py(), text.n, marked.as_py() or not text.n)
            if form == "plain":
                rows.append((form, None, None, text.data))
                continue
            none, one, two, end = text.place(0), text.place(a), text.place(b), text.place(text.n)
            part = {PREFIX: (none, one), MIDDLE: (one, two), SUFFIX: (two, end)}
            output = [x for m in FORMS[form] for x in (mark[m], *text.between(*part[m], squeeze))]
            rows.append((form, one[2], two[2] - one[2], output))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n"), *map(pa.array, columns, kinds)], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        )


def transformed(store: DataFrame) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and the output as frames."""
    small_batches(store.sparkSession)
    return store.select("doc_id", "marked", "n", "n_chars", "frames").mapInArrow(_cut, CUT)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for form, frames in zip(batch.column("form"), batch.column("output"), strict=True):
            output = Frames(frames.as_py())
            sums = hashlib.sha256(), hashlib.sha256()
            for total, parts in zip(sums, (output.span(0, output.size), restored(output, form.as_py())), strict=True):
                for part in parts:
                    total.update(part)
            rows.append([x.hexdigest() for x in sums])
        columns = list(zip(*rows, strict=True)) or [()] * 2
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, names), *(pa.array(x, pa.string()) for x in columns)], [*names, "output_sha256", "restored_sha256"])


def digests(cut: DataFrame) -> DataFrame:
    """Digests of each output, and of the text restored from output and form."""
    return cut.mapInArrow(_digests, DIGESTS)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        outputs = [Frames(x.as_py()) for x in batch.column("output")]
        texts = [b"".join(x.span(0, x.size)).decode() for x in outputs]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("form"), pa.array(texts, pa.string())], ["doc_id", "form", "text"])


def texts(cut: DataFrame) -> DataFrame:
    """The outputs as plain texts, for training."""
    return cut.select("doc_id", "form", "output").mapInArrow(_texts, "doc_id long, form string, text string")
