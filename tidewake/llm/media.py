"""Media columns: Netpbm and BMP images as binary columns, decoded to arrays, resized and hashed.

``encode_payload`` stores bytes losslessly as the samples of an 8-bit grey Netpbm image of 64 columns.
``decode`` reads Netpbm (P1 to P6, 8 or 16 bits) and uncompressed BMP (8, 24 or 32 bits). ``resized``
averages exact areas by integral images; ``difference_hash`` compares neighbours in a 9 x 8 tile, and
the tile itself is kept as the bytes of an NPY file.

Cases: a null text is stored as an empty one, which is 64 zero bytes; equal texts give equal values;
repeated rows each get a row; an image that can't be decoded raises, as a stored image always can be; texts of any
length are one image; other columns never enter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.shared import small_batches, written

WIDTH = 64
TILE = (8, 9)
#: Rows whose sums are held at once while an image is resized.
STRIP = 1 << 15

FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string, tile binary"
)


def padded(data: bytes) -> bytes:
    """``data`` with bytes 0 up to a positive multiple of 64."""
    return data + bytes(max(WIDTH, -(-len(data) // WIDTH) * WIDTH) - len(data))


def encode_payload(payload: bytes) -> bytes:
    """A grey Netpbm image (P5) whose samples are the payload, 64 to a row."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def decode(data: bytes) -> np.ndarray:
    """The image as rows x columns (grey) or rows x columns x 3, 8 or 16 bits a sample."""
    if data[:2] == b"BM":
        return _bmp(data)
    if len(data) > 2 and data[:1] == b"P" and data[1:2] in b"123456":
        return _netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


_FIELD = re.compile(rb"(?:\s|#[^\n]*\n)*([0-9]+)")


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, sizes = data[1] - ord("0"), 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _FIELD.match(data, at)
        if not m:
            raise ValueError("a Netpbm header that breaks off")
        sizes.append(int(m[1]))
        at = m.end()
    width, height, top = [*sizes, 1][:3]
    planes = 3 if kind in (3, 6) else 1
    count = width * height * planes
    if kind == 1:  # digits may stand without space between them
        out = 1 - np.array([c - ord("0") for c in re.sub(rb"#[^\n]*\n?|\s", b"", data[at:])[:count]], np.uint8)
    elif kind in (2, 3):
        out = np.array(re.sub(rb"#[^\n]*\n?", b" ", data[at:]).split()[:count], np.uint16 if top > 255 else np.uint8)
    elif kind == 4:
        rows = np.frombuffer(data, np.uint8, height * -(-width // 8), at + 1).reshape(height, -1)
        out = 1 - np.unpackbits(rows, axis=1)[:, :width].ravel()
    else:
        out = np.frombuffer(data, ">u2" if top > 255 else np.uint8, count, at + 1)
    return out.reshape((height, width, 3) if planes == 3 else (height, width))


def _bmp(data: bytes) -> np.ndarray:
    start, header = (int.from_bytes(data[k : k + 4], "little") for k in (10, 14))
    width, height = (int.from_bytes(data[k : k + 4], "little", signed=True) for k in (18, 22))
    bits, packing = int.from_bytes(data[28:30], "little"), int.from_bytes(data[30:34], "little")
    if packing or bits not in (8, 24, 32):
        raise ValueError(f"a BMP of {bits} bits, compression {packing}")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)[:, : width * bits // 8]
    rows = rows if height < 0 else rows[::-1]
    if bits > 8:
        return rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    used = int.from_bytes(data[46:50], "little") or 256
    palette = np.frombuffer(data, np.uint8, 4 * used, 14 + header).reshape(-1, 4)[:, 2::-1]
    out = palette[rows]
    return out[:, :, 0] if (palette == palette[:, :1]).all() else out


def _cuts(size: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole and broken part of the edges that cut ``size`` samples into equal areas."""
    edges = np.arange(parts + 1) * size / parts
    whole = np.minimum(edges.astype(np.int64), size - 1)
    return whole, edges - whole


def resized(image: np.ndarray, shape: tuple[int, int] = TILE) -> np.ndarray:
    """The grey image averaged over equal areas: sums along rows, then down columns, read at the edges."""
    if image.ndim == 3:
        image = image @ np.array([0.299, 0.587, 0.114])
    height, width = image.shape
    at, part = _cuts(width, shape[1])
    bands = np.empty((height, shape[1]))
    for k in range(0, height, STRIP):  # an image of any height in bounded memory
        strip = image[k : k + STRIP].astype(np.float64)
        sums = np.zeros((len(strip), width + 1))
        np.cumsum(strip, axis=1, out=sums[:, 1:])
        bands[k : k + STRIP] = np.diff(sums[:, at] + part * strip[:, at], axis=1)
    at, part = _cuts(height, shape[0])
    sums = np.zeros((height + 1, shape[1]))
    np.cumsum(bands, axis=0, out=sums[1:])
    return np.diff(sums[at] + part[:, None] * bands[at], axis=0) * (shape[0] * shape[1] / (height * width))


def difference_hash(tile: np.ndarray) -> str:
    """64 bits in hexadecimal: whether each of 8 x 8 samples is below its right neighbour."""
    return np.packbits(tile[:, :-1] < tile[:, 1:]).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.rint(tile).astype(np.uint8))
    return out.getvalue()


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [(x or "").encode() for x in batch.column("text").to_pylist()]
        media = [encode_payload(padded(x)) for x in raw]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"]
        )


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for media in batch.column("media"):
            stored = media.as_py()
            image = decode(stored)
            payload, tile = image.tobytes(), resized(image)
            rows.append((
                len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]),
                len(stored), hashlib.sha256(stored).hexdigest(), difference_hash(tile), npy(tile),
            ))
        columns = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_bytes"), *map(pa.array, columns, kinds)],
            ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"],
        )


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the image of each text, as a table in the shared folder."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(_store, "doc_id long, n_bytes long, media binary"), "media")


def features(media: DataFrame) -> DataFrame:
    """What the stored images hold, read back, with difference hash and NPY tile."""
    small_batches(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, FEATURES)
