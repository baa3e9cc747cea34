"""Byte-level BPE encoding and decoding of text columns by a rank table.

``encode`` gives ids and, for each id, the byte offset in the text's UTF-8 form; ``decode`` inverts it
and accepts ids in any order. Each match of the pattern is encoded apart, without special tokens.

Cases: a null text is an empty one, which has no ids; texts of any length are encoded whole (a slice
of more than 100 bytes is merged over a heap); repeated rows each get a row; the other columns of
the input are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.bpe import rank_encoder


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = rank_encoder(path)
    for batch in batches:
        found = encoder.encode_with_offsets([x or "" for x in batch.column("text").to_pylist()])
        places = [at.astype("<u4").tobytes() for _, at in found]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _ in found], pa.binary()), pa.array(places, pa.binary())], ["doc_id", "ids", "offsets"])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the byte offset of each id (both little-endian unsigned 32-bit) of each text."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_encode, path=path), "doc_id long, ids binary, offsets binary")


def _decoded(batch: pa.RecordBatch, path: str) -> Iterator[tuple[np.ndarray, bytes, np.ndarray]]:
    """ids, bytes and places of each row. Offsets that came with the ids have to agree with what is decoded."""
    encoder = rank_encoder(path)
    kept = batch.column("offsets") if "offsets" in batch.schema.names else [None] * len(batch)
    for x, own in zip(batch.column("ids"), kept, strict=True):
        ids = np.frombuffer(x.as_py(), "<u4")
        text, at = encoder.decode(ids.astype(np.int64))
        if own is not None and not np.array_equal(np.frombuffer(own.as_py(), "<u4"), at[:-1]):
            raise ValueError("offsets and ids are not of one text")
        yield ids, text, at[:-1]


def _decode(batches: Iterator[pa.RecordBatch], path: str, offsets: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, places = [], []
        for _, text, at in _decoded(batch, path):
            texts.append(text)
            places.append(at.tolist() if offsets else None)
        columns = [batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.binary())]
        more = [pa.array(places, pa.list_(pa.int64()))] if offsets else []
        yield pa.RecordBatch.from_arrays([*columns, *more], ["doc_id", "ids", "decoded", *(["offsets"] if offsets else [])])


def decode(encoded: DataFrame, path: str, offsets: bool = False) -> DataFrame:
    """doc_id, ids and the bytes that they stand for; with ``offsets`` also each id's first byte. Offsets that came with
    the ids have to agree with what is decoded."""
    kind = "doc_id long, ids binary, decoded binary" + ", offsets array<long>" * offsets
    return encoded.mapInArrow(partial(_decode, path=path, offsets=offsets), kind)


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [
            (len(ids), hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest(), hashlib.sha256(text).hexdigest())
            for ids, text, _ in _decoded(batch, path)
        ]
        columns = list(zip(*rows, strict=True)) or [()] * 3
        kinds = [pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns, kinds)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """What ``decode`` gives, as counts and digests: of the ids (in decimal, joined by commas) and of the decoded bytes.
    One Python process for each task does both, as a third would have the memory of an executor."""
    return encoded.mapInArrow(partial(_digests, path=path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
