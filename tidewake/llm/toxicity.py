"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Texts are lower-cased, and their n-grams of 3 to 7 code points are hashed to buckets; what counts is whether a
text has a bucket. Over labelled texts, a bucket's ratio is the log of its smoothed share among toxic
texts over that among others. The buckets whose ratios stand out most are features; logistic regression
on the ratios of those that a text has gives weights and intercept. Only text enters a score.

``labelled_rows`` bounds the labelled texts that the model is fitted on (picked by a hash of doc_id); all
other work is over all rows. The fitted model is at most ``features`` buckets and weights.

Cases: a null or empty text has no n-gram and is scored by the intercept; texts of any length are read
whole; label rows without class or doc_id are left out; without labels of both classes every score is the
smoothed share of toxic labels; of features that stand out equally the one of least bucket is taken; repeated rows each get
a row; other columns never enter; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewake.llm.quality import labelled_sample
from tidewake.llm.shared import small_batches, written
from tidewake.llm.words import MIX_1, mixed

SIZES = (3, 4, 5, 6, 7)
BUCKET_BITS = 20
THRESHOLD = 0.3
#: Code points that are hashed at once; a longer text is a round of its own.
ROUND = 1 << 19


@dataclass(frozen=True)
class Model:
    buckets: tuple[int, ...]
    weights: tuple[float, ...]  # ratio times coefficient
    intercept: float


def held_out() -> Column:
    """The fold that is never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def _grams(texts: list[str], wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct (text, bucket) pairs among wanted buckets, for parts of the texts."""
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) < ROUND):
            size += len(texts[b])
            b += 1
        part = [t.lower() for t in texts[a:b]]
        points = np.frombuffer("\0".join(part).encode("utf-32-le"), np.uint32).astype(np.uint64)
        ends = np.cumsum([len(t) + 1 for t in part]) - 1
        starts = np.append(0, ends[:-1] + 1)
        pairs, rolled = [], points * MIX_1
        for n in range(2, SIZES[-1] + 1):
            rolled = (rolled[:-1] ^ (rolled[:-1] >> np.uint64(29))) * MIX_1 + points[n - 1 :]
            if n in SIZES:
                bucket = (mixed(rolled) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
                at = np.flatnonzero(wanted[bucket])
                owner = np.searchsorted(ends, at, "right")
                own = np.minimum(owner, len(ends) - 1)
                inside = (at >= starts[own]) & (at + n <= ends[own])  # a separator is in no n-gram
                pairs.append(owner[inside] << BUCKET_BITS | bucket[at[inside]])
        pair = np.unique(np.concatenate(pairs))
        yield a + (pair >> BUCKET_BITS), pair & ((1 << BUCKET_BITS) - 1)
        a = b


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each class by bucket, summed over the task."""
    every = np.ones(1 << BUCKET_BITS, bool)
    total = np.zeros((2, 1 << BUCKET_BITS), np.int64)
    for batch in batches:
        kind = batch.column("_label").to_numpy()
        for owner, bucket in _grams(_texts(batch), every):
            for k in (0, 1):
                total[k] += np.bincount(bucket[kind[owner] == k], minlength=1 << BUCKET_BITS)
    used = np.flatnonzero(total.sum(0))
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[1][used]), pa.array(total[0][used])], ["bucket", "toxic", "other"])


def fit(docs: DataFrame, labels: DataFrame, labelled_rows: int = 12_000, features: int = 2_000, least: int = 5) -> Model:
    spark = docs.sparkSession
    small_batches(spark)
    picked = labelled_sample(labels.where(~held_out()), "toxic", labelled_rows)
    docs = docs.select("doc_id", "text")
    known = docs.join(F.broadcast(picked), docs["doc_id"] == picked["_id"]).select(docs["text"], F.when(F.col("_label") > 0, 1).otherwise(0).alias("_label"))
    known = written(known, "toxic-labelled")
    sizes = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    prior = float(np.log((toxic + 1) / (other + 1)))
    if not toxic or not other:
        return Model((), (), prior)
    counts = known.mapInArrow(_counts, "bucket long, toxic long, other long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    ratio = F.log((F.col("toxic") + 1) / F.lit(toxic + 2.0)) - F.log((F.col("other") + 1) / F.lit(other + 2.0))
    error = F.sqrt(1 / (F.col("toxic") + 1) + 1 / (F.col("other") + 1))
    best = counts.where(F.col("toxic") + F.col("other") >= least).select("bucket", ratio.alias("ratio"), F.abs(ratio / error).alias("z"))
    rows = best.orderBy(F.desc("z"), "bucket").limit(features).collect()
    if not rows:
        return Model((), (), prior)
    order = np.argsort([r["bucket"] for r in rows])
    buckets = tuple(int(rows[k]["bucket"]) for k in order)
    ratios = np.array([rows[k]["ratio"] for k in order])
    wide = len(buckets)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, names = _wanted(buckets), np.array(buckets)
        for batch in batches:
            texts = _texts(batch)
            lists: list[list[int]] = [[] for _ in texts]
            for owner, bucket in _grams(texts, wanted):
                for d, k in zip(owner.tolist(), np.searchsorted(names, bucket).tolist(), strict=True):
                    lists[d].append(k)
            # A sparse vector as Spark ML stores it: kind 0, size, places and values.
            n = len(texts)
            parts = [
                pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, wide, np.int32)), pa.array([sorted(own) for own in lists], pa.list_(pa.int32())),
                pa.array([ratios[sorted(own)].tolist() for own in lists], pa.list_(pa.float64())),
            ]
            features_ = pa.StructArray.from_arrays(parts, ["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([batch.column("_label").cast(pa.float64()), features_], ["label", "features"])

    plain = StructType([StructField("label", DoubleType()), StructField("features", VectorUDT.sqlType())])
    vectors = StructType([StructField("label", DoubleType()), StructField("features", VectorUDT())])
    rows = written(known.mapInArrow(present, plain), "toxic-features", vectors)
    fitted = LogisticRegression(maxIter=60, regParam=3e-4, standardization=False).fit(rows)
    return Model(buckets, tuple((fitted.coefficients.toArray() * ratios).tolist()), float(fitted.intercept))


@functools.lru_cache(maxsize=4)
def _wanted(buckets: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(1 << BUCKET_BITS, bool)
    out[list(buckets)] = True
    return out


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text."""
    small_batches(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, names, weights = _wanted(model.buckets), np.array(model.buckets, np.int64), np.array(model.weights)
        for batch in batches:
            texts = _texts(batch)
            total = np.full(len(texts), model.intercept)
            for owner, bucket in _grams(texts, wanted):
                if len(owner):
                    total += np.bincount(owner, weights[np.searchsorted(names, bucket)], minlength=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(total, -500, 500))))], ["doc_id", "score"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
