import math
import zlib

import numpy as np
import pytest

from tests.llm.helpers import clashing, docs, labels
from tidewake.llm import toxicity
from tidewake.llm.queries import QUERIES
from tidewake.llm.words import MIX_1, MIX_2


def test_query_finds_held_out_toxic_texts(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in QUERIES["op2_toxicity"](spark, sf).collect()}
    assert len(got) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    known = [(r.toxic, got[r.doc_id].predicted) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    caught = sum(t and p for t, p in known)
    assert caught >= 0.85 * sum(t for t, _ in known)
    assert caught >= 0.9 * sum(p for _, p in known)


def few(spark):
    texts = [(i, f"plain calm words {i} " + ("you utter nitwit" if i % 3 == 0 else "good day to all")) for i in range(120)]
    return docs(spark, texts), labels(spark, [(i, 1, int(i % 3 == 0)) for i in range(120)])


def test_odd_rows(spark):
    train, known = few(spark)
    model = toxicity.fit(clashing(train), clashing(known.union(labels(spark, [(None, 1, 1), (5, 1, None), (99_999, 0, 1)]))))
    rows = [(1, None), (2, ""), (3, "you utter nitwit"), (3, "you utter nitwit"), (None, "good day"), (6, "good day " * 150_000 + "nitwit")]
    out = toxicity.scored(clashing(docs(spark, rows)), model).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert by[1].score == by[2].score and by[3].predicted == 1 and by[6].score > by[None].score and not by[None].held_out
    assert toxicity.scored(docs(spark, []), model).count() == 0


def test_labels_of_one_class_or_none(spark):
    train, known = few(spark)
    for some in (known.where("toxic = 0"), known.limit(0)):
        model = toxicity.fit(train, some)
        assert not model.buckets
        (score,) = {r.score for r in toxicity.scored(train, model).collect()}
        assert score == pytest.approx(1 / (1 + math.exp(-model.intercept)))


def test_held_out_labels_change_nothing(spark):
    train, known = few(spark)
    flipped = known.selectExpr("doc_id", "quality", "IF(pmod(crc32(string(doc_id)), 4) = 2, 1 - toxic, toxic) AS toxic")
    assert toxicity.fit(train, known) == toxicity.fit(train, flipped)


def test_equal_texts_have_equal_grams_at_any_place():
    every = np.ones(1 << toxicity.BUCKET_BITS, bool)
    texts = ["same text", "same text", "", "ab", "same text"]
    got = [set() for _ in texts]
    for owner, bucket in toxicity._grams(texts, every):
        for d, k in zip(owner.tolist(), bucket.tolist(), strict=True):
            got[d].add(k)
    assert got[0] == got[1] == got[4] and got[0] and not got[2] and not got[3]


def plain_buckets(text):
    """The buckets of a text, n-gram by n-gram in plain integers."""
    mask, mix1, mix2, out = (1 << 64) - 1, int(MIX_1), int(MIX_2), set()
    points = [ord(c) for c in text.lower()]
    for n in toxicity.SIZES:
        for at in range(len(points) - n + 1):
            r = points[at] * mix1 & mask
            for p in points[at + 1 : at + n]:
                r = ((r ^ r >> 29) * mix1 + p) & mask
            for shift, mix in ((30, mix1), (27, mix2)):
                r = (r ^ r >> shift) * mix & mask
            out.add((r ^ r >> 31) >> 64 - toxicity.BUCKET_BITS)
    return out


def test_ratios_features_and_scores_equal_a_plain_twin(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"{a}{b}{c}" for a in "bdk" for b in "aeiou" for c in "lmnr"]
    texts = [" ".join(rng.choice(vocabulary, 12)) + (" you utter nitwit" if i % 4 == 0 else "") for i in range(80)]
    train, known = docs(spark, list(enumerate(texts))), labels(spark, [(i, 1, int(i % 4 == 0)) for i in range(80)])
    model = toxicity.fit(train, known, features=60, least=3)
    own = [(plain_buckets(t), i % 4 == 0) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 4 != 2]
    toxic, other = sum(k for _, k in own), sum(not k for _, k in own)
    counts = {}
    for buckets, k in own:
        for b in buckets:
            c = counts.setdefault(b, [0, 0])
            c[0 if k else 1] += 1
    ratio = {b: math.log((p + 1) / (toxic + 2)) - math.log((q + 1) / (other + 2)) for b, (p, q) in counts.items() if p + q >= 3}
    z = {b: abs(r) / math.sqrt(1 / (counts[b][0] + 1) + 1 / (counts[b][1] + 1)) for b, r in ratio.items()}
    best = sorted(z, key=lambda b: (-round(z[b], 12), b))[:60]
    assert list(model.buckets) == sorted(best)
    # The fitted weights are where the penalised likelihood is flat.
    order, coefficient = sorted(best), [w / ratio[b] for b, w in zip(sorted(best), model.weights, strict=True)]
    x = np.array([[ratio[b] * (b in buckets) for b in order] for buckets, _ in own])
    y = np.array([k for _, k in own], float)
    p = 1 / (1 + np.exp(-(x @ coefficient + model.intercept)))
    assert np.abs(x.T @ (p - y) / len(y) + 3e-4 * np.array(coefficient)).max() < 1e-3
    rows = [*enumerate(texts[:20]), (900, "unseen nitwit")]
    got = {r.doc_id: r.score for r in toxicity.scored(docs(spark, rows), model).collect()}
    weights = dict(zip(model.buckets, model.weights, strict=True))
    for i, t in rows:
        total = model.intercept + sum(weights.get(b, 0.0) for b in plain_buckets(t))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-9)
