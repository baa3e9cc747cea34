import itertools
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.helpers import clashing, crc, docs
from tidewake.llm import packing
from tidewake.llm.bpe import library_encoder
from tidewake.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, pieces, window=1024, unique=True):
    """Every id of every document in one piece, sequences gapless and within the window; the share of padding."""
    model = library_encoder(PATH).model
    want = Counter()
    ids = {}
    for i, t in rows:
        own = np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        ids[i] = own
        want[i] += len(own)
    covered = defaultdict(list)
    sequences = defaultdict(list)
    for p in pieces:
        assert p.length > 0 and p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == crc(ids[p.doc_id][p.start : p.start + p.length].tobytes())
        covered[p.doc_id].append((p.start, p.length))
        sequences[p.sequence_id].append((p.offset, p.length))
    assert {i: sum(n for _, n in c) for i, c in covered.items()} == dict(want)
    if unique:
        for c in covered.values():
            at = 0
            for start, n in sorted(c):
                assert start == at
                at += n
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= window
    return 1 - sum(want.values()) / (window * len(sequences)) if sequences else 0


def test_combinations_are_all_sums():
    assert sorted(packing.combinations(9, 3)) == sorted(c for d in (1, 2, 3) for c in itertools.product(range(9, 0, -1), repeat=d) if sum(c) == 9 and list(c) == sorted(c, reverse=True))


def test_least_squares_meets_its_conditions():
    rng = np.random.default_rng(3)
    for shape in ((5, 3), (20, 40), (64, 300)):
        a, b = rng.integers(0, 3, shape).astype(float), rng.integers(0, 50, shape[0]).astype(float)
        x = packing.non_negative_least_squares(a, b)
        pull = a.T @ (b - a @ x)
        assert (x >= 0).all() and pull.max() < 1e-4 and abs(pull[x > 0]).max() < 1e-4


def test_plans_never_use_more_than_there_is():
    rng = np.random.default_rng(8)
    for histogram in ({}, {7: 5}, {256: 3}, {k: int(rng.integers(0, 40)) for k in range(1, 257)}, {200: 9000, 56: 10, 28: 30}):
        p = packing.plan(histogram, 256, 4)
        assert all(p.used[k] <= histogram[k] for k in p.used)
        assert sum((b - a) * k for k, a, b, *_ in p.slots) == 256 * p.sequences


def test_query_packs_every_token_tightly(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert check(rows, QUERIES["op3_packing"](spark, sf).collect()) < 0.01


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "word " * 5000), (4, "word " * 1022), (5, "word " * 1023), (None, "nobody")]
    check(rows, packing.packed(clashing(docs(spark, rows)), PATH).collect())
    assert packing.packed(docs(spark, []), PATH).count() == 0
    same = [(7, "the same text"), (7, "the same text")]
    check(same, packing.packed(docs(spark, same), PATH).collect(), unique=False)


def test_one_length_for_all(spark):
    rows = [(i, "word " * 599) for i in range(300)]
    assert check(rows, packing.packed(docs(spark, rows), PATH).collect()) < 0.01


def test_added_tokens_get_the_ids_of_a_fresh_library_model(spark):
    fresh = Tokenizer.from_file(PATH)
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>"), (3, "plain")]
    got = {p.doc_id: (p.doc_tokens, p.ids_crc32) for p in packing.packed(docs(spark, rows), PATH).collect() if p.length == p.doc_tokens}
    for i, t in rows:
        ids = np.array([*fresh.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert got.get(i, (len(ids), crc(ids.tobytes()))) == (len(ids), crc(ids.tobytes()))
    assert sum(p.length for p in packing.packed(docs(spark, rows), PATH).collect()) == sum(len(fresh.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows)
