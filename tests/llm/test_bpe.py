import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tests.llm.helpers import clashing, docs, sha
from tidewake.llm import bpe, codec
from tidewake.llm.queries import QUERIES

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
FILE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["'", "s", "t", "re", "ll", "ve", " ", "  ", "\n", "\t", "a", "é", "1", "२", "!", "…", "\u00a0", "\u3000", "中", "😀", "\0", "'S", "d", "m", "\u0301", "\x1c", "\x85", "Ⅷ"]


@pytest.fixture(scope="module")
def library():
    ranks = bpe.rank_encoder(RANKS).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def mixed_texts():
    rng = random.Random(5)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    return [*texts, "", "a" * 5000, "ab" * 900 + "é" * 700, "<|endoftext|>", " " * 3000 + "x", "it's 'sand don't''s\n's"]


def test_ranks_equal_the_library(library):
    texts = mixed_texts()
    got = bpe.rank_encoder(RANKS).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode_ordinary(x) for x in texts]


def test_cached_library_encoder_equals_plain_calls():
    texts = mixed_texts()
    encoder = bpe.LibraryEncoder(FILE)
    got = encoder.encode(texts)
    want = encoder.model.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [x.ids for x in want]


def test_a_full_cache_changes_nothing():
    encoder = bpe.LibraryEncoder(FILE)
    encoder.most = 3
    texts = mixed_texts()[:200]
    assert encoder.encode(texts) == bpe.LibraryEncoder(FILE).encode(texts)


def test_every_code_point_is_cut_as_the_pattern_cuts_it(library):
    texts = [f"a{chr(c)}1{chr(c)} b" for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    got = bpe.rank_encoder(RANKS).encode(texts)
    assert all(np.frombuffer(x, "<u4").tolist() == library.encode_ordinary(t) for x, t in zip(got, texts, strict=True))
    fresh = Tokenizer.from_file(FILE)
    got = bpe.LibraryEncoder(FILE).encode_added(texts)
    assert all(np.frombuffer(x, "<u4").tolist() == y.ids for x, y in zip(got, fresh.encode_batch(texts, add_special_tokens=False), strict=True))


def test_slices_that_collide_are_told_apart(monkeypatch):
    texts = mixed_texts()[:400] + [f" word{k} longerword{k % 90} averyverylongwordindeed{k % 70}" for k in range(300)]
    want = bpe.LibraryEncoder(FILE).encode(texts)
    whole = bpe._keys

    def narrow(*args):
        key, check = whole(*args)
        return key % np.uint64(997), key ^ check

    monkeypatch.setattr(bpe, "_keys", narrow)
    assert bpe.LibraryEncoder(FILE).encode(texts) == want


def test_keys_of_slices_agree_only_where_they_do():
    pieces = [b"a" * k + c for k in range(40) for c in (b"", b"b", b"\0", b"bc")]
    data = b"".join(pieces)
    after = np.cumsum([len(p) for p in pieces])
    first = after - [len(p) for p in pieces]
    keys = list(zip(*(x.tolist() for x in bpe._keys(data, first, after)), strict=True))
    assert all((keys[i] == keys[j]) == (pieces[i] == pieces[j]) for i in range(len(pieces)) for j in range(i))


def test_decode_inverts_encode_with_offsets(spark):
    rows = [(1, "it's 12 中文\n\n x"), (2, None), (3, ""), (3, ""), (4, "word " * 40_000)]
    out = codec.decode(codec.encode(clashing(docs(spark, rows)), RANKS), RANKS, offsets=True).collect()
    assert sorted((r.doc_id, bytes(r.decoded)) for r in out) == sorted((i, (t or "").encode()) for i, t in rows)
    for r in out:
        assert len(r.offsets) == len(r.ids) // 4 and list(r.offsets) == sorted(r.offsets)


def test_query_equals_the_library_on_whole_texts(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op8_byte_bpe"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode_ordinary(r.text)
        assert tuple(got[r.doc_id]) == (r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(r.text))


def test_odd_rows_have_digests(spark):
    rows = [(None, "a null id"), (None, None), (1, ""), (2, "é" * 70_000), (2, "é" * 70_000), (2**63 - 1, "x")]
    out = codec.digests(codec.encode(clashing(docs(spark, rows)), RANKS), RANKS).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.decoded_sha256) for r in out) == sorted(((i is None, i or 0), sha(t or "")) for i, t in rows)
    assert codec.digests(codec.encode(docs(spark, []), RANKS), RANKS).count() == 0


def test_an_empty_table(spark):
    assert codec.decode(codec.encode(docs(spark, []), RANKS), RANKS).count() == 0
