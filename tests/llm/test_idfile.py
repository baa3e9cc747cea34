import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import clashing, crc, docs
from tidewake.llm import idfile
from tidewake.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(rows, end_id=2):
    start, out = 0, []
    model = Tokenizer.from_file(PATH)
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, end_id], "<u4")
        out.append((i, start, len(ids), crc(ids.tobytes())))
        start += len(ids)
    return sorted(out, key=str)


@pytest.mark.parametrize("alphabet", [1, 2, 3, 50, 40_000])
def test_grammars_give_back_every_document_and_range(alphabet, monkeypatch):
    monkeypatch.setattr(idfile, "LEAST", 2)
    rng = np.random.default_rng(alphabet)
    ids = [rng.integers(0, alphabet, rng.integers(1, 300)).astype("<u4") for _ in range(40)]
    block = idfile.Shard(idfile.shard(list(range(40)), [x.tobytes() for x in ids], 50_000))
    assert [block.ids(d).tolist() for d in range(40)] == [x.tolist() for x in ids]
    whole = np.concatenate(ids)
    assert block.starts().tolist() == np.append(0, np.cumsum([len(x) for x in ids])).tolist()
    for _ in range(200):
        a, b = sorted(rng.integers(0, len(whole), 2).tolist())
        assert block.range(a, b + 1).tolist() == whole[a : b + 1].tolist()
    if alphabet < 50:
        assert len(block.symbols) < len(whole) / 2


def test_copies_become_one_symbol_each():
    ids = [np.random.default_rng(5).integers(0, 40_000, 400).astype("<u4")] * 64
    block = idfile.Shard(idfile.shard(list(range(64)), [x.tobytes() for x in ids], 50_000))
    assert len(block.symbols) == 64 and block.lengths.max() == 400
    assert all(block.ids(d).tolist() == ids[0].tolist() for d in range(64))


def test_what_is_no_shard_is_refused():
    with pytest.raises(ValueError):
        idfile.Shard(b"something else" * 9)


def test_query_equals_the_library(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op4_token_ids"](spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_odd_rows(spark, monkeypatch):
    rows = [(4, None), (2, ""), (9, "word " * 300_000), (9, "tie"), (9, "tie"), (None, "last"), (None, None), (-1, "first"), ((1 << 63) - 1, "greatest")]
    got = idfile.read(idfile.write(clashing(docs(spark, rows)), PATH, 2)).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)
    assert idfile.read(idfile.write(docs(spark, []), PATH, 2)).count() == 0


def test_added_tokens_get_the_ids_of_a_fresh_library_model(spark):
    fresh = Tokenizer.from_file(PATH)
    mark = "<|endoftext|>"
    rows = [(1, f"a {mark} b"), (2, mark), (3, f"{mark}{mark} it's\n {mark}x"), (4, "plain text"), (5, "<|endoftext|"), (6, f"<|endof{mark}text|>")]
    want, start = [], 0
    for i, t in rows:
        ids = np.array([*fresh.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), crc(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, idfile.read(idfile.write(docs(spark, rows), PATH, 2)).collect())) == want


def test_shards_of_texts_are_smaller_than_their_ids(spark):
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    shards = idfile.write(texts, PATH, 2).collect()
    ids = sum(r.n_tokens for r in shards)
    # Plain ids of this vocabulary take two bytes each.
    assert sum(len(r.data) for r in shards) < 0.85 * 2 * ids
    for r in shards:
        block = idfile.Shard(bytes(r.data))
        assert (block.lengths[block.size :] == [len(block.expanded(np.array([block.size + k], np.uint32))) for k in range(len(block.rules))]).all()
