import hashlib
import random
import re

import pyarrow as pa
import pytest
import zstandard

from tests.llm.helpers import clashing, docs, sha
from tests.oracle import compare, connection
from tidewake.llm import fim
from tidewake.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def expected(doc_id, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text or "")
    n, text = len(units), text or ""
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text), text
    parts = ["".join(x) for x in (units[:a], units[a:b], units[b:])]
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}" if form == "psm" else f"<S>{parts[2]}<P>{parts[0]}<M>{parts[1]}"
    return doc_id, n, form, len(parts[0]), len(parts[1]), sha(out), sha(text), out


def rows_of(n=150):
    rng = random.Random(5)
    alphabet = ["a", "B", "z", " ", "\n", "é", "ß", "漢", "😀", "<", ">", "P", "S", "M", "\0", "1"]
    rows = [(i, "".join(rng.choices(alphabet, k=rng.choice([0, 1, 2, 5, 40, 300])))) for i in range(n)]
    return [*rows, (None, None), (None, "null id"), (500, None), (501, ""), (502, "x" * 5000), (503, "漢" * 999), (504, "a<P>b"), (505, "<P" + "S>" * 3), (505, "<P" + "S>" * 3)]


@pytest.mark.parametrize("frame", [4, 7, 64, 1 << 16])
def test_outputs_equal_brute_force(spark, monkeypatch, frame):
    monkeypatch.setattr(fim, "FRAME", frame)
    rows = [(i, t and t[:400]) for i, t in rows_of(60 if frame < 64 else 150)]
    # The plain functions, in this process, where the frame size holds.
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([(t or "").encode() for _, t in rows], pa.binary())], ["doc_id", "text"])
    stored = list(fim._stored(iter([batch])))
    assert all(len(zstandard.ZstdDecompressor().decompress(f["data"])) <= frame for r in stored[0].column("frames").to_pylist() for f in r)
    cut = list(fim._cut(iter(stored)))
    got = [tuple(r.values()) for r in pa.Table.from_batches(fim._digests(iter(cut))).to_pylist()]
    assert got == [expected(*r)[:7] for r in rows]
    shown = pa.Table.from_batches(fim._texts(x.select(["doc_id", "form", "output"]) for x in cut)).column("text").to_pylist()
    assert shown == [expected(*r)[7] for r in rows]


def test_rows_through_spark(spark):
    rows = [*rows_of(), (900, "word " * 300_000), (901, "a" * 1_000_000)]
    cut = fim.transformed(fim.stored(clashing(docs(spark, rows))))
    assert sorted(map(tuple, fim.digests(cut).collect()), key=str) == sorted((expected(*r)[:7] for r in rows), key=str)
    assert {r.text for r in fim.texts(cut).collect()} == {expected(*r)[7] for r in rows}
    assert fim.digests(fim.transformed(fim.stored(docs(spark, [])))).count() == 0


def test_only_cut_frames_are_compressed_anew(spark):
    text = "".join(f"w{k} " for k in range(200_000))
    store = fim.stored(docs(spark, [(i, text) for i in range(12)]))
    whole = {bytes(f.data) for r in store.select("frames").collect() for f in r.frames}
    for r in fim.transformed(store).where("form <> 'plain'").collect():
        fresh = [f for f in r.output if bytes(f) not in whole]
        assert len(fresh) <= 3 + 4  # the marks, and both halves of two cut frames


def test_a_mark_is_found_across_frames():
    squeeze = zstandard.ZstdCompressor()
    frames = fim.Frames([squeeze.compress(x) for x in (b"ab<", b"M", b">cd")])
    assert frames.find(b"<M>", 0) == 2 and b"".join(frames.span(1, 7)) == b"b<M>cd"
    with pytest.raises(ValueError):
        frames.find(b"<S>", 0)


def test_query_equals_its_sql(spark):
    assert compare(spark, connection(SF), QUERIES["op13_fill_in_middle"], SQL["op13_fill_in_middle"], SF) is None
