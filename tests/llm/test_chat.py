import hashlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tests.llm.helpers import sha
from tidewake.llm import chat
from tidewake.llm.bpe import library_encoder
from tidewake.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string"
SAID = "\\### Assistant: </turn> ok"


@given(st.text(alphabet="\\#</turn>: \nab", max_size=40))
def test_escaping_is_reversible_and_leaves_no_mark(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    bare = chat._ESCAPED.sub("x", escaped)
    assert "###" not in bare and "</turn>" not in bare and ":\n" not in bare


@given(st.lists(st.tuples(st.text(alphabet="\\#</turn>: \nab", max_size=20), st.text(alphabet="\\#</turn>: \nab", max_size=40)), max_size=5))
def test_the_rendering_can_be_read(turns):
    shown = "".join(f"{chat.BEGIN}{chat.escape(r)}{chat.MIDDLE}{chat.escape(t)}{chat.CLOSE}" for r, t in turns)
    assert chat.parse(shown) == turns


def expected(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(loss), sha(loss))
    return out


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", SAID), (-7, 1, "assistant", SAID)]
    got = {r.conv_id: tuple(r)[1:5] for r in QUERIES["op10_chat_formatting"](spark, sf).collect()}
    assert got == expected(rows)


def test_odd_rows(spark, monkeypatch):
    rows = [
        (1, 0, "user", None), (1, None, None, "first"), (1, 0, "user", None), (1, 2, "assistant", ""), (1, 3, "assistant", "x" * 200_000),
        (1, 4, "assistant", "### a:\n</turn>\n"), (2, 0, "assistant", "only"), (None, 0, "assistant", "nobody"), (3, 1, "a:\n### b", "t"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("ids", "mask", "piece", "formatted"):
        df = df.withColumn(name, df.turn)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(chat.formatted(df, PATH), PATH).collect()}
    assert got == expected(rows)
    assert chat.read_back(chat.formatted(spark.createDataFrame([], SCHEMA), PATH), PATH).count() == 0


def test_masks_cover_assistant_tokens_alone(spark):
    df = spark.createDataFrame([(1, 0, "user", "hello"), (1, 1, "assistant", "well met")], SCHEMA)
    row = chat.formatted(df, PATH).collect()[0]
    ids, mask = np.frombuffer(row.ids, "<u4"), np.frombuffer(row.mask, np.int8).astype(bool)
    encoder = library_encoder(PATH)
    assert encoder.text(ids[mask]) == "well met" and len(ids) == len(mask)
    assert row.formatted == "### user:\nhello\n</turn>\n### assistant:\nwell met\n</turn>\n"


def test_a_long_conversation_comes_in_pieces(spark):
    rows = [(5, k, "assistant" if k % 2 else "user", f"turn {k} " + "word " * 60) for k in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    pieces = chat.formatted(df, PATH)
    assert pieces.count() > 1
    assert {r.conv_id: tuple(r)[1:5] for r in chat.read_back(pieces, PATH).collect()} == expected(rows)
