import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.helpers import clashing, docs
from tests.oracle import compare, connection
from tidewake.llm import spelling
from tidewake.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def counted(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    """By the definition: one code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def neighbours(words):
    """Near words by wildcards: those that share one with a place left out, checked by the definition."""
    groups = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            groups[w[:k] + w[k + 1 :]].add(w)
        groups[w].add(w)
    found = defaultdict(set)
    for members in groups.values():
        for a in members:
            found[a] |= {b for b in members if a != b and one_edit(a, b)}
    return found


def expected(rows):
    n = counted(rows)
    close = neighbours(n)
    form = {}
    for w in n:
        best = min(close[w], key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 5 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(close[w]), n[form[w]] if w in form else None))
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def family(rng, size, length, alphabet="abé"):
    """Words that lie close together, with uneven counts."""
    stem = "".join(rng.choices(alphabet, k=length))
    words = {stem}
    while len(words) < size:
        w = list(rng.choice(sorted(words)))
        k = rng.randrange(len(w))
        act = rng.randrange(3)
        w[k : k + (act > 0)] = rng.choice(alphabet) * (act < 2)
        words.add("".join(w))
    return sorted(words)


@pytest.mark.parametrize("most", [2, 7, 2048])
def test_groups_of_any_size_give_all_pairs(spark, most):
    rng = random.Random(most)
    texts = []
    for length in (6, 7, 9, 14):
        for w in family(rng, 90, length):
            texts += [w] * rng.choice([5, 5, 6, 30, 200])
    rng.shuffle(texts)
    rows = [(i, " ".join(texts[i::20])) for i in range(20)]
    assert got(spelling.grouped(docs(spark, rows), most=most)) == expected(rows)


def test_a_group_goes_on_over_blocks_and_batches(spark, monkeypatch):
    rng = random.Random(1)
    words = sorted({"prefix" + "".join(rng.choices("abcdefghij", k=4)) for _ in range(900)})
    rows = [(w, 1) for w in words]
    monkeypatch.setattr(spelling, "BLOCK", 50)
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = spelling.pairs(spark.createDataFrame(rows, "word string, n long"), most=100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    pairs = [(r.word, r.near) for r in found.collect()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    want = {(a, b) for a, close in neighbours(words).items() for b in close}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_blocks_cover_each_group():
    rng = np.random.default_rng(0)
    key = np.repeat(np.arange(40), rng.integers(1, 1000, 40))
    seen = set()
    for x, y in spelling._block_pairs(key, np.full(len(key), 8)):
        seen.add((x.start, x.stop, y.start, y.stop))
        assert x == y or len(set(key[x]) | set(key[y])) == 1
    for k in range(40):  # first and last row of a group meet in some pair of blocks
        a, b = np.flatnonzero(key == k)[[0, -1]]
        assert any(x <= a < p and y <= b < q for x, p, y, q in seen)


@pytest.mark.parametrize("seed", range(4))
def test_nearness_is_one_edit(seed):
    words = family(random.Random(seed), 120, 6) + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "漢字漢字漢字", "漢字漢字漢"]
    close, _ = spelling.near(spelling.matrices(words), spelling.matrices(words))
    assert [[bool(x) for x in row] for row in close] == [[one_edit(a, b) for b in words] for a in words]


def test_odd_rows(spark):
    rows = [
        (None, "straße Straße STRASSE strasse " * 9), (None, None), (1, ""), (1, "ÉCOLES écoles École " * 40), (1, "ÉCOLES écoles École " * 40),
        (2, "x" * 300_000 + " " + "x" * 299_999), (3, ("x" * 300_000 + " ") * 5 + ("x" * 299_999 + ".") * 30), (4, "tie-tie letter lettex letterx " * 50),
        (5, "colour color colours " * 7 + "colour " * 400),
    ]
    assert got(spelling.grouped(clashing(docs(spark, rows)))) == expected(rows)
    assert got(spelling.grouped(docs(spark, []))) == []


def test_roots_follow_long_chains(spark):
    links = [(f"w{k:02}", f"w{k + 1:02}") for k in range(21)] + [("a", "b"), ("c", "b")]
    found = {r.word: r.root for r in spelling.roots(spark.createDataFrame(links, "word string, form string")).collect()}
    assert found == {**{f"w{k:02}": "w21" for k in range(21)}, "a": "b", "c": "b"}


def test_query_equals_its_sql(spark):
    assert compare(spark, connection(SF), QUERIES["op12_spelling_variants"], SQL["op12_spelling_variants"], SF) is None


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = expected(rows)
    assert got(QUERIES["op12_spelling_variants"](spark, SF)) == want and len(want) > 50
