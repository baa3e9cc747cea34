import random

import duckdb

from tests.llm.helpers import SPACES, clashing, docs, sha, words
from tidewake.llm import lines
from tidewake.llm.queries import QUERIES, SQL


def expected(rows, run, least=50):
    """A run counts from ``run`` lines on, or with fewer lines from ``least`` words on."""

    def runs(own):
        for size in range(1, run + 1):
            for k in range(len(own) - size + 1):
                x = tuple(own[k : k + size])
                if size == run or sum(len(words(y)) for y in x) >= least:
                    yield k, x

    first, texts = {}, []
    for i, t in rows:
        i = lines_key(i)
        own = [x for x in (t or "").split("\n") if SPACES.sub("", x)]
        texts.append((i, own))
        for k, x in runs(own):
            first[x] = min(first.get(x, (i, k)), (i, k))
    out = []
    for (i, own), (real, t) in zip(texts, rows, strict=True):
        gone = {j for k, x in runs(own) if first[x] < (i, k) for j in range(k, k + len(x))}
        kept, n = [], 0
        for x in (t or "").split("\n"):
            solid = bool(SPACES.sub("", x))
            if not (solid and n in gone):
                kept.append(x)
            n += solid
        out.append((real, len(own), len(gone), "\n".join(kept)))
    return sorted(out, key=str)


def lines_key(i):
    return (1 << 63) - 1 if i is None else i


def found(df, **more):
    return sorted(((r.row.doc_id, r.n_lines, r.n_removed, r.kept) for r in lines.deduplicated(df, **more).collect()), key=str)


def test_equals_brute_force(spark):
    for seed, noise, guarantee, letters in ((1, 2, 3, "abcdefgh"), (2, 1, 3, "abc"), (3, 3, 6, "ab"), (4, 2, 2, "abcd")):
        rng = random.Random(seed)
        rows = [(i, "\n".join(rng.choice([*letters, "", " "]) for _ in range(rng.randint(0, 14)))) for i in rng.sample(range(500), 60)]
        assert found(docs(spark, rows), noise=noise, guarantee=guarantee) == expected(rows, guarantee)


def test_few_lines_of_many_words_equal_brute_force(spark):
    for seed, guarantee, least in ((5, 3, 4), (6, 2, 3), (7, 4, 5)):
        rng = random.Random(seed)
        line = [" ".join(rng.choice("ab") for _ in range(k % 5)) + rng.choice(["", "\t", " \r"]) for k in range(12)]
        rows = [(i, "\n".join(rng.choice(line) for _ in range(rng.randint(0, 5)))) for i in rng.sample(range(500), 80)]
        got = found(docs(spark, rows), guarantee=guarantee, words=least)
        assert got == expected(rows, guarantee, least) and got != expected(rows, guarantee, 99)


def test_a_line_and_a_pair_of_fifty_words(spark):
    def said(k, x):
        return " ".join(f"{x}{j}" for j in range(k))

    long, short, half, rest = said(50, "l"), said(49, "s"), said(30, "h"), said(20, "r")
    rows = [(1, f"{long}\n{short}\n{half}\n{rest}"), (2, long), (3, short), (4, f"{half}\n \n{rest}\nnew"), (5, f"{half}\nnew\n{rest}"), (None, long), (6, f"{long}\nb")]
    left = {i: kept for i, _, _, kept in found(docs(spark, rows))}
    assert left == {1: rows[0][1], 2: "", 3: short, 4: " \nnew", 5: rows[4][1], None: "", 6: "b"}
    assert found(docs(spark, rows)) == expected(rows, 3)


def test_odd_rows(spark):
    block = "one line\ntwo\nthree"
    rows = [
        (4, None), (5, ""), (6, "\n\n"), (1, block), (2, f"x\n{block}\ny\n\n"), (3, f"{block}\n{block}"), (3, f"{block}\n{block}"), (None, block),
        (9, "\n".join(f"line {k}" for k in range(30_000))), (8, "z\n" + "\n".join(f"line {k}" for k in range(30_000))), (7, "one line\r\ntwo\r\nthree"),
    ]
    assert found(clashing(docs(spark, rows))) == expected(rows, 3)
    assert found(docs(spark, [])) == []


def test_query_equals_its_sql_and_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(map(tuple, QUERIES["op5_line_dedup"](spark, sf).collect()))
    assert got == sorted((i, n, g, sha(k)) for i, n, g, k in expected(rows, 3))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    assert got == sorted(con.sql(SQL["op5_line_dedup"]).fetchall())
