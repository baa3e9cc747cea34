import random

from tests.llm.helpers import clashing, docs, words
from tidewake.llm import jaccard
from tidewake.llm.queries import QUERIES


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def expected(rows, k=3, num=90, den=100):
    """Every pair, by the definition."""
    sets = []
    for _, t in rows:
        w = words(lowered(t))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    ids = [(i is None, i) for i, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    held = {}
    for a, s in enumerate(sets):
        for g in s:
            held.setdefault(g, []).append(a)
    pairs = {}
    for own in held.values():
        for x in range(len(own)):
            for y in range(x):
                pairs[own[y], own[x]] = pairs.get((own[y], own[x]), 0) + 1
    for (a, b), n in pairs.items():
        if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
            root[find(a)] = find(b)
    least = {}
    for a, i in enumerate(ids):
        least[find(a)] = min(least.get(find(a), i), i, key=lambda x: (x[0], x[1] or 0))
    return ordered((i[1], len(s), least[find(a)][1]) for a, (i, s) in enumerate(zip(ids, sets, strict=True)))


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x or 0) for x in r))


def found(df, **more):
    return ordered(jaccard.linked(df, **more).collect())


def near_copies(rng, n, longest, vocabulary):
    rows, texts = [], []
    for i in rng.sample(range(10 * n), n):
        if texts and rng.random() < 0.6:
            w = list(rng.choice(texts))
            for _ in range(rng.randint(0, 1 + len(w) // 40)):
                at = rng.randint(0, len(w))
                w[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 1)
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.randint(0, longest))]
        texts.append(w)
        rows.append((i, " ".join(x.upper() if rng.random() < 0.1 else x for x in w)))
    return rows


def test_equals_all_pairs(spark):
    for seed, longest, size, more in (
        (1, 30, 30, {}), (2, 300, 2000, {}), (3, 200, 2000, {"words": 5, "num": 80, "den": 100}), (4, 12, 5, {"words": 2, "num": 70, "den": 100}),
    ):
        rows = near_copies(random.Random(seed), 150, longest, [f"w{k}" for k in range(size)])
        want = expected(rows, more.get("words", 3), more.get("num", 90), more.get("den", 100))
        assert found(docs(spark, rows), **more) == want
        assert len({r[2] for r in want}) < len(rows)


def test_columns_of_many_rows_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 2)
    for seed, more in ((11, {}), (12, {"words": 5, "num": 80, "den": 100})):
        rows = near_copies(random.Random(seed), 150, 120, [f"w{k}" for k in range(300)])
        assert found(docs(spark, rows), **more) == expected(rows, more.get("words", 3), more.get("num", 90), more.get("den", 100))


def test_rows_left_over_are_ordered_anew_without_loss(spark, monkeypatch):
    """The first order tells nothing of a column's rarity, as on large inputs: of the rows left over most find their links by an
    order of their own, and few go to bands."""
    given = []
    monkeypatch.setattr(jaccard, "HOT", 3)
    ranks = jaccard._cell_ranks
    monkeypatch.setattr(jaccard, "_cell_ranks", lambda sets: ranks(sets) if given[-1][0] == "jaccard-left-over" else bytes(4 << jaccard.CELL_BITS))
    monkeypatch.setattr(jaccard, "written", lambda df, name, *a, f=jaccard.written: given.append((name, f(df, name, *a))) or given[-1][1])
    monkeypatch.setattr(jaccard, "drop", lambda *tables: None)
    for seed, more in ((21, {}), (22, {"words": 5, "num": 80, "den": 100})):
        rows = near_copies(random.Random(seed), 200, 120, [f"w{k}" for k in range(3000)])
        rows = [(i, t + " p q r s t u v" if k % 10 == 0 else t) for k, (i, t) in enumerate(rows)]
        sizes = {}
        for again in (10**9, 0):
            monkeypatch.setattr(jaccard, "AGAIN", again)
            given.clear()
            assert found(docs(spark, rows), **more) == expected(rows, more.get("words", 3), more.get("num", 90), more.get("den", 100))
            sizes[again] = [df.count() for name, df in given if name == "jaccard-left-over"]
        assert len(sizes[0]) > 1 and sizes[0][0] == sizes[10**9][0] > sizes[0][-1]


def test_leading_columns_are_shared_by_all_that_link():
    import numpy as np

    for num in (90, 80, 67):
        t = jaccard.Threshold(3, num, 100, True)
        n = np.arange(1, 3000)
        assert (t.lead(n) == n - np.ceil(n * num / 100 - 1e-9) + 1).all() and (t.lead(n) >= 1).all()


def test_tiles_lose_no_link(spark):
    rows = near_copies(random.Random(9), 120, 60, [f"w{k}" for k in range(500)])
    assert found(docs(spark, rows), tile=3) == expected(rows)
    # A chain of copies of copies, whose ends don't link, and a crowd around one text, over many tiles.
    w, chain = [f"c{k}" for k in range(120)], []
    for k in range(60):
        w = [*w[:k], f"n{k}", *w[k + 1 :]]
        chain.append((1000 - k, " ".join(w)))
    crowd = [(2000 + k, " ".join([f"d{j}" if j != k else f"e{k}" for j in range(200)])) for k in range(60)]
    for tile in (2, 7):
        assert found(docs(spark, chain + crowd), tile=tile) == expected(chain + crowd)


def test_odd_rows(spark):
    long = " ".join(f"x{k}" for k in range(30_000))
    rows = [(5, None), (4, ""), (3, "  "), (9, "One"), (8, "one"), (7, "a b"), (7, "a b"), (None, "A B"), (2, long), (1, long + " more"), (6, "É b c"), (0, "é b c")]
    assert found(clashing(docs(spark, rows))) == expected(rows)
    assert found(docs(spark, [])) == []


def test_rows_of_one_id_with_other_texts(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(200)) for c in "ab")
    rows = [(1, a), (1, b), (1, b), (5, a + " x"), (6, b + " y"), (2, b + " z")]
    assert found(docs(spark, rows)) == expected(rows)


def test_bands_leave_out_no_close_pair():
    import numpy as np

    rng = np.random.default_rng(4)
    for num in (90, 80):
        t = jaccard.Threshold(3, num, 100, True)
        for n in range(2, 120):
            a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
            most = t.differing(t.size_class(n))
            b = np.unique(np.concatenate([a[: len(a) - most // 2], rng.integers(0, 1 << 62, most - most // 2).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= num * (len(a) + len(b) - both) and len(a) != both:
                place, bands = jaccard._band_hashes([a, b], t)
                assert np.intersect1d(bands[place == 0], bands[place == 1]).size


def test_query_equals_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert ordered(QUERIES["op6_ngram_jaccard"](spark, sf).collect()) == expected(rows)


def test_classes_of_paths_stars_and_single_edges(spark):
    rng = random.Random(6)
    names = rng.sample(range(10_000), 400)
    edges = [(names[k], names[k + 1]) for k in range(150)] + [(names[200], names[k]) for k in range(201, 300)] + [(names[300], names[301]), (names[301], names[300])]
    for a in range(0, 60, 3):
        edges.append((names[310 + a], names[311 + a]))
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = jaccard.propagated(spark.createDataFrame(edges, "a long, b long"), "test").collect()
    assert sorted(map(tuple, got)) == sorted((n, find(n)) for n in root)


def test_a_null_text_under_an_id_that_is_in_a_block(spark):
    a = " ".join(f"a{k}" for k in range(200))
    rows = [(None, a), (None, None), (1, a + " x"), (2, a + " y"), (2, None)]
    assert found(docs(spark, rows)) == expected(rows)


def test_names_of_columns_never_clash(spark):
    from pyspark.sql import functions as F

    a = " ".join(f"a{k}" for k in range(200))
    df = clashing(docs(spark, [(1, a), (2, a + " x"), (3, None)]))
    for name in ("row", "row_id", "row_th", "words", "th", "own_id", "own_th", "_key", "a.b", "a b", "first"):
        df = df.withColumn(name, F.lit(99))
    got = jaccard.heads(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [1, 3]
    assert all(r["_key"] == 99 and r["a.b"] == 99 and r["row"] == 99 for r in got.collect())


def test_many_null_ids_and_repeated_rows(spark):
    a = " ".join(f"a{k}" for k in range(200))
    rows = [(None, f"b{k} c d e") for k in range(300)] + [(None, a)] * 50 + [(None, a + " x")] * 50
    assert found(docs(spark, rows)) == expected(rows)


def test_exactly_one_row_of_each_class_stays(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(200)) for x in "abc")
    rows = [(None, a), (None, a + " x"), (None, a), (None, b), (None, None), (None, ""), (3, c), (3, c), (3, c + " z"), (3, None), (4, c + " y"), (5, b)]
    got = [(r.doc_id, r.text) for r in jaccard.heads(docs(spark, rows)).collect()]
    assert sum((t or "").startswith("a") for _, t in got) == 1 and [i for i, t in got if (t or "").startswith("a")] == [None]
    assert [i for i, t in got if (t or "").startswith("b")] == [5] and [i for i, t in got if (t or "").startswith("c")] == [3]
    assert sorted((str(i), t or "") for i, t in got if not t) == [("3", ""), ("None", ""), ("None", "")] and len(got) == 6
