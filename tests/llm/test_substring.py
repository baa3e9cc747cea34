import random

from tests.llm.helpers import clashing, docs, sha, words
from tidewake.llm import substring
from tidewake.llm.queries import QUERIES


def expected(rows, window):
    """n_words, n_removed and kept words of each (doc_id, text) row, by the definition."""
    least = {}
    for i, t in rows:
        w, i = words(t), substring.LAST_ID if i is None else i
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            least[x] = min(least.get(x, i), i)
    out = []
    for i, t in rows:
        w, own = words(t), substring.LAST_ID if i is None else i
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < own:
                gone.update(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), " ".join(kept)))
    return sorted(out, key=str)


def found(df, window=substring.WINDOW):
    return sorted(((r.row.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.deduplicated(df, window).collect()), key=str)


def planted(rng, n, window, vocabulary):
    """Texts that share passages of lengths around the window, whole copies, and near copies."""
    say = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passages = [say(rng.choice([window - 1, window, window + 1, 2 * window, 3 * window])) for _ in range(6)]
    rows, texts = [], []
    for i in rng.sample(range(10 * n), n):
        kind = rng.random()
        if kind < 0.2 and texts:
            w = list(rng.choice(texts))
            for _ in range(rng.randint(0, 2)):
                if w:
                    w[rng.randrange(len(w))] = "changed"
        else:
            w = say(rng.randint(0, 2 * window))
            for _ in range(rng.randint(0, 2)):
                at = rng.randint(0, len(w))
                w[at:at] = rng.choice(passages)
        texts.append(w)
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(w)))
    return rows


def test_equals_brute_force_on_planted_passages(spark):
    for seed, window, vocabulary in ((1, 50, [f"w{k}" for k in range(500)]), (2, 8, [f"w{k}" for k in range(40)]), (3, 4, ["a", "b"])):
        rows = planted(random.Random(seed), 60, window, vocabulary)
        assert found(docs(spark, rows), window) == expected(rows, window)


def test_odd_rows(spark):
    long = " ".join(f"x{k}" for k in range(60_000))
    same = " ".join(["same"] * 80)
    rows = [(7, None), (3, ""), (4, " \n\t"), (9, long), (2, "b " + long), (5, same), (5, same), (1, same + " tail"), (None, same), (6, " ".join(["n"] * 60))]
    assert found(clashing(docs(spark, rows))) == expected(rows, 50)
    assert found(docs(spark, [])) == []


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(70)) for c in "ab")
    rows = [(1, a), (2, a), (2, b), (2, b + " c")]
    assert found(docs(spark, rows)) == expected(rows, 50)


def test_a_document_that_repeats_what_embeds_an_earlier_passage(spark):
    for seed in range(4):
        rng = random.Random(seed)
        say = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
        passage = say(60)
        paragraph = say(rng.randint(20, 60)) + passage + say(rng.randint(20, 60))
        rows = [(1, " ".join(say(40) + passage + say(40))), (2, " ".join(paragraph + say(80) + paragraph + say(9) + paragraph))]
        want = expected(rows, 50)
        assert want[1][2] == 180 and found(docs(spark, rows)) == want


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(map(tuple, QUERIES["op1_substring_dedup"](spark, sf).collect()))
    assert got == sorted((i, n, g, sha(k)) for i, n, g, k in expected(rows, 50))
    assert sum(r[2] for r in got) > 0
