import math
import random

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SPACES, clashing, docs, labels, words
from tidewake.llm import quality
from tidewake.llm.queries import QUERIES


def expected(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed by the definitions."""
    w = words(text)
    places = {}
    for k in range(len(w) - 4):
        places.setdefault(tuple(w[k : k + 5]), []).append(k)
    repeated = {k + j for own in places.values() if len(own) > 1 for k in own for j in range(5)}
    solid = [x for x in (text or "").split("\n") if SPACES.sub("", x)]
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(solid) - len(set(solid)), len(repeated), n < 10 or 100 * len(repeated) > 20 * n


def rows(df):
    return {tuple(r)[0]: tuple(r)[1:] for r in df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()}


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_statistics_equal_brute_force(spark, sf):
    df = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    assert rows(quality.judged(df, quality.DecisionList())) == {r.doc_id: expected(r.text) for r in df.collect()}


def test_statistics_of_odd_texts(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "é#\x0bß\x0cx", "a b a b a b a b a b", "\n\nx\nx\n x\n", "😀 | 😀", "w " * 50_000, " lead", "  x y"]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 30))) for _ in range(60)]
    texts += ["".join(rng.choice("ab \n\t#") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    df = clashing(docs(spark, list(enumerate(texts))))
    assert rows(quality.judged(df, quality.DecisionList())) == {i: expected(t) for i, t in enumerate(texts)}
    assert quality.judged(docs(spark, []), quality.DecisionList()).count() == 0
    assert quality.judged(docs(spark, [(1, "x"), (1, "x"), (None, "y")]), quality.DecisionList()).count() == 3


def test_query_rejects_bad_and_keeps_good_texts(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op9_quality_rules"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("NOT base_failed")
    n = {(r.quality, r.kept): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert n[0, False] >= 0.9 * (n[0, False] + n.get((0, True), 0))
    assert n[1, True] >= 0.995 * (n[1, True] + n.get((1, False), 0))


def test_rules_are_learned_in_order_and_pruned(spark):
    rng = random.Random(1)
    some = []
    for i in range(900):
        kind = rng.choice(["good", "good", "symbols", "upper"])
        w = [f"{rng.choice('abcdefgh')}{k * 37 % 101}x" for k in range(rng.randint(20, 60))]
        some.append((i, " ".join({"good": w, "symbols": [x + "###" for x in w], "upper": [x.upper() for x in w]}[kind]), kind))
    df = docs(spark, [(i, t) for i, t, _ in some])
    found = quality.learn(df, labels(spark, [(i, int(k == "good"), 0) for i, _, k in some] + [(None, 0, 0), (3, None, 0)]))
    assert len(found.rules) >= 2
    kept = {r.doc_id: r.kept for r in quality.judged(df, found).collect()}
    assert sum(kept[i] != (k == "good") for i, _, k in some) <= 9


def test_without_labels_all_that_passes_the_base_rule_is_kept(spark):
    df = docs(spark, [(1, " ".join(f"w{k}" for k in range(30))), (2, "few words")])
    for some in (labels(spark, []), labels(spark, [(1, 1, 0)])):
        assert {r.doc_id: r.kept for r in quality.judged(df, quality.learn(df, some)).collect()} == {1: True, 2: False}


def test_kept_rows_come_with_all_their_columns(spark):
    df = clashing(docs(spark, [(1, " ".join(f"w{k}" for k in range(30))), (2, "few")])).withColumn("n_words", F.lit("mine"))
    assert [tuple(r) for r in quality.keep_good(df, labels(spark, [])).collect()] == [tuple(r) for r in df.where("doc_id = 1").collect()]


def test_no_python_runs_on_the_executors(spark):
    plan = quality.judged(docs(spark, [(1, "x")]), quality.DecisionList())._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def plain_rules(rows, names, bins, most_rules, most, precision, share):
    """Sequential covering by counting rows, one threshold after the other."""
    edges = {}
    for n in names:
        values = sorted(r[n] for r in rows)
        cuts = sorted({values[max(0, math.ceil(i / bins * len(values)) - 1)] for i in range(1, bins)})
        edges[n] = sorted({*cuts, *((a + b) / 2 for a, b in zip(cuts, cuts[1:], strict=False))})
    holds = lambda rule, r: all((r[n] > e) if above else (r[n] <= e) for n, above, e in rule)
    total = sum(r["low"] and not r["prune"] for r in rows)
    found = []
    while total and len(found) < most_rules:
        left = [r for r in rows if not any(holds(rule, r) for rule in found)]
        grown, seen = [], [r for r in left if not r["prune"]]
        while len(grown) < most:
            now = [r for r in seen if holds(grown, r)]
            p0 = sum(r["low"] for r in now)
            n0 = len(now) - p0
            if not p0 or not n0:
                break
            best, gain = None, 1e-9
            for n in names:
                last = None
                for e in edges[n]:
                    for above in (False, True):
                        hit = [r for r in now if (r[n] > e) == above]
                        p = sum(r["low"] for r in hit)
                        if p >= max(5, share * total):
                            g = p * (math.log2(p / len(hit)) - math.log2(p0 / len(now)))
                            if g > gain or (above and last is not None and best == (n, True, last) and g == gain):
                                best, gain = (n, above, e), g
                    last = e
            if best is None:
                break
            grown.append(best)
        fresh = [r for r in left if r["prune"]]
        scored = []
        for k in range(1, len(grown) + 1):
            hit = [r for r in fresh if holds(grown[:k], r)]
            p = sum(r["low"] for r in hit)
            scored.append(((2 * p - len(hit)) / len(hit) if p else -1.0, -k))
        if not scored or (1 + max(scored)[0]) / 2 < precision:
            break
        found.append(grown[: -max(scored)[1]])
    return found


def test_rules_equal_a_plain_twin(spark):
    rng = random.Random(8)
    texts = []
    for i in range(500):
        w = [f"{rng.choice('abcdefgh')}{rng.randint(0, 99)}" for _ in range(rng.randint(12, 50))]
        bad = rng.random() < 0.4
        texts.append((i, " ".join((x + "##" if bad and rng.random() < 0.6 else x.upper() if rng.random() < 0.1 else x) for x in w), int(not bad)))
    df = docs(spark, [(i, t) for i, t, _ in texts])
    names = list(quality.FEATURES)
    label = {i: q for i, _, q in texts}
    stats = quality.statistics(df).where(~quality.base_failed()).select(
        "doc_id", (F.pmod(F.xxhash64("doc_id", F.lit("prune")), F.lit(3)) == 0).alias("prune"), *[F.expr(e).cast("double").alias(n) for n, e in quality.FEATURES.items()]
    )
    rows = [{**r.asDict(), "low": label[r.doc_id] == 0} for r in stats.collect()]
    found = quality.learn(df, labels(spark, [(i, q, 0) for i, q in label.items()]), bins=10, max_rules=3)
    want = plain_rules(rows, names, 10, 3, 3, 0.9, 0.01)
    assert want and [[(c.feature, c.above, c.threshold) for c in rule] for rule in found.rules] == want
    kept = {r.doc_id: r.kept for r in quality.judged(df, found).where("NOT base_failed").collect()}
    assert kept == {r["doc_id"]: not any(all((r[n] > e) if a else (r[n] <= e) for n, a, e in rule) for rule in want) for r in rows}
