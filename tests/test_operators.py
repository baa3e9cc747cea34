"""Edges of intervals, degenerate fits and properties that hold by construction."""

import datetime as dt
import json
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewake.functions import stats
from tidewake.operators import agreement as ag
from tidewake.operators import attribution as att
from tidewake.operators import contrast as con
from tidewake.operators import frame as fr
from tidewake.operators import funnel, redaction
from tidewake.operators import sessions as ses
from tidewake.sources import records

START = dt.datetime(2024, 1, 1)
TOUCH = "event_id long, entity long, ts timestamp, channel string, sender long, thread_id string"


def at(hours, us=0):
    return START + dt.timedelta(hours=hours, microseconds=us)


def events(spark, rows):
    return spark.createDataFrame([(i, e, t, "view", 1, None) for i, e, t in rows], TOUCH)


def test_a_gap_of_exactly_the_limit_starts_a_session(spark):
    df = ses.sessionized(events(spark, [(1, 1, at(0)), (2, 1, at(24)), (3, 1, at(48, -1)), (4, 2, at(0)), (5, 2, at(0))]), ses.DAY)
    assert {r.event_id: (r.session_no, r.touch_no) for r in df.collect()} == {1: (1, 1), 2: (2, 1), 3: (2, 2), 4: (1, 1), 5: (1, 2)}


def test_answers_come_after_the_head_and_up_to_the_deadline(spark):
    heads = ses.session_heads(ses.sessionized(events(spark, [(1, 1, at(0)), (2, 1, at(48)), (3, 2, at(0))]), ses.DAY))
    for hours, us, want in ((0, 0, {}), (0, 1, {1: 1}), (48, 0, {1: 1}), (48, 1, {2: 1}), (48 + 72, 0, {2: 1}), (48 + 72, 1, {})):
        answers = events(spark, [(9, 1, at(hours, us))])
        got = att.attributed(heads, att.candidates(heads, answers, 3 * ses.DAY, "entity", "entity", 0)).where("n_candidates > 0")
        assert {r.event_id: r.n_candidates for r in got.collect()} == want
    back = att.looked_back(heads, events(spark, [(9, 1, at(24)), (10, 2, at(0))]), ses.DAY)
    assert [(r.entity, r.session_no) for r in back.collect()] == [(1, 2)]


def test_the_curve_equals_the_loop(spark):
    rng = np.random.default_rng(2)
    rows, replies, per = [], [], {}
    for s in range(60):
        times = sorted(rng.integers(0, 12, rng.integers(1, 11)).tolist())
        r = int(rng.integers(0, 14)) if rng.random() < 0.6 else None
        per[s] = (times, r)
        rows += [(s, 1, k, "view", 1, at(t)) for k, t in enumerate(times, 1)]
        replies += [(s, 1, (int(START.replace(tzinfo=dt.UTC).timestamp()) + 3600 * r) * 1_000_000)] if r is not None else []
    sessions = spark.createDataFrame(rows, "entity long, session_no long, touch_no int, channel string, sender long, ts timestamp")
    stages = funnel.stage_records(sessions, spark.createDataFrame(replies, "entity long, session_no long, response_us long"))
    got = {r.touch_no: (r.at_risk, r.sent, r.replied, r.stopped) for r in funnel.follow_up_curve(spark, stages).collect()}
    risk, want = list(per), {}
    for n in range(1, 9):
        # A session that was answered before its touch n leaves silently.
        left = [s for s in risk if n > len(per[s][0]) or per[s][1] is None or per[s][1] > per[s][0][n - 1]]
        sent = [s for s in left if n <= len(per[s][0])]
        hit = [s for s in sent if per[s][1] is not None and (n == len(per[s][0]) or per[s][1] <= per[s][0][n])]
        want[n] = (len(left), len(sent), len(hit), len(left) - len(sent))
        risk = [s for s in sent if s not in hit]
    assert got == want


def fitted(spark, x, y, s, **more):
    df = spark.createDataFrame([("f", int(a), int(b), int(c)) for a, b, c in zip(x, y, s, strict=True)], "feature string, x int, y int, sender int")
    return con.fixed_effect(df, **more).first()


def dummies(x, y, s):
    """The same model by dummy variables."""
    groups = np.unique(s)
    a = np.column_stack([*x, *[(s == g).astype(float) for g in groups]])
    b = np.linalg.lstsq(a, y, rcond=None)[0]
    e = y - a @ b
    bread = np.linalg.pinv(a.T @ a)
    meat = sum(np.outer(v, v) for g in groups for v in [a[s == g].T @ e[s == g]])
    n, k = a.shape
    v = bread @ meat @ bread * len(groups) / (len(groups) - 1) * (n - 1) / (n - k)
    return b[: len(x)], np.sqrt(np.diag(v))[: len(x)]


def test_fixed_effects_equal_dummy_variables(spark):
    rng = np.random.default_rng(7)
    s, x, z = rng.integers(0, 8, 400), rng.integers(0, 2, 400).astype(float), rng.normal(size=400)
    y = (rng.random(400) < 0.2 + 0.1 * x + 0.02 * s).astype(float)
    one = fitted(spark, x, y, s)
    b, se = dummies([x], y, s)
    assert np.allclose([one.b, one.se], [b[0], se[0]])
    df = spark.createDataFrame([(int(c), float(p), float(q), float(p * q), float(v)) for c, p, q, v in zip(s, x, z, y, strict=True)], "sender int, p double, q double, pq double, y double")
    got = con.fixed_effects(df, ["p", "q", "pq"])
    b, se = dummies([x, z, x * z], y, s)
    assert np.allclose([g[1] for g in got], b) and np.allclose([g[2] for g in got], se)


def test_fits_that_say_nothing_are_null(spark):
    for x, s in (([1, 1, 1, 1, 1], [0, 0, 1, 1, 1]), ([0, 1, 0, 1, 1], [0, 0, 0, 0, 0])):
        assert fitted(spark, x, [0, 1, 0, 1, 0], s).b is None


def test_benjamini_hochberg_within_families(spark):
    p = [0.01, 0.04, 0.03, None, 0.5]
    df = spark.createDataFrame([(f"f{k}", v, "a" if k < 4 else "b") for k, v in enumerate(p)], "feature string, p double, family string")
    got = {r.feature: r.q for r in stats.benjamini_hochberg(df, "p", "family").collect()}
    assert got["f3"] is None and np.allclose([got["f0"], got["f1"], got["f2"], got["f4"]], [0.03, 0.04, 0.04, 0.5])


def test_kappa_is_symmetric_and_null_where_chance_is_certain(spark):
    rows = [("k", True, True), ("k", True, False), ("k", False, False), ("c", True, True), ("k", None, True)]
    df = spark.createDataFrame(rows, "g string, a boolean, b boolean")
    one, two = ({r.g: (r.n, r.kappa) for r in ag.kappas(df, "g", *c).collect()} for c in (("a", "b"), ("b", "a")))
    assert one == two and one["c"][1] is None and one["k"][0] == 3
    assert stats.two_sided_p(1.959964) == pytest.approx(0.05, abs=1e-6) and stats.two_sided_p(None) is None


def test_gates_and_invariants_stop_what_follows(spark):
    shut = ag.gate(spark.createDataFrame([(0.4,)], "v double"), "v", 0.6, "g")
    with pytest.raises(ValueError, match="shut"):
        ag.require(shut)
    ag.require(ag.gate(spark.createDataFrame([(0.6,)], "v double"), "v", 0.6, "g"))
    with pytest.raises(ValueError, match="broken"):
        ag.hold(ag.invariants(spark.createDataFrame([(1, 3)], "id int, s int"), spark.createDataFrame([(2,)], "id int"), {"s": (0, 2)}))


def test_waterfall_conserves_rows(spark):
    rows = fr.waterfall(spark.range(100), [("even", F.col("id") % 2 == 0), ("null", F.lit(None).cast("boolean")), ("any", F.lit(True))]).collect()
    assert [(r.n, r.dropped) for r in rows] == [(100, 0), (50, 50), (0, 50), (0, 0)]


def test_joins_refuse_clashing_columns(spark):
    df = spark.createDataFrame([(1, 2)], "id int, v int")
    with pytest.raises(ValueError, match="v"):
        fr.without_clash(df, df, ["id"])
    assert fr.optional(df, None, ["id"]) is df


def test_buckets_take_their_upper_edge_and_keep_empty_ones(spark):
    df = spark.createDataFrame([(0.0, 1), (50.0, 1), (51.0, 0), (500.0, 1)], "v double, y int")
    got = con.bucket_rates(df, "v", [0, 50, 100, 200], ["a", "b", "c"]).orderBy("bucket").collect()
    assert [(r.label, r.n, r.k, r.rate) for r in got] == [("a", 1, 1, 1.0), ("b", 1, 0, 0.0), ("c", 0, 0, None)]


def test_case_tells_words_from_names(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["a Short call", "short one", "short it", "short", "Hansen", "Hansen x", "hansen"])], "id int, text string")
    vocabulary = spark.createDataFrame([("short",), ("hansen",), ("absent",)], "token string")
    assert {r.token: r.ordinary for r in redaction.pruned(docs, "id", "text", vocabulary).collect()} == {"short": True, "hansen": False, "absent": False}


def test_routes_straddling_a_bucket_stay_apart(spark):
    rows = [(1, 1, at(1, -1), "view"), (2, 1, at(2), "view")]
    log = fr.united(spark.createDataFrame(rows[:1], "event_id long, entity long, ts timestamp, channel string"), spark.createDataFrame(rows[1:], "event_id long, entity long, ts timestamp, channel string"))
    assert fr.deduplicated_routes(log, ["entity"]).count() == 2
    near = log.withColumn("ts", F.lit(at(1)))
    assert [r.route for r in fr.deduplicated_routes(near, ["entity"]).collect()] == ["sync"]


def test_numbering_needs_no_global_sort(spark):
    df = spark.createDataFrame([(k,) for k in (5, 1, 900, 17, -3)], "id long")
    assert sorted((r.id, r.nth) for r in fr.numbered(df, "id").collect()) == [(-3, 0), (1, 1), (5, 2), (17, 3), (900, 4)]


def test_partition_counts_change_nothing(spark):
    df = events(spark, [(k, k % 5, at(k * 7 % 400)) for k in range(200)])
    one, many = (sorted(map(tuple, ses.session_sizes(ses.sessionized(df.repartition(p), ses.DAY)).collect())) for p in (1, 8))
    assert one == many


def test_record_files(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    put = lambda name, text: open(f"{folder}/{name}", "w").write(text)  # noqa: E731, SIM115
    put("a.jsonl", json.dumps({"id": "1", "properties": {"to": "A@x.y; b@c.d", "at": "2024-01-02T03:04:05Z"}}) + "\n" + json.dumps({"id": "2", "properties": {}}))
    got = records.flat(records.nested(spark, f"{folder}/a.jsonl", ["to", "at"], 2))
    rows = {r.id: r for r in got.select("id", records.addresses(F.col("to")).alias("to"), records.instant(F.col("at")).alias("at")).collect()}
    assert rows["1"].to == ["a@x.y", "b@c.d"] and rows["1"].at == dt.datetime(2024, 1, 2, 3, 4, 5) and rows["2"].to == [] and rows["2"].at is None
    assert spark.range(1).select(records.instant(F.lit("1704164645000")).alias("t")).first().t == dt.datetime(2024, 1, 2, 3, 4, 5)
    out = got.select(F.col("id"), records.addresses(F.col("to")).alias("recipients"))
    assert [r.recipient for r in records.touches_from(out, ["x.y"]).collect()] == ["b@c.d"]
    put("b1.json", '[{"id": "7", "label": "x"}]')
    batch = records.batches(spark, f"{folder}/b1.json", T.StructType([T.StructField("id", T.StringType()), T.StructField("label", T.StringType())]))
    assert [tuple(r) for r in batch.collect()] == [("7", "x", "b1")]
    put("s1.json", '{"1": ["p", "q"], "2": []}')
    assert sorted(map(tuple, records.associations(spark, f"{folder}/s1.json").collect())) == [("1", 0, "p"), ("1", 1, "q")]
    put("o.json", '[{"id": "1", "email": "A@B.c", "teams": [{"id": "t", "name": "n"}]}, {"id": "2", "email": null}]')
    assert sorted(r.n_teams for r in records.owners(spark, f"{folder}/o.json").collect()) == [0, 1]
    put("ids.txt", "a\n\n b\na\n")
    assert sorted(r.id for r in records.id_list(spark, f"{folder}/ids.txt").collect()) == ["a", "b"]
    path = f"{folder}/table"
    spark.range(3).write.parquet(path)
    records.append_missing(spark.range(5), path, "id")
    assert spark.read.parquet(path).count() == 5
    records.write_batches(spark.range(5).withColumn("nth", F.col("id")), f"{folder}/batches", 2)
    assert spark.read.json(f"{folder}/batches").groupBy("batch").count().count() == 3


def test_the_normal_tail_equals_erfc_far_out(spark):
    import math

    from tidewake.functions.stats import normal_tail

    zs = [0.0, 0.1, 0.5, 0.66, 0.67, 1.0, 1.96, 3.0, 5.0, 5.7, 6.0, 8.0, 12.0, -2.5, 30.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double").select("z", normal_tail(F.col("z")).alias("p"))
    for r in df.collect():
        assert math.isclose(r.p, math.erfc(abs(r.z) / math.sqrt(2)), rel_tol=1e-11)


def test_chunks_never_exceed_their_cap(spark):
    rng = np.random.default_rng(3)
    days = rng.integers(0, 400, 3000).tolist() + [77] * 90
    df = spark.createDataFrame([(1, d) for d in days], "p int, d int")
    got = sorted((r.low, r.high, r.n) for r in fr.range_chunks(df, F.col("d"), F.col("p"), 60).collect())
    assert sum(n for _, _, n in got) == len(days) and all(a[1] < b[0] for a, b in zip(got, got[1:], strict=False))
    assert all(n <= 60 or low == high == 77 for low, high, n in got)
    assert all(n == sum(low <= d <= high for d in days) for low, high, n in got)


def test_repeated_keys_on_the_right_are_refused(spark):
    left = spark.createDataFrame([(1, 2)], "id int, a int")
    assert fr.without_clash(left, spark.createDataFrame([(1, 5), (2, 6)], "id int, b int"), ["id"]).collect()[0].b == 5
    with pytest.raises(Exception, match="repeats on the right"):
        fr.without_clash(left, spark.createDataFrame([(1, 5), (1, 5)], "id int, b int"), ["id"]).collect()


def test_dealing_anew_keeps_each_groups_outcomes(spark):
    df = spark.createDataFrame([(k, k % 3, k % 2) for k in range(60)], "event_id long, sender int, y int")
    out = con.permuted(df, "s").collect()
    assert len(out) == 60 and sorted((r.sender, r.y) for r in out) == sorted((k % 3, k % 2) for k in range(60))
    assert [r.y for r in sorted(out, key=lambda r: r.event_id)] != [k % 2 for k in range(60)]


def test_ranks_and_previous_rows_equal_plain_windows(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), int(rng.integers(0, 3)), int(rng.integers(0, 100))) for k in rng.choice(100_000, 300, replace=False)]
    df = spark.createDataFrame(rows, "id long, g int, v int")
    ranks = {r.id: r.nth for r in fr.ranked(df, ["g"], F.floor(F.col("id") / 1000), [F.col("id")], "nth").collect()}
    before = {r.id: r.before for r in fr.with_previous(df, "g", "id", "v", "before").collect()}
    for g in range(3):
        own = sorted(r for r in rows if r[1] == g)
        assert [ranks[r[0]] for r in own] == list(range(len(own)))
        assert [before[r[0]] for r in own] == [None, *(r[2] for r in own[:-1])]


def test_subsets_are_compared_with_their_source(spark):
    source = spark.createDataFrame([(k, f"t{k}") for k in range(6)], "id int, text string")
    sent = spark.createDataFrame([(0, "a", "t0"), (1, "a", "changed"), (2, "b", "t2"), (9, "b", "t9")], "id int, part string, text string")
    got = {r.part: (r.n, r.changed, r.unknown) for r in fr.content_identity(sent, source, "id", ["text"], "part").collect()}
    assert got == {"a": (2, 1, 0), "b": (2, 0, 1)}
    assert fr.common(sent, source, "id").first().n_common == 3
    both = fr.distinct_union([sent.select("id", "text"), source], "id").collect()
    assert sorted((r.id, r.text, r.n_frames) for r in both)[:2] == [(0, "t0", 2), (1, "changed", 2)] and len(both) == 7


def test_examples_shares_and_top_values(spark):
    df = spark.createDataFrame([(k, k % 3, "x" if k % 4 else "y") for k in range(400)], "id int, g int, v string")
    assert sorted(r.g for r in fr.examples(df, "id", "g", "s", 2).collect()) == [0, 0, 1, 1, 2, 2]
    assert {r.id for r in fr.examples(df, "id", "g", "s", 2).collect()} == {r.id for r in fr.examples(df.repartition(7), "id", "g", "s", 2).collect()}
    assert 20 <= fr.share_of(df, "id", "s", 0.1).count() <= 60
    assert [tuple(r)[1:] for r in fr.top_values(df, ["v"], 1).collect()] == [("x", 300, 1)]


def test_agreement_of_constant_and_perfect_raters(spark):
    a = spark.createDataFrame([(k, k % 5 + 1, 1, k % 2 == 0) for k in range(40)], "id int, s int, c int, f boolean")
    b = a.where("id < 30")
    got = {r.dimension: r for r in ag.rating_agreement(a, b, "id", ["s", "c"], ["f"]).collect()}
    assert got["s"].n == 30 and got["s"].exact == 1 and got["s"].kappa == 1 and got["s"].verdict == "good"
    assert got["c"].kappa is None and got["c"].verdict == "unknown" and got["f"].within_one is None and got["f"].kappa == 1
    other = ag.rating_agreement(a, b.withColumn("s", 6 - F.col("s")), "id", ["s"])
    assert ag.self_against_cross(ag.rating_agreement(a, b, "id", ["s"]), other).first().lost > 0.5


def test_first_or_last_result_set_wins(spark):
    one, two = (spark.createDataFrame(rows, "id int, label string") for rows in ([(1, "a"), (2, "a")], [(2, "b"), (3, "b")]))
    for first, want in ((False, ["a", "b", "b"]), (True, ["a", "a", "b"])):
        assert [r.label for r in sorted(ag.overlaid([one, two], first_wins=first).collect(), key=lambda r: r.id)] == want


def test_candidates_cross_stretches_of_time(spark):
    us = 1_000_000
    heads = spark.createDataFrame([(1, 0, at(0), None), (1, 1, at(50), None)], "entity long, session_no long, ts timestamp, next_start timestamp")
    answers = spark.createDataFrame([(k, 1, at(h)) for k, h in enumerate((0, 1, 9.5, 10, 10.5, 49, 60, 61))], "event_id long, entity long, ts timestamp")
    got = att.candidates(heads, answers, 10 * 3600 * us, "entity", "e", 0).collect()
    assert sorted((r.session_no, r.response_id) for r in got) == [(0, 1), (0, 2), (0, 3), (1, 6)]
    assert sorted(r.session_no for r in att.looked_back(heads, answers, 3600 * us).collect()) == [1]
