"""Operators that hold at size: keyed appends, numbering of uneven keys, sketches, logits, ranges of counts."""

import math
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.operators import contrast as con
from tidewake.operators import frame as fr
from tidewake.operators import sketches as sk
from tidewake.sources import records, scratch


def fresh():
    return "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_an_append_reads_only_buckets_it_can_meet(spark):
    path = fresh()
    ids = lambda *keys: spark.createDataFrame([(k, f"v{k}") for k in keys], "id long, v string")
    assert records.append_keyed(ids(*range(2000), None), path, "id") == []
    assert records.append_keyed(ids(*range(2000, 3000)), path, "id", 16) == []  # 2000 keys in 33 million bits
    met = records.append_keyed(ids(5, 5, 5000), path, "id")
    assert len(met) == 1
    table = records.keyed_table(spark, path, ids(1).schema)
    assert sorted(r.id for r in table.collect()) == [*range(3000), 5000] and table.where("id = 5").first().v == "v5"


def test_a_full_filter_costs_reads_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(records, "BITS", 8)
    monkeypatch.setattr(records, "BUCKETS", 2)
    path = fresh()
    for low in (0, 40, 80):
        records.append_keyed(spark.range(low, low + 60), path, "id", chunks=1)
    assert sorted(r.id for r in records.keyed_table(spark, path, spark.range(1).schema).collect()) == list(range(140))
    records.append_keyed(spark.range(0), path, "id", chunks=1)
    assert records.keyed_table(spark, path, spark.range(1).schema).count() == 140


def test_one_far_key_leaves_the_ranges_even(spark):
    df = spark.range(20_000).select(F.when(F.col("id") == 77, F.lit(2**60)).otherwise(F.col("id")).alias("id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = [r["count"] for r in fr.in_ranges(df, "id").groupBy("_range").count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) >= 4 and max(sizes) < 2 * 20_000 / len(sizes)
    nth = {r.id: r.nth for r in fr.numbered(df, "id").collect()}
    assert nth[2**60] == 19_999 and nth[76] == 76 and nth[78] == 77 and len(nth) == 20_000


def test_ranges_as_wide_as_a_period_needs(spark):
    buckets = [0, 1, 2**40, 2**40 + 1]
    df = spark.createDataFrame([(1, b) for b in buckets] + [(2, -5), (2, 7)], "p int, b long")
    got = sorted((r.period, r.low, r.high, r.n) for r in fr.range_chunks(df, F.col("b"), F.col("p"), 10).collect())
    assert got == [(1, 0, 2**40 + 1, 4), (2, -5, -5, 1), (2, 7, 7, 1)]
    halves = sorted((r.low, r.high, r.n) for r in fr.range_chunks(df.where("p = 1"), F.col("b"), F.col("p"), 3).collect())
    assert halves == [(0, 1, 2), (2**40, 2**40 + 1, 2)]


def test_sketches_merge(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("part"), (F.col("id") % 17_000).alias("v"))
    stored = sk.sketches(df, ["part"], "v")
    (row,) = sk.merged(stored, []).collect()
    assert abs(row.estimate - 17_000) < 4 * sk.ERROR * 17_000
    assert sk.merged(sk.sketches(df.where("v < 50"), ["part"], "v"), []).first().estimate == 50  # small numbers are exact


def logit(rows):
    """A plain logit with a dummy for each group, by Newton's steps; errors clustered by group."""
    groups = sorted({g for g, _, _ in rows})
    kept = [g for g in groups if 0 < sum(y for h, _, y in rows if h == g) < sum(h == g for h, _, _ in rows)]
    rows = [r for r in rows if r[0] in kept]
    x = np.array([[r[1], *(float(r[0] == g) for g in kept)] for r in rows])
    y = np.array([r[2] for r in rows], float)
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        hessian = x.T @ (x * (p * (1 - p))[:, None])
        beta += np.linalg.solve(hessian, x.T @ (y - p))
    scores = x * (y - p)[:, None]
    sums = np.array([scores[[r[0] == g for r in rows]].sum(0) for g in kept])
    n, k, g = len(rows), x.shape[1], len(kept)
    bread = np.linalg.inv(hessian)
    se = math.sqrt((bread @ (sums.T @ sums) @ bread)[0, 0] * g / (g - 1) * (n - 1) / (n - k))
    return beta[0], se, n, g


@pytest.mark.parametrize("seed", range(3))
def test_logit_equals_one_with_dummies(spark, seed):
    rng = random.Random(seed)
    rows = []
    for g in range(8):
        base = rng.uniform(-2, 2)
        for _ in range(rng.randrange(20, 60)):
            x = int(rng.random() < 0.4)
            rows.append((g, x, int(rng.random() < 1 / (1 + math.exp(-(base + 1.5 * x * (seed - 1)))))))
    rows += [(90, 0, 0), (90, 1, 0), (91, 1, 1)] + [(92, 1, k % 2) for k in range(9)]  # separated groups, and one of one arm
    df = spark.createDataFrame([("f", *r) for r in rows], "feature string, sender long, x int, y int")
    (got,) = con.logit_effect(df).collect()
    b, se, n, g = logit(rows)
    assert math.isclose(got.b, b, rel_tol=1e-8, abs_tol=1e-9) and math.isclose(got.se, se, rel_tol=1e-8) and (got.n, got.groups) == (n, g)


def test_a_logit_without_hits_in_an_arm_is_null(spark):
    df = spark.createDataFrame([("f", 1, 0, 1), ("f", 1, 0, 0), ("f", 1, 1, 0), ("f", 2, 0, 1), ("f", 2, 1, 0)], "feature string, sender long, x int, y int")
    assert con.logit_effect(df).first().b is None


def test_folders_are_dropped(spark):
    path = scratch.folder(spark, "dropped")
    spark.range(3).write.parquet(path)
    held, scratch._PATHS[spark.sparkContext.applicationId] = scratch._PATHS[spark.sparkContext.applicationId], [path]
    assert scratch.drop_folders(spark) == 1 and not records.exists(spark, path)
    scratch._PATHS[spark.sparkContext.applicationId] = held
