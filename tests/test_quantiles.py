"""Quantiles against numpy, with histograms and sorted parts of a few rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.operators import quantiles as qu

SHARES = [0.0, 0.1, 0.5, 0.9, 0.99, 1.0]


def expected(rows):
    groups = {}
    for g, v in rows:
        if v is not None and not math.isnan(v):
            groups.setdefault(g, []).append(min(max(v, -qu.MOST), qu.MOST))
    out = {}
    for g, vs in groups.items():
        vs.sort()
        for s in SHARES:
            at = s * (len(vs) - 1)
            a, w = int(at), at - int(at)
            out[g, s] = vs[a] * (1 - w) + (vs[a + 1] * w if w else 0)
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r.share): r.value for r in qu.quantiles(df, ["g"], {"v": F.col("v")}, SHARES).collect()}
    want = expected(rows)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-12, abs_tol=1e-12) for k in want)


@pytest.mark.parametrize(("cells", "few"), [(8, 3), (4096, 4096)])
def test_quantiles_equal_sorting(spark, monkeypatch, cells, few):
    monkeypatch.setattr(qu, "CELLS", cells)
    monkeypatch.setattr(qu, "FEW", few)
    rng = random.Random(cells)
    rows = [("normal", rng.gauss(0, 1)) for _ in range(150)] + [("ties", float(rng.randrange(4))) for _ in range(200)]
    rows += [("outlier", float(k)) for k in range(60)] + [("outlier", 2.0**60), ("outlier", -(2.0**70))]
    rows += [("powers", 2.0 ** (k * 3)) for k in range(40)] + [("one", 7.0), (None, 1.0), (None, 2.0), ("nothing", None), ("nan", math.nan), ("nan", 3.0)]
    rows += [("endless", math.inf), ("endless", -math.inf), ("endless", 0.0), ("endless", 1e308), ("endless", -1e308)]
    check(spark, rows)


def test_as_numpy_has_it(spark):
    values = np.random.default_rng(2).normal(size=501)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = {r.share: r.value for r in qu.quantiles(df, [], {"v": F.col("v")}, SHARES).collect()}
    assert all(math.isclose(got[s], np.quantile(values, s), rel_tol=1e-12) for s in SHARES)


def test_columns_beside_a_summary(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 3, None), (None, 5, 2.0), ("b", None, None)], "g string, v int, w double")
    summary = df.groupBy("g").agg(F.count("*").alias("n"))
    out = qu.with_quantiles(summary, df, ["g"], {"mid_v": (F.col("v"), 0.5), "top_w": (F.col("w"), 1.0)}).collect()
    assert {r.g: (r.n, r.mid_v, r.top_w) for r in out} == {"a": (2, 2.0, 10.0), None: (1, 5.0, 2.0), "b": (1, None, None)}
    none = df.where("false")
    total = qu.with_quantiles(none.agg(F.count("*").alias("n")), none, [], {"mid": (F.col("v"), 0.5)}).collect()
    assert [(r.n, r.mid) for r in total] == [(0, None)]
