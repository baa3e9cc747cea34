"""Contrasts of an outcome between rows with and without a feature.

Features are named predicates over the columns of one analysis frame (id, sender, y and whatever the
predicates read). They are all evaluated in one pass, in long form, and everything after that is grouped by
feature. Null predicates count as *without*.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.functions.stats import newcombe, share
from tidewake.operators.frame import hash_part, hashed, ranked
from tidewake.sources.scratch import written


def long_form(frame: DataFrame, features: dict[str, str], keep: list[str]) -> DataFrame:
    """A row for each row and feature: feature, x (0 or 1) and the columns to keep."""
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.coalesce(F.expr(e), F.lit(False)).cast("int").alias("x")) for n, e in features.items()])
    return frame.select(*keep, F.inline(pairs))


def two_arms(rows: DataFrame, *by: str) -> DataFrame:
    """Sizes and rates of both arms, their gap and its Newcombe interval."""
    by = by or ("feature",)
    with_, y = F.col("x") == 1, F.col("y") == 1
    out = rows.groupBy(*by).agg(
        F.count_if(with_).alias("n1"), F.count_if(with_ & y).alias("k1"), F.count_if(~with_).alias("n0"), F.count_if(~with_ & y).alias("k0")
    )
    low, high = newcombe(F.col("k1"), F.col("n1"), F.col("k0"), F.col("n0"))
    r1, r0 = share(F.col("k1"), F.col("n1")), share(F.col("k0"), F.col("n0"))
    return out.select(*by, "n1", "k1", "n0", "k0", r1.alias("rate1"), r0.alias("rate0"), (r1 - r0).alias("gap"), low.alias("low"), high.alias("high"))


def fixed_effect(rows: DataFrame, *by: str, group: str = "sender", cluster: str = "sender", x: str = "x", y: str = "y") -> DataFrame:
    """b, se and z of x in a linear model of y with an effect for each group, errors clustered.

    Sums of x, y and their products by group and cluster are all that is needed: what demeaning within groups takes
    off each product sum follows from the groups' own sums. So rows are summed before they are shuffled, and no group
    meets in one task. Null where x does not vary, or where there are fewer than two groups or clusters.
    """
    by = by or ("feature",)
    cx, cy = F.col(x).cast("double"), F.col(y).cast("double")
    cells = rows.groupBy(*by, F.col(group).alias("_g"), F.col(cluster).alias("_c")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(cx).alias("x"), F.sum(cy).alias("y"), F.sum(cx * cx).alias("xx"), F.sum(cx * cy).alias("xy")
    )
    if group == cluster:
        cells = cells.withColumns({"mx": F.col("x") / F.col("n"), "my": F.col("y") / F.col("n")})
    else:
        means = cells.groupBy(*by, "_g").agg((F.sum("x") / F.sum("n")).alias("mx"), (F.sum("y") / F.sum("n")).alias("my"))
        cells = cells.join(means, [*by, "_g"])
    x_, y_, n_, mx, my = (F.col(c) for c in ("x", "y", "n", "mx", "my"))
    per = cells.groupBy(*by, "_c").agg(
        F.sum(F.col("xy") - mx * y_ - my * x_ + n_ * mx * my).alias("xy"), F.sum(F.col("xx") - 2 * mx * x_ + n_ * mx * mx).alias("xx"), F.sum("n").alias("n")
    )
    # A cluster's share of the error is sum(xy) - b * sum(xx); its square needs no b before the end.
    out = per.groupBy(*by).agg(
        F.sum("xy").alias("sxy"), F.sum("xx").alias("sxx"), F.sum(F.col("xy") * F.col("xy")).alias("uu"), F.sum(F.col("xy") * F.col("xx")).alias("uv"),
        F.sum(F.col("xx") * F.col("xx")).alias("vv"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("clusters"),
    )
    if group == cluster:
        out = out.withColumn("groups", F.col("clusters"))
    else:
        out = out.join(cells.groupBy(*by).agg(F.countDistinct("_g").alias("groups")), list(by))
    g, n = F.col("clusters"), F.col("n")
    k = 1 + F.col("groups")
    fits = (g > 1) & (F.col("groups") > 1) & (F.col("sxx") > 1e-12) & (n > k)
    b = F.col("sxy") / F.nullif(F.col("sxx"), F.lit(0.0))
    meat = F.greatest(F.lit(0.0), F.col("uu") - 2 * b * F.col("uv") + b * b * F.col("vv"))
    se = F.sqrt(g / (g - 1) * ((n - 1) / (n - k)) * meat) / F.col("sxx")
    return out.select(*by, F.when(fits, b).alias("b"), F.when(fits, se).alias("se"), F.when(fits & (se > 0), b / se).alias("z"))


def fixed_effects(frame: DataFrame, columns: list[str], group: str = "sender", cluster: str = "sender", y: str = "y") -> list[tuple[str, float, float]]:
    """(column, b, se) of several regressors in one model; products of columns are made before the call.

    The frame is read once, into sums of products by group and cluster, which are kept while both the coefficients
    and their errors are worked out; only k x k numbers reach the driver.
    """
    names, k = [*columns, y], len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k + 1)]
    v = [F.col(c).cast("double") for c in names]
    cells = frame.groupBy(F.col(group).alias("_g"), F.col(cluster).alias("_c")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(v[i]).alias(f"s{i}") for i in range(k + 1)], *[F.sum(v[i] * v[j]).alias(f"p{i}_{j}") for i, j in pairs]
    )
    cells = cells.persist()
    means = cells.groupBy("_g").agg(*[(F.sum(f"s{i}") / F.sum("n")).alias(f"m{i}") for i in range(k + 1)])
    m, s = ([F.col(f"{c}{i}") for i in range(k + 1)] for c in "ms")
    demeaned = [F.sum(F.col(f"p{i}_{j}") - m[i] * s[j] - m[j] * s[i] + F.col("n") * m[i] * m[j]).alias(f"d{i}_{j}") for i, j in pairs]
    per = cells.join(means, "_g").groupBy("_c").agg(F.sum("n").alias("n"), *demeaned)
    try:
        n_groups = cells.agg(F.countDistinct("_g")).first()[0]
        row = per.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c"), *[F.sum(f"d{i}_{j}").alias(f"d{i}_{j}") for i, j in pairs]).first()
        gram, right = np.zeros((k, k)), np.zeros(k)
        for i, j in pairs:
            value = row[f"d{i}_{j}"] or 0.0
            if j == k:
                right[i] = value
            else:
                gram[i, j] = gram[j, i] = value
        inverse = np.linalg.pinv(gram, rcond=1e-10, hermitian=True)
        b = inverse @ right
        of = lambda i, j: F.col(f"d{min(i, j)}_{max(i, j)}")
        score = [of(i, k) - reduce(lambda a, c: a + c, [F.lit(float(b[j])) * of(i, j) for j in range(k)]) for i in range(k)]
        found = per.agg(*[F.sum(score[i] * score[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    finally:
        cells.unpersist()
    meat = np.array([[found[f"m{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    free = row["n"] - k - n_groups
    scale = row["c"] / (row["c"] - 1) * (row["n"] - 1) / free if row["c"] > 1 and free > 0 else float("nan")
    se = np.sqrt(np.maximum(np.diag(scale * inverse @ meat @ inverse), 0))
    return [(c, float(b[i]), float(se[i])) for i, c in enumerate(columns)]


def logit_effect(rows: DataFrame, *by: str, group: str = "sender", steps: int = 8) -> DataFrame:
    """b, se and z of a 0/1 column x in a logit of y with an effect for each group, errors clustered by group.

    Sizes and hits of both arms by group are all that is needed, and they are written. For a given b a group's own effect is
    the positive root of a quadratic (its hits are those that the model expects), so only b is left to Newton's steps: each
    is one sum over groups, from the Mantel-Haenszel estimate on. Groups without variation of y say nothing of b and are
    left out; b is null where an arm has no hits, or no misses, in the rest."""
    by = by or ("feature",)
    with_, y = F.col("x") == 1, F.col("y") == 1
    cells = rows.groupBy(*by, F.col(group).alias("_g")).agg(
        F.count_if(with_).alias("n1"), F.count_if(with_ & y).alias("k1"), F.count_if(~with_).alias("n0"), F.count_if(~with_ & y).alias("k0")
    )
    n1, k1, n0, k0 = (F.col(c).cast("double") for c in ("n1", "k1", "n0", "k0"))
    n, k = n1 + n0, k1 + k0
    cells = written(cells.where("k1 + k0 > 0 AND k1 + k0 < n1 + n0"), "logit-cells")
    fit = cells.groupBy(*by).agg(F.ln(F.sum(k1 * (n0 - k0) / n) / F.nullif(F.sum(k0 * (n1 - k1) / n), F.lit(0.0))).alias("b"))

    def at(fit: DataFrame) -> DataFrame:
        e = F.exp("b")
        half = n0 + n1 * e - k * (1 + e)
        odds = cells.join(fit, list(by)).withColumn("_u", 2 * k / (half + F.sqrt(half * half + 4 * e * (n - k) * k)))
        p1, p0 = F.col("_u") * e / (1 + F.col("_u") * e), F.col("_u") / (1 + F.col("_u"))
        w1, w0 = n1 * p1 * (1 - p1), n0 * p0 * (1 - p0)
        return odds.select(*by, "b", n.alias("n"), (k1 - n1 * p1).alias("score"), (w1 * w0 / (w1 + w0)).alias("info"))

    for _ in range(steps):
        fit = at(fit).groupBy(*by).agg((F.first("b") + F.sum("score") / F.nullif(F.sum("info"), F.lit(0.0))).alias("b"))
    g = F.count(F.lit(1))
    meat = F.sum(F.col("score") * F.col("score")) * (g / F.nullif(g - 1, F.lit(0))) * ((F.sum("n") - 1) / F.nullif(F.sum("n") - 1 - g, F.lit(0.0)))
    out = at(fit).groupBy(*by).agg(F.first("b").alias("b"), (F.sqrt(meat) / F.sum("info")).alias("se"), F.sum("n").cast("long").alias("n"), g.alias("groups"))
    return out.select(*by, "b", "se", (F.col("b") / F.nullif("se", F.lit(0.0))).alias("z"), "n", "groups")


def sign_panel(rows: DataFrame, least: int, group: str = "sender") -> DataFrame:
    """Groups that have enough rows in both arms: how many, and in how many the gap is positive."""
    arms = two_arms(rows, "feature", group).where((F.col("n1") >= least) & (F.col("n0") >= least))
    return arms.groupBy("feature").agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("gap") > 0).alias("positive"))


def bucket_rates(frame: DataFrame, value: str, edges: list[float], labels: list[str]) -> DataFrame:
    """Rates of y in buckets that include their upper edge; empty ones stay, values outside are left out."""
    spark = frame.sparkSession
    ladder = F.lit(None).cast("int")
    for i in range(len(labels) - 1, -1, -1):
        ladder = F.when((F.col(value) > edges[i]) & (F.col(value) <= edges[i + 1]), i).otherwise(ladder)
    got = frame.select(ladder.alias("bucket"), "y").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k"))
    names = spark.createDataFrame(list(enumerate(labels)), "bucket int, label string")
    return names.join(got, "bucket", "left").select("bucket", "label", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("k", F.lit(0)).cast("long").alias("k"), share(F.col("k"), F.col("n")).alias("rate"))


def bucket_tables(frame: DataFrame, tables: dict[str, list[float]]) -> DataFrame:
    """``bucket_rates`` of several columns from one pass; a bucket has its edges in place of a label."""
    spark = frame.sparkSession
    pairs = F.array(*[F.struct(F.lit(c).alias("table"), F.col(c).cast("double").alias("value")) for c in tables])
    names = spark.createDataFrame([(c, i, float(a), float(b)) for c, e in tables.items() for i, (a, b) in enumerate(zip(e, e[1:], strict=False))], "table string, bucket int, low double, high double")
    # Values are counted before they meet the buckets, of which there are as many as were given.
    counts = frame.select("y", F.inline(pairs)).groupBy("table", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k"))
    met = names.join(counts.withColumnRenamed("table", "of"), (F.col("table") == F.col("of")) & (F.col("value") > F.col("low")) & (F.col("value") <= F.col("high")), "left")
    out = met.groupBy("table", "bucket", "low", "high").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
    return out.withColumn("rate", share(F.col("k"), F.col("n")))


def overdispersion(frame: DataFrame, group: str, least: int) -> DataFrame:
    """Groups of enough rows: zero share seen and expected, chi-square, degrees of freedom, variance ratio."""
    g = frame.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k")).where(F.col("n") >= least)
    overall = g.agg((F.sum("k") / F.sum("n")).alias("p"))
    g = g.join(F.broadcast(overall))  # one row
    expected = F.col("n") * F.col("p")
    return g.agg(
        F.count(F.lit(1)).alias("groups"), F.avg((F.col("k") == 0).cast("int")).alias("zero_seen"), F.avg(F.pow(1 - F.col("p"), F.col("n"))).alias("zero_expected"),
        F.sum((F.col("k") - expected) * (F.col("k") - expected) / F.nullif(expected * (1 - F.col("p")), F.lit(0.0))).alias("chi2"), (F.count(F.lit(1)) - 1).alias("df"),
        (F.var_samp(F.col("k") / F.col("n")) / F.nullif(F.avg(F.col("p") * (1 - F.col("p")) / F.col("n")), F.lit(0.0))).alias("ratio"),
    )


def permuted(frame: DataFrame, seeds: list[str], group: str = "sender", key: str = "event_id", outcomes: tuple[str, ...] = ("y",)) -> DataFrame:
    """A copy of the frame for each ``seed``, with the outcomes of a row dealt anew (together) within each group: ranks by
    key meet ranks by a seeded hash of it. All seeds are one plan; the ranks by key are taken once.

    Ranks are taken in parts of a group, so that a group of very many rows is not one task."""
    each = F.explode(F.array(*map(F.lit, seeds))).alias("seed")
    own, new = hashed(key, "own"), hashed(key, F.col("seed"))
    left = ranked(frame.drop(*outcomes), [group], hash_part(own), [own, F.col(key)], "_r").select("*", each)
    right = ranked(frame.select(group, key, *outcomes, each), ["seed", group], hash_part(new), [new, F.col(key)], "_r")
    return left.join(right.select("seed", group, "_r", *outcomes), ["seed", group, "_r"]).drop("_r")


def verdicts(train: DataFrame, held: DataFrame, bound: float, least: int) -> DataFrame:
    """Each feature's effect in two periods, and what the second says of the first."""
    t = train.select("feature", F.col("b").alias("b_train"), F.col("z").alias("z_train"))
    h = held.select("feature", F.col("b").alias("b_held"), F.col("z").alias("z_held"), (F.col("b") + 1.96 * F.col("se")).alias("upper"), "n1")
    same = F.signum("b_train") == F.signum("b_held")
    verdict = (
        F.when(F.col("n1").isNull() | (F.col("n1") < least) | F.col("b_held").isNull(), "untestable")
        .when((F.abs("z_train") >= 1.96) & same & (F.abs("z_held") >= 1.96), "replicates")
        .when((F.abs("z_train") >= 1.96) & same, "direction only")
        .when(F.abs("z_train") >= 1.96, "fails")
        .when(F.col("upper") < bound, "null confirmed")
        .otherwise("inconclusive")
    )
    return t.join(h, "feature", "left").select("feature", "b_train", "b_held", verdict.alias("verdict"))


def stability(fits: DataFrame, over: str) -> DataFrame:
    """Each feature's effects under several settings (``over``): their range, and whether sign and significance stay."""
    significant = F.abs("z") >= 1.96
    return fits.groupBy("feature").agg(
        F.count("b").alias("n_fits"), F.min("b").alias("least_b"), F.max("b").alias("greatest_b"),
        (F.countDistinct(F.signum("b")) == 1).alias("same_sign"), (F.countDistinct(significant) == 1).alias("same_significance"),
    )


def flips(fits: DataFrame, by: str, first: str, second: str) -> DataFrame:
    """Effects in two classes side by side: a model in which everything, the groups' effects too, differs by class."""
    a = fits.where(F.col(by) == first).select("feature", F.col("b").alias("b_first"), F.col("se").alias("_s1"))
    b = fits.where(F.col(by) == second).select("feature", F.col("b").alias("b_second"), F.col("se").alias("_s2"))
    out = a.join(b, "feature").withColumn("difference", F.col("b_first") - F.col("b_second"))
    z = F.col("difference") / F.nullif(F.sqrt(F.col("_s1") * F.col("_s1") + F.col("_s2") * F.col("_s2")), F.lit(0.0))
    return out.select("feature", "b_first", "b_second", "difference", z.alias("z"), (F.signum("b_first") != F.signum("b_second")).alias("sign_flips"), (F.abs(z) >= 1.96).alias("significant"))


def sender_cohorts(frame: DataFrame, least: int, marks: Column, share_: float) -> DataFrame:
    """sender and cohort, from independent evidence: how many rows are seen of it, and how many of those carry a mark."""
    seen = frame.groupBy("sender").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(marks, F.lit(False)).cast("int")).alias("marked"))
    return seen.select("sender", F.when(F.col("n") < least, "too few").when(F.col("marked") >= share_, "mostly").otherwise("partly").alias("cohort"))
