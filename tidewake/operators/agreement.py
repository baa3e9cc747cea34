"""Quality of labels: coverage and legality, overlays and updates, agreement of raters, gates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.functions.stats import correlation, kappa


def coverage(sent: DataFrame, got: DataFrame, legal: Column) -> DataFrame:
    """By batch: ids sent, got, missing, extra and illegal, and whether it has to run again."""
    s = sent.select("batch", "id").withColumn("_s", F.lit(1))
    g = got.select("batch", "id", F.coalesce(legal, F.lit(False)).alias("_legal")).withColumn("_g", F.lit(1))
    out = s.join(g, ["batch", "id"], "full").groupBy("batch").agg(
        F.count("_s").alias("sent"), F.count("_g").alias("got"), F.count_if(F.col("_g").isNull()).alias("missing"),
        F.count_if(F.col("_s").isNull()).alias("extra"), F.count_if(~F.col("_legal")).alias("illegal"),
    )
    return out.withColumn("rerun", (F.col("missing") + F.col("extra") + F.col("illegal")) > 0)


def invariants(labels: DataFrame, ids: DataFrame, ranges: dict[str, tuple[int, int]]) -> DataFrame:
    """(check, n_bad) rows: missing and extra ids, repeated ids, values out of range."""
    missing = ids.select("id").join(labels.select("id"), "id", "left_anti").agg(F.lit("missing").alias("check"), F.count(F.lit(1)).alias("n_bad"))
    extra = labels.select("id").join(ids.select("id"), "id", "left_anti").agg(F.lit("extra").alias("check"), F.count(F.lit(1)).alias("n_bad"))
    twice = labels.groupBy("id").count().agg(F.lit("repeated").alias("check"), F.count_if(F.col("count") > 1).alias("n_bad"))
    out = missing.unionByName(extra).unionByName(twice)
    for name, (low, high) in ranges.items():
        bad = F.count_if(F.col(name).isNull() | ~F.col(name).between(low, high)).alias("n_bad")
        out = out.unionByName(labels.agg(F.lit(f"range of {name}").alias("check"), bad))
    return out


def hold(checks: DataFrame) -> None:
    """Raises where a check found something."""
    bad = {r["check"]: r["n_bad"] for r in checks.where("n_bad > 0").collect()}
    if bad:
        raise ValueError(f"invariants are broken: {bad}")


def overlaid(parts: list[DataFrame], key: str = "id", first_wins: bool = False) -> DataFrame:
    """Result sets one over the other: of an id in several, the last set's row, or the first's."""
    both = None
    for k, part in enumerate(parts):
        one = part.withColumn("_set", F.lit(k))
        both = one if both is None else both.unionByName(one)
    last = Window.partitionBy(key).orderBy("_set" if first_wins else F.desc("_set"))
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_set")


def relabelled(labels: DataFrame, relabels: DataFrame, only: Column) -> DataFrame:
    """``label`` overwritten where ``only`` holds and a new one exists; the first one is kept as ``label_first``."""
    new = relabels.select("id", F.col("label").alias("_new"))
    out = labels.join(new, "id", "left").withColumn("label_first", F.col("label"))
    return out.withColumn("label", F.when(F.coalesce(only, F.lit(False)) & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col("label"))).drop("_new")


def kappas(rows: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """Agreement of two yes/no ratings in each class of ``by``; rows that lack one are left out and counted."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    out = rows.groupBy(by).agg(
        F.count_if(both).alias("n"), F.count_if(~both).alias("left_out"), F.count_if(F.col(a) & F.col(b)).alias("_yy"),
        F.count_if(both & F.col(a)).alias("_a"), F.count_if(both & F.col(b)).alias("_b"), F.count_if(both & (F.col(a) == F.col(b))).alias("_same"),
    )
    n = F.nullif(F.col("n"), F.lit(0))
    return out.select(
        by, "n", "left_out", (F.col("_same") / n).alias("exact"), (F.col("_a") / n).alias("rate_a"), (F.col("_b") / n).alias("rate_b"),
        kappa(F.col("_yy"), F.col("_a"), F.col("_b"), F.col("n")).alias("kappa"),
    )


def rating_agreement(a: DataFrame, b: DataFrame, key: str, scales: list[str], flags: list[str] = (), top: int = 4) -> DataFrame:
    """Two passes over the same items, by dimension: exact, within one and top-box agreement, kappa of the top box, its
    rate in each pass, r, and a verdict on kappa. Flags have no within-one and no r."""
    both = a.select(key, *[F.col(c).alias(f"{c}_a") for c in (*scales, *flags)]).join(b.select(key, *[F.col(c).alias(f"{c}_b") for c in (*scales, *flags)]), key)
    scale = lambda c, k: F.col(f"{c}_{k}").cast("double").alias(k)
    rows = [F.struct(F.lit(c).alias("dimension"), F.lit(True).alias("scaled"), scale(c, "a"), scale(c, "b"), (F.col(f"{c}_a") >= top).alias("top_a"), (F.col(f"{c}_b") >= top).alias("top_b")) for c in scales]
    rows += [F.struct(F.lit(c).alias("dimension"), F.lit(False).alias("scaled"), scale(c, "a"), scale(c, "b"), F.col(f"{c}_a").cast("boolean").alias("top_a"), F.col(f"{c}_b").cast("boolean").alias("top_b")) for c in flags]
    known = both.select(F.inline(F.array(*rows))).where("a IS NOT NULL AND b IS NOT NULL")
    x, y, share = F.col("a"), F.col("b"), lambda c: F.avg(c.cast("int"))
    out = known.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("n"), share(x == y).alias("exact"), F.avg(F.when(F.col("scaled"), (F.abs(x - y) <= 1).cast("int"))).alias("within_one"),
        share(F.col("top_a") == F.col("top_b")).alias("top_agree"), F.count_if(F.col("top_a") & F.col("top_b")).alias("_yy"), F.count_if("top_a").alias("_na"), F.count_if("top_b").alias("_nb"),
        correlation(F.when(F.col("scaled"), x), F.when(F.col("scaled"), y)).alias("r"),
    )
    out = out.withColumn("kappa", kappa(F.col("_yy"), F.col("_na"), F.col("_nb"), F.col("n")))
    verdict = F.when(F.col("kappa").isNull(), "unknown").when(F.col("kappa") < 0.4, "flagged").when(F.col("kappa") < 0.6, "moderate").otherwise("good")
    return out.select("dimension", "n", "exact", "within_one", "top_agree", "kappa", (F.col("_na") / F.col("n")).alias("rate_a"), (F.col("_nb") / F.col("n")).alias("rate_b"), "r", verdict.alias("verdict"))


def self_against_cross(self_: DataFrame, cross: DataFrame) -> DataFrame:
    """Kappa of a rater with itself and with another, and what is lost between them."""
    a, b = self_.select("dimension", F.col("kappa").alias("kappa_self")), cross.select("dimension", F.col("kappa").alias("kappa_cross"))
    return a.join(b, "dimension").withColumn("lost", F.col("kappa_self") - F.col("kappa_cross"))


def mapped(labels: DataFrame, column: str, meaning: dict[str, bool | None]) -> DataFrame:
    """``mapped``: what a category of one pass means in terms of another; null where it can't tell, and where unknown."""
    pairs = [x for k, v in meaning.items() if v is not None for x in (F.lit(k), F.lit(v))]
    return labels.withColumn("mapped", F.try_element_at(F.create_map(*pairs), F.col(column)))


def levels(rows: DataFrame, by: str, score: str) -> DataFrame:
    """Counts, shares and the mean of a score by class."""
    counts = rows.where(F.col(score).isNotNull()).groupBy(by, score).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(by)  # over levels, not rows
    n = F.sum("n").over(whole)
    return counts.select(by, score, "n", (F.col("n") / n).alias("share"), (F.sum(F.col(score) * F.col("n")).over(whole) / n).alias("mean"))


def aligned(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Several one-column series (key, value) side by side; keys that any of them lacks are left out."""
    long = None
    for name, part in parts.items():
        one = part.select(key, F.lit(name).alias("_name"), F.col([c for c in part.columns if c != key][0]).cast("double").alias("_value"))
        long = one if long is None else long.unionByName(one)
    out = long.groupBy(key).agg(*[F.max(F.when(F.col("_name") == n, F.col("_value"))).alias(n) for n in parts])
    return out.dropna()


def manifest(df: DataFrame, key: str, expected: DataFrame, **run: str) -> DataFrame:
    """One row on a result: the run's parameters, rows, distinct keys and how many of the expected keys are not there."""
    gaps = expected.select(key).distinct().join(df.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("n_gaps"))
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("n_keys"))
    return one.join(gaps).select(*[F.lit(v).alias(k) for k, v in run.items()], "n_rows", "n_keys", "n_gaps")  # one row each


def weighted_kappa(rows: DataFrame, a: str, b: str, levels: int) -> DataFrame:
    """Quadratic-weighted kappa of two ratings from 0 to levels - 1, with agreement within one and the mean signed difference."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    one = rows.where(x.isNotNull() & y.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.avg((x - y) * (x - y)).alias("seen"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(x * x).alias("xx"), F.avg(y * y).alias("yy"),
        F.avg((F.abs(x - y) <= 1).cast("int")).alias("within_one"), F.avg(x - y).alias("signed"),
    )
    # Chance disagreement of independent ratings is E(x^2) - 2 E(x) E(y) + E(y^2).
    chance = F.col("xx") - 2 * F.col("mx") * F.col("my") + F.col("yy")
    k = F.when(chance > 0, 1 - F.col("seen") / chance).alias("kappa")
    return one.select("n", k, "within_one", "signed", ((F.col("within_one") >= 0.8) & (F.abs("signed") <= 0.3)).alias("passes"))


def gate(measured: DataFrame, value: str, threshold: float, name: str) -> DataFrame:
    """One row: what was measured, what is asked, and whether it passes."""
    return measured.select(F.lit(name).alias("gate"), F.col(value).alias("value"), F.lit(threshold).alias("threshold"), F.coalesce(F.col(value) >= threshold, F.lit(False)).alias("passed"))


def require(verdict: DataFrame) -> None:
    row = verdict.first()
    if row is None or not row["passed"]:
        raise ValueError(f"the gate is shut: {row}")


def correlations(df: DataFrame, left: list[str], right: list[str] | None = None) -> DataFrame:
    """Pearson's r of pairs of columns, all in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(left) for b in (right if right is not None else left[i + 1 :])]
    one = df.agg(*[correlation(F.col(a), F.col(b)).alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])))


def first_component(df: DataFrame, columns: list[str]) -> tuple[float, float]:
    """The first principal component's share of standardised complete rows, and the mean absolute r."""
    complete = df.select(*columns).dropna()
    rows = {(r["a"], r["b"]): r["r"] for r in correlations(complete, columns).collect()}
    m = np.eye(len(columns))
    for i, a in enumerate(columns):
        for j in range(i + 1, len(columns)):
            m[i, j] = m[j, i] = rows[a, columns[j]] or 0.0
    return float(np.linalg.eigvalsh(m)[-1] / len(columns)), float(np.mean([abs(v or 0.0) for v in rows.values()]))
