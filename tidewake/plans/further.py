"""Further analyses on the same frames: profiles, grades, truncation, control by covariates, a logit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.operators import contrast as con
from tidewake.operators import sessions as ses
from tidewake.plans import agreement, contrast, time


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def profile_by_period(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of the features, heads and answers in each half of the month."""
    rows = con.long_form(contrast.frame(spark, sf), contrast.FEATURES, ["day", "y"])
    out = rows.groupBy(F.when(F.col("day") <= 15, "early").otherwise("late").alias("period"), "feature")
    return _rounded(out.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("share"), F.avg("y").alias("rate")), "share", "rate")


def latency_truncation(spark: SparkSession, sf: str) -> DataFrame:
    """How much of all answers shorter windows would keep."""
    us = F.col("response_us") - F.unix_micros("ts")
    answered = time._answers(spark, sf).where("response_us IS NOT NULL").select(us.alias("us"))
    hours = [6, 12, 24, 48, 72]
    one = answered.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("us") <= h * ses.HOUR).alias(f"h{h}") for h in hours])
    rows = [F.struct(F.lit(h).alias("hours"), F.col(f"h{h}").alias("kept"), F.round(F.col(f"h{h}") / F.col("n"), 6).alias("share")) for h in hours]
    return one.select(F.inline(F.array(*rows)))


def finding_grade(spark: SparkSession, sf: str) -> DataFrame:
    """How many of two checks an effect stands: most senders agree with its sign, and so does the late half."""
    rows = contrast._long(spark, sf)
    whole = con.fixed_effect(rows).select("feature", F.signum("b").alias("s"))
    panel = con.sign_panel(rows, 10)
    late = con.fixed_effect(rows.where("day > 15")).select("feature", F.signum("b").alias("s_late"))
    agreeing = F.when(F.coalesce("s", F.lit(1.0)) < 0, F.col("groups") - F.col("positive")).otherwise(F.col("positive"))
    both = whole.join(panel, "feature", "left").join(late, "feature", "left")
    holds = F.coalesce((2 * agreeing > F.col("groups")).cast("int"), F.lit(0)) + F.coalesce((F.col("s") == F.col("s_late")).cast("int"), F.lit(0))
    return both.select("feature", F.when(holds == 2, "strong").when(holds == 1, "mixed").otherwise("weak").alias("grade"))


def explained_share(spark: SparkSession, sf: str) -> DataFrame:
    """Share of an effect that a covariate takes away: one less the ratio of controlled to raw."""
    df = contrast.frame(spark, sf).select("sender", "y", (F.col("channel") == "view").cast("double").alias("is_view"), F.log1p("value").alias("log_value"))
    raw, controlled = (con.fixed_effects(df, c)[0][1] for c in (["is_view"], ["is_view", "log_value"]))
    share = 1 - controlled / raw if raw else None
    return _rounded(spark.createDataFrame([(raw, controlled, share)], "raw double, controlled double, explained double"), "raw", "controlled", "explained")


def relabel_asymmetry(spark: SparkSession, sf: str) -> DataFrame:
    """By class of the first label: how many moved under the update, and where to."""
    both = agreement.conditional_update(spark, sf)
    out = both.groupBy("label_first").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") != F.col("label_first")).alias("moved"))
    return out.withColumn("share", F.round(F.col("moved") / F.col("n"), 6))


def logit_effect(spark: SparkSession, sf: str) -> DataFrame:
    """Logits of the answer on each feature with an effect for each sender; senders without variation are left out."""
    return _rounded(con.logit_effect(contrast._long(spark, sf)), "b", "se", "z")


NAMES = "profile_by_period latency_truncation finding_grade explained_share relabel_asymmetry logit_effect".split()
QUERIES = {n: globals()[n] for n in NAMES}

LOGIT_STEPS = 14


def _newton(k: int) -> str:
    """A step of Newton's from b = 0: scores and weights of groups at b, and what follows from them."""
    return f"""
          u{k} AS (SELECT *, exp(b) AS e, 2 * (k1 + k0) / ((n0 + n1 * exp(b) - (k1 + k0) * (1 + exp(b))) + sqrt((n0 + n1 * exp(b) - (k1 + k0) * (1 + exp(b))) ** 2
                  + 4 * exp(b) * (n1 + n0 - k1 - k0) * (k1 + k0))) AS u FROM cells JOIN b{k} USING (feature)),
          p{k} AS (SELECT *, u * e / (1 + u * e) AS p1, u / (1 + u) AS p0 FROM u{k}),
          s{k} AS (SELECT feature, b, n1 + n0 AS n, k1 - n1 * p1 AS score, n1 * p1 * (1 - p1) * n0 * p0 * (1 - p0) / (n1 * p1 * (1 - p1) + n0 * p0 * (1 - p0)) AS info FROM p{k}),
          b{k + 1} AS (SELECT feature, first(b) + sum(score) / sum(info) AS b FROM s{k} GROUP BY 1)"""


SQL = {
    "profile_by_period": contrast._FRAME
    + f""", long AS ({contrast._sql_long()})
          SELECT CASE WHEN day <= 15 THEN 'early' ELSE 'late' END AS period, feature, count(*) AS n, round(avg(x), 6) AS share, round(avg(y), 6) AS rate FROM long GROUP BY 1, 2""",
    "latency_truncation": "WITH"
    + time._LOG
    + """ SELECT CAST(h AS INTEGER) AS hours, count(*) FILTER (WHERE response_us - us <= h * 3600000000) AS kept,
                 round(count(*) FILTER (WHERE response_us - us <= h * 3600000000) / count(*), 6) AS share
          FROM found, (SELECT unnest([6, 12, 24, 48, 72]) AS h) WHERE response_us IS NOT NULL GROUP BY 1""",
    "finding_grade": contrast._FRAME
    + f", long AS ({contrast._sql_long()}), late AS (SELECT * FROM long WHERE day > 15),"
    + contrast._fe("long", "w")
    + ","
    + contrast._fe("late", "l")
    + f""", arms AS (SELECT feature, sender, {contrast._ARMS} FROM long GROUP BY 1, 2),
          panel AS (SELECT feature, count(*) AS g, count(*) FILTER (WHERE k1 / n1 - k0 / n0 > 0) AS p FROM arms WHERE n1 >= 10 AND n0 >= 10 GROUP BY 1),
          held AS (
            SELECT w.feature, coalesce(CAST(2 * CASE WHEN coalesce(sign(w.b), 1) < 0 THEN g - p ELSE p END > g AS INTEGER), 0)
                   + coalesce(CAST(sign(w.b) = sign(l.b) AS INTEGER), 0) AS n FROM w LEFT JOIN panel USING (feature) LEFT JOIN l USING (feature))
          SELECT feature, CASE n WHEN 2 THEN 'strong' WHEN 1 THEN 'mixed' ELSE 'weak' END AS grade FROM held""",
    "explained_share": contrast._FRAME
    + """, v AS (SELECT sender, CAST(y AS DOUBLE) AS y, CASE WHEN channel = 'view' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p, ln(1 + value) AS q FROM frame),
          d AS (SELECT y - avg(y) OVER w AS y, p - avg(p) OVER w AS p, q - avg(q) OVER w AS q FROM v WINDOW w AS (PARTITION BY sender)),
          s AS (SELECT sum(p * p) AS pp, sum(p * q) AS pq, sum(q * q) AS qq, sum(p * y) AS py, sum(q * y) AS qy FROM d),
          b AS (SELECT py / pp AS raw, (qq * py - pq * qy) / (pp * qq - pq * pq) AS c FROM s)
          SELECT round(raw, 6) AS raw, round(c, 6) AS controlled, round(1 - c / raw, 6) AS explained FROM b""",
    "relabel_asymmetry": f"""WITH u AS ({agreement._CONDITIONAL})
        SELECT label_first, count(*) AS n, count(*) FILTER (WHERE label <> label_first) AS moved, round(count(*) FILTER (WHERE label <> label_first) / count(*), 6) AS share FROM u GROUP BY 1""",
    "logit_effect": contrast._FRAME
    + f""", long AS ({contrast._sql_long()}), cells AS (
            SELECT feature, sender, CAST(sum(x) AS DOUBLE) AS n1, CAST(sum(x * y) AS DOUBLE) AS k1, CAST(count(*) - sum(x) AS DOUBLE) AS n0, CAST(sum(y) - sum(x * y) AS DOUBLE) AS k0
            FROM long GROUP BY 1, 2 HAVING sum(y) > 0 AND sum(y) < count(*)),
          b0 AS (SELECT feature, 0.0::DOUBLE AS b FROM cells GROUP BY 1),"""
    + ",".join(_newton(k) for k in range(LOGIT_STEPS + 1))
    + f""" SELECT feature, round(first(b), 6) AS b, round(sqrt(sum(score * score) * (count(*) / (count(*) - 1)) * ((sum(n) - 1) / (sum(n) - 1 - count(*)))) / sum(info), 6) AS se,
                 round(first(b) / (sqrt(sum(score * score) * (count(*) / (count(*) - 1)) * ((sum(n) - 1) / (sum(n) - 1 - count(*)))) / sum(info)), 6) AS z,
                 CAST(sum(n) AS BIGINT) AS n, count(*) AS groups FROM s{LOGIT_STEPS} GROUP BY 1""",
}
