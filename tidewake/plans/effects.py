"""Queries on how far effects reach: doses, interactions, other gaps, shorter outcomes, cohorts and timing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.operators import attribution as att
from tidewake.operators import contrast as con
from tidewake.operators import sessions as ses
from tidewake.operators.quantiles import with_quantiles
from tidewake.plans import contrast, time
from tidewake.sources.tables import responses, touches

HOURS = (12, 24, 36)
STABLE = ("is view", "high value", "morning")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def burst_effect(spark: SparkSession, sf: str) -> DataFrame:
    """The effect of each doubling of a sender's heads on one day, alone and next to a feature of the head."""
    f = contrast.frame(spark, sf).select("sender", "y", F.ln("same_day").alias("log_volume"), (F.col("channel") == "view").cast("double").alias("is_view"))
    two = F.ln(F.lit(2.0))
    alone = con.fixed_effect(f.select("sender", "y", F.col("log_volume").alias("x"), F.lit("alone").alias("feature"))).select("feature", (F.col("b") * two).alias("per_doubling"), (F.col("se") * two).alias("se"))
    _, b, se = con.fixed_effects(f, ["log_volume", "is_view"])[0]
    both = spark.createDataFrame([("with feature", b, se)], "feature string, b double, se double").select("feature", (F.col("b") * two).alias("per_doubling"), (F.col("se") * two).alias("se"))
    return _rounded(alone.unionByName(both), "per_doubling", "se")


def difference_of_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Rates of the four cells of two flags, the flag's difference in each half, and the difference of those."""
    view, morning, y = F.col("channel") == "view", F.col("hour") < 12, F.col("y")
    rate = lambda a, b: F.avg(F.when((view == a) & (morning == b), y))
    one = contrast.frame(spark, sf).agg(*[rate(F.lit(a), F.lit(b)).alias(f"r{int(a)}{int(b)}") for a in (True, False) for b in (True, False)])
    one = one.withColumns({"in_morning": F.col("r11") - F.col("r01"), "later": F.col("r10") - F.col("r00")}).withColumn("difference", F.col("in_morning") - F.col("later"))
    return _rounded(one, *one.columns)


def profile_medians(spark: SparkSession, sf: str) -> DataFrame:
    """Medians and daily volumes of the heads in each half of the month."""
    f = contrast.frame(spark, sf).select("day", "value", "same_day", F.when(F.col("day") <= 15, "early").otherwise("late").alias("period"))
    out = f.groupBy("period").agg((F.count(F.lit(1)) / F.countDistinct("day")).alias("per_day"))
    out = with_quantiles(out, f, ["period"], {"median_value": (F.col("value"), 0.5), "median_volume": (F.col("same_day"), 0.5)})
    return _rounded(out, "median_value", "median_volume", "per_day")


def _at_gap(spark: SparkSession, sf: str, hours: int) -> DataFrame:
    heads = ses.session_heads(ses.sessionized(touches(spark, sf), hours * ses.HOUR))
    found = att.attributed(heads, att.candidates(heads, responses(spark, sf), time.ANSWER, "entity", "entity", 0))
    f = found.select("sender", "channel", "value", F.hour("ts").alias("hour"), F.col("response_id").isNotNull().cast("int").alias("y"))
    return con.fixed_effect(con.long_form(f, {k: contrast.FEATURES[k] for k in STABLE}, ["sender", "y"]))


def gap_stability(spark: SparkSession, sf: str) -> DataFrame:
    """Whether effects keep their sign and their significance when sessions are cut at other gaps."""
    out = None
    for hours in HOURS:
        one = _at_gap(spark, sf, hours).select("feature", F.lit(hours).alias("gap_hours"), "b", "z")
        out = one if out is None else out.unionByName(one)
    return _rounded(con.stability(out, "gap_hours"), "least_b", "greatest_b")


def latency_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles of the time to an answer in days, and the share that a one-day window keeps."""
    found, days = time.latencies(spark, sf), F.col("days")
    out = found.groupBy("channel").agg(F.avg((days <= 1).cast("int")).alias("within_a_day"))
    out = with_quantiles(out, found, ["channel"], {f"q{int(q * 100)}": (days, q) for q in (0.5, 0.9, 0.99)})
    return _rounded(out, "q50", "q90", "q99", "within_a_day")


def cohorts(spark: SparkSession, sf: str) -> DataFrame:
    """Senders sorted into cohorts by what is seen of them, with rates of each cohort and of all."""
    f = contrast.frame(spark, sf)
    kinds = con.sender_cohorts(f, 30, F.col("channel") == "view", 0.5)
    rows = f.join(kinds, "sender")
    parts = rows.groupBy("cohort").agg(F.countDistinct("sender").alias("senders"), F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate"))
    pooled = rows.where("cohort != 'too few'").agg(F.lit("pooled").alias("cohort"), F.countDistinct("sender").alias("senders"), F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate"))
    return _rounded(parts.unionByName(pooled), "rate")


def interaction_flips(spark: SparkSession, sf: str) -> DataFrame:
    """Each feature's effect in the two channels, their difference and its z, and whether sign or significance flips."""
    by = con.fixed_effect(contrast._long(spark, sf).where("feature != 'is view'"), "feature", "channel")
    return _rounded(con.flips(by, "channel", "view", "click"), "b_first", "b_second", "difference", "z")


def followup_timing(spark: SparkSession, sf: str) -> DataFrame:
    """Answer rates by whole days since the entity's session before; days with too few heads are left out."""
    heads = contrast.frame(spark, sf).join(time._heads(spark, sf).select("event_id", "gap_us"), "event_id").where("gap_us IS NOT NULL")
    days = F.least(F.lit(10), F.floor(F.col("gap_us") / ses.DAY)).cast("int")
    out = heads.groupBy(days.alias("days")).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate")).where("n >= 30")
    return _rounded(out, "rate")


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """The frame with the outcome of three days and that of one."""
    soon = (F.col("response_us") - F.unix_micros("ts") <= ses.DAY).cast("int")
    return contrast.frame(spark, sf, "response_us").withColumn("y_day", F.coalesce(soon, F.lit(0))).drop("response_us")


def shorter_outcome(spark: SparkSession, sf: str) -> DataFrame:
    """The effects on an answer within one day, beside those within three."""
    rows = con.long_form(_outcomes(spark, sf), contrast.FEATURES, ["sender", "y", "y_day"])
    long_, short = con.fixed_effect(rows).select("feature", "b", "se"), con.fixed_effect(rows, y="y_day").select("feature", F.col("b").alias("b_day"), F.col("se").alias("se_day"))
    return _rounded(long_.join(short, "feature"), "b", "se", "b_day", "se_day")


def placebo_battery(spark: SparkSession, sf: str) -> DataFrame:
    """Features that look significant when outcomes are dealt anew within senders: seeds times outcomes."""
    both = ("y", "y_day")
    dealt = con.permuted(_outcomes(spark, sf), ["0", "1"], outcomes=both)
    rows = con.long_form(dealt, contrast.FEATURES, ["seed", "sender", *both])
    rows = rows.select("seed", "sender", "feature", "x", F.inline(F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).alias("y")) for o in both])))
    hit = F.abs("z") >= 1.96
    out = con.fixed_effect(rows, "seed", "outcome", "feature").groupBy("outcome").agg(F.count(hit).alias("tests"), F.count_if(hit).alias("hits"))
    return out.withColumn("share", F.round(F.col("hits") / F.col("tests"), 6))


NAMES = (
    "burst_effect difference_of_differences profile_medians gap_stability latency_quantiles cohorts interaction_flips followup_timing shorter_outcome placebo_battery"
).split()
QUERIES = {n: globals()[n] for n in NAMES}

_FRAME = contrast._FRAME
_BOTH = _FRAME + ", pair AS (SELECT frame.*, CASE WHEN response_us - us <= 86400000000 THEN 1 ELSE 0 END AS y_day FROM frame JOIN (SELECT event_id, us, response_us FROM found) USING (event_id))"


def _gap_sql(hours: int) -> str:
    h = f"g{hours}"
    return f"""
    {h}n AS (
        SELECT *, CAST(sum(CASE WHEN gap_us IS NULL OR gap_us >= {hours} * 3600000000 THEN 1 ELSE 0 END)
                  OVER (PARTITION BY entity ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM gapped),
    {h}s AS (SELECT *, row_number() OVER (PARTITION BY entity, session_no ORDER BY ts, event_id) AS touch_no FROM {h}n),
    {h}h AS (SELECT *, lead(us) OVER (PARTITION BY entity ORDER BY session_no) AS next_us FROM {h}s WHERE touch_no = 1),
    {h}f AS (
        SELECT h.sender, h.channel, e.value, hour(h.ts) AS hour, CASE WHEN EXISTS (
            SELECT 1 FROM answers a WHERE a.entity = h.entity AND a.us > h.us AND a.us <= least(h.us + 259200000000, coalesce(h.next_us, h.us + 259200000000))
        ) THEN 1 ELSE 0 END AS y FROM {h}h h JOIN events e USING (event_id)),
    {h}l AS ({contrast._sql_long(h + "f", {k: contrast.FEATURES[k] for k in STABLE})}),
    {contrast._fe(h + "l", h + "e")}"""


SQL = {
    "burst_effect": _FRAME
    + ", la AS (SELECT 'alone' AS feature, sender, ln(same_day) AS x, y FROM frame),"
    + contrast._fe("la", "fit")
    + """, v AS (SELECT sender, CAST(y AS DOUBLE) AS y, ln(same_day) AS p, CAST(channel = 'view' AS DOUBLE) AS q FROM frame),
          d AS (SELECT sender, y - avg(y) OVER w AS y, p - avg(p) OVER w AS p, q - avg(q) OVER w AS q FROM v WINDOW w AS (PARTITION BY sender)),
          s AS (SELECT sum(p * p) AS pp, sum(p * q) AS pq, sum(q * q) AS qq, sum(p * y) AS py, sum(q * y) AS qy, count(*) AS n, count(DISTINCT sender) AS g FROM d),
          b AS (SELECT *, pp * qq - pq * pq AS det, (qq * py - pq * qy) / (pp * qq - pq * pq) AS b1, (pp * qy - pq * py) / (pp * qq - pq * pq) AS b2 FROM s),
          u AS (SELECT sender, sum(p * (y - b1 * p - b2 * q)) AS u1, sum(q * (y - b1 * p - b2 * q)) AS u2 FROM d, b GROUP BY 1),
          m AS (SELECT sum(u1 * u1) AS m11, sum(u1 * u2) AS m12, sum(u2 * u2) AS m22 FROM u)
          SELECT feature, round(b * ln(2), 6) AS per_doubling, round(se * ln(2), 6) AS se FROM fit
          UNION ALL SELECT 'with feature', round(b1 * ln(2), 6),
              round(sqrt(g / (g - 1) * (n - 1) / (n - 2 - g) * (qq * qq * m11 - 2 * qq * pq * m12 + pq * pq * m22)) / det * ln(2), 6) FROM b, m""",
    "difference_of_differences": _FRAME
    + """, r AS (SELECT avg(y) FILTER (WHERE channel = 'view' AND hour < 12) AS r11, avg(y) FILTER (WHERE channel = 'view' AND hour >= 12) AS r10,
                   avg(y) FILTER (WHERE channel <> 'view' AND hour < 12) AS r01, avg(y) FILTER (WHERE channel <> 'view' AND hour >= 12) AS r00 FROM frame)
          SELECT round(r11, 6) AS r11, round(r10, 6) AS r10, round(r01, 6) AS r01, round(r00, 6) AS r00, round(r11 - r01, 6) AS in_morning, round(r10 - r00, 6) AS later,
                 round(r11 - r01 - (r10 - r00), 6) AS difference FROM r""",
    "profile_medians": _FRAME
    + """ SELECT CASE WHEN day <= 15 THEN 'early' ELSE 'late' END AS period, round(median(value), 6) AS median_value, round(median(CAST(same_day AS DOUBLE)), 6) AS median_volume,
                 round(count(*) / count(DISTINCT day), 6) AS per_day FROM frame GROUP BY 1""",
    "gap_stability": "WITH"
    + time._LOG
    + ","
    + ",".join(map(_gap_sql, HOURS))
    + ", e AS ("
    + " UNION ALL ".join(f"SELECT feature, b, CASE WHEN se > 0 THEN b / se END AS z FROM g{h}e" for h in HOURS)
    + """) SELECT feature, count(b) AS n_fits, round(min(b), 6) AS least_b, round(max(b), 6) AS greatest_b, count(DISTINCT sign(b)) = 1 AS same_sign,
           count(DISTINCT abs(z) >= 1.96) = 1 AS same_significance FROM e GROUP BY 1""",
    "latency_quantiles": "WITH"
    + time._LOG
    + """, l AS (SELECT channel, (response_us - us) / 86400000000 AS d FROM found WHERE response_us IS NOT NULL)
          SELECT channel, round(quantile_cont(d, 0.5), 6) AS q50, round(quantile_cont(d, 0.9), 6) AS q90, round(quantile_cont(d, 0.99), 6) AS q99,
                 round(avg(CASE WHEN d <= 1 THEN 1.0 ELSE 0.0 END), 6) AS within_a_day FROM l GROUP BY 1""",
    "cohorts": _FRAME
    + """, k AS (SELECT sender, CASE WHEN count(*) < 30 THEN 'too few' WHEN avg(CAST(channel = 'view' AS INTEGER)) >= 0.5 THEN 'mostly' ELSE 'partly' END AS cohort FROM frame GROUP BY 1),
          r AS (SELECT * FROM frame JOIN k USING (sender))
          SELECT cohort, count(DISTINCT sender) AS senders, count(*) AS n, round(avg(y), 6) AS rate FROM r GROUP BY 1
          UNION ALL SELECT 'pooled', count(DISTINCT sender), count(*), round(avg(y), 6) FROM r WHERE cohort <> 'too few'""",
    "interaction_flips": _FRAME
    + f", long AS (SELECT * FROM ({contrast._sql_long()}) WHERE feature <> 'is view'),"
    + contrast._fe("long", "fit", by="feature, channel")
    + """, t AS (SELECT f.feature, f.b AS b1, s.b AS b2, f.se AS s1, s.se AS s2 FROM fit f JOIN fit s ON f.feature = s.feature AND f.channel = 'view' AND s.channel = 'click')
          SELECT feature, round(b1, 6) AS b_first, round(b2, 6) AS b_second, round(b1 - b2, 6) AS difference, round((b1 - b2) / nullif(sqrt(s1 * s1 + s2 * s2), 0), 6) AS z, sign(b1) <> sign(b2) AS sign_flips,
                 abs((b1 - b2) / nullif(sqrt(s1 * s1 + s2 * s2), 0)) >= 1.96 AS significant FROM t""",
    "followup_timing": _FRAME
    + """ SELECT CAST(least(10, gap_us // 86400000000) AS INTEGER) AS days, count(*) AS n, round(avg(y), 6) AS rate FROM frame JOIN (SELECT event_id, gap_us FROM heads) USING (event_id)
          WHERE gap_us IS NOT NULL GROUP BY 1 HAVING count(*) >= 30""",
    "shorter_outcome": _BOTH
    + f", long AS ({contrast._sql_long('pair')}), short AS (SELECT * REPLACE (y_day AS y) FROM long),"
    + contrast._fe("long", "f1")
    + ","
    + contrast._fe("short", "f2")
    + " SELECT feature, round(f1.b, 6) AS b, round(f1.se, 6) AS se, round(f2.b, 6) AS b_day, round(f2.se, 6) AS se_day FROM f1 JOIN f2 USING (feature)",
    "placebo_battery": _BOTH
    + ", "
    + ",".join(
        f"""
          {o}{k}d AS (
            SELECT a.* EXCLUDE (y, y_day, r), b.y FROM (SELECT *, row_number() OVER (PARTITION BY sender ORDER BY md5(event_id || '#own'), event_id) AS r FROM pair) a
            JOIN (SELECT sender, {o} AS y, row_number() OVER (PARTITION BY sender ORDER BY md5(event_id || '#{k}'), event_id) AS r FROM pair) b USING (sender, r)),
          {o}{k}l AS ({contrast._sql_long(f"{o}{k}d")}),"""
        + contrast._fe(f"{o}{k}l", f"{o}{k}p")
        for o in ("y", "y_day")
        for k in range(2)
    )
    + ", hits AS ("
    + " UNION ALL ".join(f"SELECT '{o}' AS outcome, CASE WHEN se > 0 THEN abs(b / se) >= 1.96 END AS hit FROM {o}{k}p" for o in ("y", "y_day") for k in range(2))
    + ") SELECT outcome, count(hit) AS tests, count(*) FILTER (WHERE hit) AS hits, round(count(*) FILTER (WHERE hit) / count(hit), 6) AS share FROM hits GROUP BY 1",
}
