"""Queries of the contrast engine, on session heads of the event log.

The outcome is an answer within three days; the sender is the group of fixed effects and the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake.functions import stats
from tidewake.functions.stats import benjamini_hochberg, detectable, normal_tail
from tidewake.operators import contrast as con
from tidewake.operators import sessions as ses
from tidewake.plans import time
from tidewake.sources.scratch import written

FEATURES = {
    "is view": "channel = 'view'",
    "high value": "value > 12",
    "low value": "value <= 5",
    "morning": "hour < 12",
    "early month": "day <= 15",
    "busy day": "same_day >= 3",
    "very high value": "value > 30",
}
FAMILY = {"is view": "content", "high value": "content", "low value": "content", "very high value": "content"}
BUCKETS = ([0.0, 2.0, 5.0, 10.0, 20.0, 1e9], ["(0,2]", "(2,5]", "(5,10]", "(10,20]", "over 20"])


def frame(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    """One row per session head: event_id, sender, y, what the features read, and more columns of the attribution."""
    heads = written(time._answers(spark, sf).select(
        "event_id", "entity", "sender", "channel", "value", "ts", F.hour("ts").alias("hour"), F.dayofmonth("ts").alias("day"),
        F.col("response_id").isNotNull().cast("int").alias("y"), F.to_date("ts").alias("_date"), *more,
    ), "frame")
    # Counted and joined, so that a sender's day is no window of one task.
    volume = heads.groupBy(F.col("sender").alias("_sender"), F.col("_date").alias("_day")).agg(F.count(F.lit(1)).alias("same_day"))
    found = heads.join(volume, F.col("sender").eqNullSafe(F.col("_sender")) & F.col("_date").eqNullSafe(F.col("_day")))
    return found.drop("_sender", "_day", "_date")


def _long(spark: SparkSession, sf: str) -> DataFrame:
    return con.long_form(frame(spark, sf), FEATURES, ["event_id", "sender", "entity", "channel", "day", "y"])


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def two_arm_contrast(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(con.two_arms(_long(spark, sf)), "rate1", "rate0", "gap", "low", "high")


def newcombe_gap(spark: SparkSession, sf: str) -> DataFrame:
    out = con.two_arms(_long(spark, sf), "feature", "channel").where("n1 > 0 AND n0 > 0")
    return _rounded(out.select("feature", "channel", "gap", "low", "high"), "gap", "low", "high")


def wilson_intervals(spark: SparkSession, sf: str) -> DataFrame:
    from tidewake.functions.stats import wilson

    per = frame(spark, sf).groupBy("sender").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return _rounded(per.select("sender", "n", "k", low.alias("low"), high.alias("high")), "low", "high")


def fe_effect(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(con.fixed_effect(_long(spark, sf)), "b", "se", "z")


def fe_effect_covariates(spark: SparkSession, sf: str) -> DataFrame:
    df = frame(spark, sf).select("sender", "y", (F.col("channel") == "view").cast("double").alias("is_view"), F.log1p("value").alias("log_value"))
    return _rounded(spark.createDataFrame(con.fixed_effects(df, ["is_view", "log_value"]), "term string, b double, se double"), "b", "se")


def fe_interaction(spark: SparkSession, sf: str) -> DataFrame:
    df = frame(spark, sf).select("sender", "y", (F.col("channel") == "view").cast("double").alias("is_view"), (F.col("hour") < 12).cast("double").alias("morning"))
    df = df.withColumn("both", F.col("is_view") * F.col("morning"))
    return _rounded(spark.createDataFrame(con.fixed_effects(df, ["is_view", "morning", "both"]), "term string, b double, se double"), "b", "se")


def within_group_sign(spark: SparkSession, sf: str) -> DataFrame:
    return con.sign_panel(_long(spark, sf), 10)


def bh_families(spark: SparkSession, sf: str) -> DataFrame:
    fitted = con.fixed_effect(_long(spark, sf))
    family = F.lit("time")
    for name, kind in FAMILY.items():
        family = F.when(F.col("feature") == name, kind).otherwise(family)
    tested = fitted.select("feature", family.alias("family"), normal_tail(F.col("z")).alias("p"))
    out = benjamini_hochberg(tested, "p", "family")
    return out.select("feature", "family", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"), (F.col("q") < 0.05).alias("significant"))


def bucket_rates(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(con.bucket_rates(frame(spark, sf), "value", *BUCKETS), "rate")


def burst_volume(spark: SparkSession, sf: str) -> DataFrame:
    """Answer rates by a sender's heads on the same day, and the mean of the log of those."""
    out = frame(spark, sf).groupBy("same_day").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate"), F.avg(F.ln("same_day")).alias("log_volume"))
    return _rounded(out, "rate", "log_volume")


def placebo_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Share of features that look significant when outcomes are dealt anew within senders, over five seeds."""
    dealt = con.permuted(frame(spark, sf), [str(k) for k in range(5)])
    fits = con.fixed_effect(con.long_form(dealt, FEATURES, ["seed", "sender", "y"]), "seed", "feature")
    hit = F.abs("z") >= 1.96
    return fits.groupBy(F.col("seed").cast("int").alias("seed")).agg(F.count(hit).alias("tests"), F.count_if(hit).alias("hits"))


def overdispersion(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(con.overdispersion(frame(spark, sf), "entity", 5), "zero_seen", "zero_expected", "chi2", "ratio")


def two_by_two(spark: SparkSession, sf: str) -> DataFrame:
    view, morning = F.col("channel") == "view", F.col("hour") < 12
    cells = frame(spark, sf).groupBy(view.alias("is_view"), morning.alias("morning")).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate"))
    return _rounded(cells, "rate")


def mde_table(spark: SparkSession, sf: str) -> DataFrame:
    arms = con.two_arms(_long(spark, sf))
    return arms.select("feature", "n1", "n0", F.when((F.col("n1") > 0) & (F.col("n0") > 0), F.round(detectable(F.col("n1"), F.col("n0"), (F.col("k1") + F.col("k0")) / (F.col("n1") + F.col("n0"))), 6)).alias("mde"))


def holdout_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _long(spark, sf)
    early, late = rows.where("day <= 15"), rows.where("day > 15")
    held = con.fixed_effect(late).join(con.two_arms(late).select("feature", "n1"), "feature")
    return _rounded(con.verdicts(con.fixed_effect(early), held, 0.03, 30), "b_train", "b_held")


def robustness_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The effects with other clusters, and with one head for each entity: one frame, each of its rows in every
    specification that takes it."""
    first = F.col("event_id") == F.min("event_id").over(Window.partitionBy("entity"))
    specs = [("sender", "sender", F.lit(True)), ("entity clusters", "entity", F.lit(True)), ("one each", "sender", F.col("_first"))]
    each = F.inline(F.array(*[F.struct(F.lit(n).alias("spec"), F.col(c).cast("long").alias("cluster"), t.alias("taken")) for n, c, t in specs]))
    rows = con.long_form(frame(spark, sf).withColumn("_first", first), FEATURES, ["sender", "entity", "y", "_first"])
    rows = rows.select("feature", "x", "y", "sender", each).where("taken")
    return _rounded(con.fixed_effect(rows, "spec", "feature", cluster="cluster").select("spec", "feature", "b", "se"), "b", "se")


def flag_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Of the rows with one feature, the share that also have another."""
    f = frame(spark, sf).select(*[F.coalesce(F.expr(e), F.lit(False)).cast("int").alias(n) for n, e in FEATURES.items()])
    names = list(FEATURES)
    one = f.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for a in names for b in names])
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("both"), F.col(f"`{a}|{a}`").alias("n")) for a in names for b in names if a != b])
    return one.select(F.inline(pairs)).select("a", "b", "both", "n", F.when(F.col("n") > 0, F.round(F.col("both") / F.col("n"), 6)).alias("share"))


def leave_largest_out(spark: SparkSession, sf: str) -> DataFrame:
    f = frame(spark, sf)
    sizes = f.groupBy("sender").count()
    largest = sizes.orderBy(F.desc("count"), "sender").limit(1).select("sender")
    rest = f.join(F.broadcast(largest), "sender", "left_anti")
    return _rounded(con.fixed_effect(con.long_form(rest, FEATURES, ["sender", "y"])), "b", "se", "z")


def route_interactions(spark: SparkSession, sf: str) -> DataFrame:
    """For each feature, its effect in each channel: signs that flip show as different ones."""
    return _rounded(con.fixed_effect(_long(spark, sf).where("feature != 'is view'"), "feature", "channel").select("feature", "channel", "b", "se"), "b", "se")


def gap_robustness(spark: SparkSession, sf: str) -> DataFrame:
    """Raw gaps of the features when sessions are cut at other gaps."""
    from tidewake.operators import attribution as att
    from tidewake.sources.tables import responses, touches

    out = None
    for hours in (12, 24, 36):
        heads = ses.session_heads(ses.sessionized(touches(spark, sf), hours * ses.HOUR))
        found = att.attributed(heads, att.candidates(heads, responses(spark, sf), time.ANSWER, "entity", "entity", 0))
        f = found.select("channel", "value", F.hour("ts").alias("hour"), F.col("response_id").isNotNull().cast("int").alias("y"))
        rows = con.long_form(f, {k: FEATURES[k] for k in ("is view", "high value", "morning")}, ["y"])
        one = con.two_arms(rows).select(F.lit(hours).alias("gap_hours"), "feature", "n1", "n0", "gap")
        out = one if out is None else out.unionByName(one)
    return _rounded(out, "gap")


NAMES = (
    "two_arm_contrast newcombe_gap wilson_intervals fe_effect fe_effect_covariates fe_interaction within_group_sign bh_families bucket_rates "
    "burst_volume placebo_rate overdispersion two_by_two mde_table holdout_verdicts robustness_grid flag_overlap leave_largest_out "
    "route_interactions gap_robustness"
).split()
QUERIES = {n: globals()[n] for n in NAMES}

_FRAME = (
    "WITH"
    + time._LOG
    + """, frame AS (
        SELECT f.event_id, f.entity, f.sender, f.channel, e.value, f.ts, hour(f.ts) AS hour, day(f.ts) AS day,
               CASE WHEN response_id IS NOT NULL THEN 1 ELSE 0 END AS y, count(*) OVER (PARTITION BY f.sender, CAST(f.ts AS DATE)) AS same_day
        FROM found f JOIN events e USING (event_id))"""
)


def _sql_long(frame: str = "frame", features: dict[str, str] = FEATURES) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS feature, CASE WHEN {e} THEN 1 ELSE 0 END AS x, * FROM {frame}" for n, e in features.items())


_ARMS = """count(*) FILTER (WHERE x = 1) AS n1, count(*) FILTER (WHERE x = 1 AND y = 1) AS k1,
           count(*) FILTER (WHERE x = 0) AS n0, count(*) FILTER (WHERE x = 0 AND y = 1) AS k0"""


def _wilson(k: str, n: str, sign: str) -> str:
    return f"(({k} / {n} + 3.8416 / (2.0 * {n})) {sign} 1.96 * sqrt(({k} / {n}) * (1 - {k} / {n}) / {n} + 3.8416 / (4.0 * {n} * {n}))) / (1 + 3.8416 / {n})"


_GAP = f"""
    limits AS (
        SELECT *, n1 > 0 AND n0 > 0 AS ok, CASE WHEN n1 > 0 THEN k1 / n1 END AS p1, CASE WHEN n0 > 0 THEN k0 / n0 END AS p0,
               CASE WHEN n1 > 0 THEN greatest(0, {_wilson("k1", "n1", "-")}) END AS l1, CASE WHEN n1 > 0 THEN least(1, {_wilson("k1", "n1", "+")}) END AS u1,
               CASE WHEN n0 > 0 THEN greatest(0, {_wilson("k0", "n0", "-")}) END AS l0, CASE WHEN n0 > 0 THEN least(1, {_wilson("k0", "n0", "+")}) END AS u0
        FROM arms),
    gaps AS (
        SELECT *, p1 - p0 AS gap, p1 - p0 - sqrt((p1 - l1) * (p1 - l1) + (u0 - p0) * (u0 - p0)) AS low,
               p1 - p0 + sqrt((u1 - p1) * (u1 - p1) + (p0 - l0) * (p0 - l0)) AS high FROM limits)"""


def _fe(rows: str, tag: str, by: str = "feature", cluster: str = "sender") -> str:
    return f"""
    {tag}_d AS (
        SELECT {by}, sender AS g, {cluster} AS c, x - avg(x) OVER (PARTITION BY {by}, sender) AS dx, y - avg(y) OVER (PARTITION BY {by}, sender) AS dy FROM {rows}),
    {tag}_c AS (SELECT {by}, c, sum(dx * dy) AS xy, sum(dx * dx) AS xx, count(*) AS n FROM {tag}_d GROUP BY ALL),
    {tag}_b AS (SELECT {by}, sum(xy) / nullif(sum(xx), 0) AS b, sum(xx) AS sxx, sum(n) AS n, count(*) AS cl FROM {tag}_c GROUP BY ALL),
    {tag}_g AS (SELECT {by}, count(DISTINCT g) AS s FROM {tag}_d GROUP BY ALL),
    {tag}_u AS (SELECT {by}, sum((xy - b * xx) * (xy - b * xx)) AS uu FROM {tag}_c JOIN {tag}_b USING ({by}) GROUP BY ALL),
    {tag}_e AS (
        SELECT *, cl > 1 AND s > 1 AND sxx > 1e-12 AND n > s + 1 AS ok FROM {tag}_b JOIN {tag}_g USING ({by}) JOIN {tag}_u USING ({by})),
    {tag} AS (
        SELECT {by}, CASE WHEN ok THEN b END AS b, CASE WHEN ok THEN sqrt(cl / (cl - 1) * ((n - 1) / (n - 1 - s)) * uu) / sxx END AS se FROM {tag}_e)"""


def _sql_ratio(t: str, tables: tuple[tuple[float, ...], tuple[float, ...]]) -> str:
    above, below = tables
    powers = [f"pow({t}, {k})" for k in range(len(below) + 1)]
    numerator = [above[-2], *reversed(above[:-2]), above[-1]]
    denominator = [*reversed(below), 1.0]
    sums = [" + ".join(f"{c!r}::DOUBLE * {p}" for c, p in zip(cs, powers, strict=True)) for cs in (numerator, denominator)]
    return f"(({sums[0]}) / ({sums[1]}))"


def _sql_erfc() -> str:
    far = f"exp(-x * x) / x * (1 / sqrt(pi()) - {_sql_ratio('(1 / (x * x))', stats.ERFC_LARGE)} / (x * x))"
    return f"CASE WHEN x <= 0.46875 THEN 1 - x * {_sql_ratio('(x * x)', stats.ERF_SMALL)} WHEN x <= 4 THEN exp(-x * x) * {_sql_ratio('x', stats.ERFC_MIDDLE)} ELSE {far} END"


_FAMILY = "CASE WHEN feature IN ('is view', 'high value', 'low value', 'very high value') THEN 'content' ELSE 'time' END"


def _alt_sessions(hours: int) -> str:
    h = f"h{hours}"
    return f"""
    {h}n AS (
        SELECT *, CAST(sum(CASE WHEN gap_us IS NULL OR gap_us >= {hours} * 3600000000 THEN 1 ELSE 0 END)
                  OVER (PARTITION BY entity ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM gapped),
    {h}s AS (SELECT *, row_number() OVER (PARTITION BY entity, session_no ORDER BY ts, event_id) AS touch_no FROM {h}n),
    {h}h AS (SELECT *, lead(us) OVER (PARTITION BY entity ORDER BY session_no) AS next_us FROM {h}s WHERE touch_no = 1),
    {h}f AS (
        SELECT h.channel, e.value, hour(h.ts) AS hour, CASE WHEN EXISTS (
            SELECT 1 FROM answers a WHERE a.entity = h.entity AND a.us > h.us AND a.us <= least(h.us + 259200000000, coalesce(h.next_us, h.us + 259200000000))
        ) THEN 1 ELSE 0 END AS y FROM {h}h h JOIN events e USING (event_id)),
    {h}a AS (
        SELECT CAST({hours} AS INTEGER) AS gap_hours, feature, {_ARMS}
        FROM ({_sql_long(h + "f", {k: FEATURES[k] for k in ("is view", "high value", "morning")})}) GROUP BY feature)"""


SQL = {
    "two_arm_contrast": _FRAME
    + f", long AS ({_sql_long()}), arms AS (SELECT feature, {_ARMS} FROM long GROUP BY 1),"
    + _GAP
    + " SELECT feature, n1, k1, n0, k0, round(p1, 6) AS rate1, round(p0, 6) AS rate0, round(gap, 6) AS gap, round(low, 6) AS low, round(high, 6) AS high FROM gaps",
    "newcombe_gap": _FRAME
    + f", long AS ({_sql_long()}), arms AS (SELECT feature, channel, {_ARMS} FROM long GROUP BY 1, 2),"
    + _GAP
    + " SELECT feature, channel, round(gap, 6) AS gap, round(low, 6) AS low, round(high, 6) AS high FROM gaps WHERE ok",
    "wilson_intervals": _FRAME
    + f""", per AS (SELECT sender, count(*) AS n, CAST(sum(y) AS BIGINT) AS k FROM frame GROUP BY 1)
          SELECT sender, n, k, round(greatest(0, {_wilson("k", "n", "-")}), 6) AS low, round(least(1, {_wilson("k", "n", "+")}), 6) AS high FROM per""",
    "fe_effect": _FRAME
    + f", long AS ({_sql_long()}),"
    + _fe("long", "fit")
    + " SELECT feature, round(b, 6) AS b, round(se, 6) AS se, round(CASE WHEN se > 0 THEN b / se END, 6) AS z FROM fit",
    "fe_effect_covariates": _FRAME
    + """, v AS (SELECT sender, CAST(y AS DOUBLE) AS y, CASE WHEN channel = 'view' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p, ln(1 + value) AS q FROM frame),
          d AS (SELECT sender, y - avg(y) OVER w AS y, p - avg(p) OVER w AS p, q - avg(q) OVER w AS q FROM v WINDOW w AS (PARTITION BY sender)),
          s AS (SELECT sum(p * p) AS pp, sum(p * q) AS pq, sum(q * q) AS qq, sum(p * y) AS py, sum(q * y) AS qy, count(*) AS n, count(DISTINCT sender) AS g FROM d),
          b AS (SELECT *, pp * qq - pq * pq AS det, (qq * py - pq * qy) / (pp * qq - pq * pq) AS b1, (pp * qy - pq * py) / (pp * qq - pq * pq) AS b2 FROM s),
          u AS (SELECT sender, sum(p * (y - b1 * p - b2 * q)) AS u1, sum(q * (y - b1 * p - b2 * q)) AS u2 FROM d, b GROUP BY 1),
          m AS (SELECT sum(u1 * u1) AS m11, sum(u1 * u2) AS m12, sum(u2 * u2) AS m22 FROM u),
          o AS (SELECT *, g / (g - 1) * (n - 1) / (n - 2 - g) AS c FROM b, m)
          SELECT 'is_view' AS term, round(b1, 6) AS b, round(sqrt(c * (qq * qq * m11 - 2 * qq * pq * m12 + pq * pq * m22)) / det, 6) AS se FROM o
          UNION ALL SELECT 'log_value', round(b2, 6), round(sqrt(c * (pq * pq * m11 - 2 * pq * pp * m12 + pp * pp * m22)) / det, 6) FROM o""",
    "within_group_sign": _FRAME
    + f""", long AS ({_sql_long()}), arms AS (SELECT feature, sender, {_ARMS} FROM long GROUP BY 1, 2)
          SELECT feature, count(*) AS groups, count(*) FILTER (WHERE k1 / n1 - k0 / n0 > 0) AS positive FROM arms WHERE n1 >= 10 AND n0 >= 10 GROUP BY 1""",
    "bh_families": _FRAME
    + f", long AS ({_sql_long()}),"
    + _fe("long", "fit")
    + f""", tested AS (
            SELECT feature, {_FAMILY} AS family, {_sql_erfc()} AS p FROM (SELECT feature, abs(b / se) / sqrt(2) AS x FROM fit)),
          ranked AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, feature) AS r, count(*) OVER (PARTITION BY family) AS m FROM tested WHERE p IS NOT NULL),
          done AS (SELECT feature, family, p, least(1.0, min(p * m / r) OVER (PARTITION BY family ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM ranked)
          SELECT t.feature, t.family, round(t.p, 6) AS p, round(q, 6) AS q, q < 0.05 AS significant FROM tested t LEFT JOIN done USING (feature)""",
    "bucket_rates": _FRAME
    + """, names AS (SELECT * FROM (VALUES (0, '(0,2]', 0.0, 2.0), (1, '(2,5]', 2.0, 5.0), (2, '(5,10]', 5.0, 10.0), (3, '(10,20]', 10.0, 20.0), (4, 'over 20', 20.0, 1e9))
                     t(bucket, label, low, high))
          SELECT bucket, label, count(event_id) AS n, CAST(coalesce(sum(y), 0) AS BIGINT) AS k, round(avg(y), 6) AS rate
          FROM names LEFT JOIN frame ON value > low AND value <= high GROUP BY 1, 2""",
    "burst_volume": _FRAME + " SELECT same_day, count(*) AS n, round(avg(y), 6) AS rate, round(avg(ln(same_day)), 6) AS log_volume FROM frame GROUP BY 1",
    "placebo_rate": _FRAME
    + ", "
    + ",".join(
        f"""
          d{k} AS (
            SELECT a.* EXCLUDE (y, r), b.y FROM (SELECT *, row_number() OVER (PARTITION BY sender ORDER BY md5(event_id || '#own'), event_id) AS r FROM frame) a
            JOIN (SELECT sender, y, row_number() OVER (PARTITION BY sender ORDER BY md5(event_id || '#{k}'), event_id) AS r FROM frame) b USING (sender, r)),
          l{k} AS ({_sql_long(f"d{k}")}),"""
        + _fe(f"l{k}", f"p{k}")
        for k in range(5)
    )
    + " UNION ALL ".join(
        f" SELECT CAST({k} AS INTEGER) AS seed, count(CASE WHEN se > 0 THEN b / se END) AS tests, count(*) FILTER (WHERE se > 0 AND abs(b / se) >= 1.96) AS hits FROM p{k}" for k in range(5)
    ),
    "fe_interaction": _FRAME
    + """, v AS (
            SELECT sender, CAST(y AS DOUBLE) AS y, CAST(channel = 'view' AS DOUBLE) AS p, CAST(hour < 12 AS DOUBLE) AS q, CAST(channel = 'view' AND hour < 12 AS DOUBLE) AS r FROM frame),
          d AS (SELECT sender, y - avg(y) OVER w AS y, p - avg(p) OVER w AS p, q - avg(q) OVER w AS q, r - avg(r) OVER w AS r FROM v WINDOW w AS (PARTITION BY sender)),
          s AS (SELECT sum(p * p) AS pp, sum(p * q) AS pq, sum(p * r) AS pr, sum(q * q) AS qq, sum(q * r) AS qr, sum(r * r) AS rr,
                       sum(p * y) AS py, sum(q * y) AS qy, sum(r * y) AS ry, count(*) AS n, count(DISTINCT sender) AS g FROM d),
          c AS (SELECT *, qq * rr - qr * qr AS c11, pr * qr - pq * rr AS c12, pq * qr - pr * qq AS c13, pp * rr - pr * pr AS c22, pq * pr - pp * qr AS c23, pp * qq - pq * pq AS c33 FROM s),
          i AS (SELECT *, pp * c11 + pq * c12 + pr * c13 AS det FROM c),
          b AS (SELECT *, (c11 * py + c12 * qy + c13 * ry) / det AS b1, (c12 * py + c22 * qy + c23 * ry) / det AS b2, (c13 * py + c23 * qy + c33 * ry) / det AS b3 FROM i),
          u AS (SELECT sender, sum(p * e) AS u1, sum(q * e) AS u2, sum(r * e) AS u3 FROM (SELECT d.*, d.y - b1 * p - b2 * q - b3 * r AS e FROM d, b) GROUP BY 1),
          t AS (SELECT sum((c11 * u1 + c12 * u2 + c13 * u3) ** 2) AS t1, sum((c12 * u1 + c22 * u2 + c23 * u3) ** 2) AS t2, sum((c13 * u1 + c23 * u2 + c33 * u3) ** 2) AS t3 FROM u, b),
          o AS (SELECT *, g / (g - 1) * (n - 1) / (n - 3 - g) AS k FROM b, t)
          SELECT 'is_view' AS term, round(b1, 6) AS b, round(sqrt(k * t1) / abs(det), 6) AS se FROM o
          UNION ALL SELECT 'morning', round(b2, 6), round(sqrt(k * t2) / abs(det), 6) FROM o
          UNION ALL SELECT 'both', round(b3, 6), round(sqrt(k * t3) / abs(det), 6) FROM o""",
    "overdispersion": _FRAME
    + """, g AS (SELECT entity, count(*) AS n, sum(y) AS k FROM frame GROUP BY 1 HAVING count(*) >= 5),
          t AS (SELECT sum(k) / sum(n) AS p FROM g)
          SELECT count(*) AS groups, round(avg(CASE WHEN k = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_seen, round(avg(pow(1 - p, n)), 6) AS zero_expected,
                 round(sum((k - n * p) * (k - n * p) / (n * p * (1 - p))), 6) AS chi2, count(*) - 1 AS df,
                 round(var_samp(k / n) / avg(p * (1 - p) / n), 6) AS ratio FROM g, t""",
    "two_by_two": _FRAME + " SELECT channel = 'view' AS is_view, hour < 12 AS morning, count(*) AS n, round(avg(y), 6) AS rate FROM frame GROUP BY 1, 2",
    "mde_table": _FRAME
    + f""", long AS ({_sql_long()}), arms AS (SELECT feature, {_ARMS} FROM long GROUP BY 1), based AS (SELECT *, (k1 + k0) / (n1 + n0) AS base FROM arms)
          SELECT feature, n1, n0, round(CASE WHEN n1 > 0 AND n0 > 0 THEN (0.8416212 + 1.959964) * sqrt(base * (1 - base) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n0)) END, 6) AS mde FROM based""",
    "holdout_verdicts": _FRAME
    + f", long AS ({_sql_long()}), early AS (SELECT * FROM long WHERE day <= 15), late AS (SELECT * FROM long WHERE day > 15),"
    + _fe("early", "t")
    + ","
    + _fe("late", "h")
    + """, sized AS (SELECT feature, count(*) FILTER (WHERE x = 1) AS n1 FROM late GROUP BY 1)
          SELECT t.feature, round(t.b, 6) AS b_train, round(h.b, 6) AS b_held, CASE
              WHEN n1 IS NULL OR n1 < 30 OR h.b IS NULL THEN 'untestable'
              WHEN abs(t.b / t.se) >= 1.96 AND sign(t.b) = sign(h.b) AND abs(h.b / h.se) >= 1.96 THEN 'replicates'
              WHEN abs(t.b / t.se) >= 1.96 AND sign(t.b) = sign(h.b) THEN 'direction only'
              WHEN abs(t.b / t.se) >= 1.96 THEN 'fails'
              WHEN h.b + 1.96 * h.se < 0.03 THEN 'null confirmed' ELSE 'inconclusive' END AS verdict
          FROM t LEFT JOIN h USING (feature) LEFT JOIN sized USING (feature)""",
    "robustness_grid": _FRAME
    + f""", long AS ({_sql_long()}),
          one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feature, entity ORDER BY event_id) AS nth FROM long) WHERE nth = 1),"""
    + _fe("long", "f1")
    + ","
    + _fe("long", "f2", cluster="entity")
    + ","
    + _fe("one", "f3")
    + " UNION ALL ".join(
        f" SELECT '{name}' AS spec, feature, round(b, 6) AS b, round(se, 6) AS se FROM {tag}" for name, tag in (("sender", "f1"), ("entity clusters", "f2"), ("one each", "f3"))
    ),
    "flag_overlap": _FRAME
    + f""", long AS ({_sql_long()})
          SELECT p.feature AS a, q.feature AS b, CAST(sum(p.x * q.x) AS BIGINT) AS both, CAST(sum(p.x) AS BIGINT) AS n, round(sum(p.x * q.x) / nullif(sum(p.x), 0), 6) AS share
          FROM long p JOIN long q ON p.event_id = q.event_id AND p.feature <> q.feature GROUP BY 1, 2""",
    "leave_largest_out": _FRAME
    + f""", largest AS (SELECT sender FROM frame GROUP BY 1 ORDER BY count(*) DESC, sender LIMIT 1),
          rest AS (SELECT * FROM frame WHERE sender NOT IN (SELECT sender FROM largest)), long AS ({_sql_long("rest")}),"""
    + _fe("long", "fit")
    + " SELECT feature, round(b, 6) AS b, round(se, 6) AS se, round(CASE WHEN se > 0 THEN b / se END, 6) AS z FROM fit",
    "route_interactions": _FRAME
    + f", long AS (SELECT * FROM ({_sql_long()}) WHERE feature <> 'is view'),"
    + _fe("long", "fit", by="feature, channel")
    + " SELECT feature, channel, round(b, 6) AS b, round(se, 6) AS se FROM fit",
    "gap_robustness": "WITH"
    + time._LOG
    + ","
    + ",".join(_alt_sessions(h) for h in (12, 24, 36))
    + " UNION ALL ".join(f" SELECT gap_hours, feature, n1, n0, round(k1 / n1 - k0 / n0, 6) AS gap FROM h{h}a" for h in (12, 24, 36)),
}
