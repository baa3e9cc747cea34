"""Queries over sessions, attribution and the follow-up funnel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.operators import attribution as att
from tidewake.operators import funnel
from tidewake.operators import sessions as ses
from tidewake.operators.quantiles import with_quantiles
from tidewake.sources.scratch import written
from tidewake.sources.tables import event_log, order_touches, responses, touches

#: The event binding: sessions end after a day without a touch, answers count for three.
GAP, ANSWER = ses.DAY, 3 * ses.DAY
KEY = ["entity", "session_no"]


def _sessions(spark: SparkSession, sf: str) -> DataFrame:
    return ses.sessionized(touches(spark, sf), GAP)


def _heads(spark: SparkSession, sf: str) -> DataFrame:
    return ses.session_heads(_sessions(spark, sf))


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    heads = _heads(spark, sf)
    return att.attributed(heads, att.candidates(heads, responses(spark, sf), ANSWER, "entity", "entity", 0))


def _stages(spark: SparkSession, sf: str) -> DataFrame:
    """Heads, and so the answers, come from the same sessions: one plan, of which Spark reuses the shuffle by entity."""
    sessions = _sessions(spark, sf)
    heads = ses.session_heads(sessions)
    answers = att.attributed(heads, att.candidates(heads, responses(spark, sf), ANSWER, "entity", "entity", 0))
    return funnel.stage_records(sessions, answers.where("response_us IS NOT NULL"))


def gap_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return ses.gap_histogram(ses.gaps(order_touches(spark, sf)))


def gap_shares(spark: SparkSession, sf: str) -> DataFrame:
    return ses.gap_shares(ses.gaps(order_touches(spark, sf)), [7, 10, 14, 21, 28, 30, 45, 60]).select("cut", F.round("share", 6).alias("share"))


def gap_trough(spark: SparkSession, sf: str) -> DataFrame:
    smooth = ses.smoothed(spark, ses.gap_histogram(ses.gaps(order_touches(spark, sf))))
    return ses.trough(smooth).select("unit", F.round("smooth", 6).alias("smooth"))


def _orders(days: int):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        sizes = ses.session_sizes(ses.sessionized(order_touches(spark, sf), days * ses.DAY))
        return sizes.select(*KEY, "n_touches", ses.micros("start"), ses.micros("end"))

    return query


def session_family(spark: SparkSession, sf: str) -> DataFrame:
    """One table for several gaps, with the gap as a column; the touches are read and sorted once."""
    sizes = ses.session_family(order_touches(spark, sf), {d: d * ses.DAY for d in (21, 30, 45)}, "gap_days")
    return sizes.groupBy("gap_days").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n_touches").alias("touches"), F.max("n_touches").alias("longest"))


def sessions_events_24h(spark: SparkSession, sf: str) -> DataFrame:
    return _sessions(spark, sf).select("event_id", *KEY, "touch_no")


def session_heads(spark: SparkSession, sf: str) -> DataFrame:
    return _heads(spark, sf).select("event_id", *KEY, "channel", "sender", ses.micros("ts"))


def next_session_start(spark: SparkSession, sf: str) -> DataFrame:
    return _heads(spark, sf).select("event_id", *KEY, ses.micros("next_start"))


def response_attribution(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf).select("event_id", *KEY, "response_id", "response_us", "n_candidates")


def response_attribution_threaded(spark: SparkSession, sf: str) -> DataFrame:
    """Both routes: equal thread first, then equal entity; a response counts once."""
    heads, answers = _heads(spark, sf), responses(spark, sf)
    pairs = att.candidates(heads, answers, ANSWER, "thread_id", "thread", 0).unionByName(att.candidates(heads, answers, ANSWER, "entity", "entity", 1))
    return att.attributed(heads, att.one_route_each(pairs)).select("event_id", *KEY, "response_id", "route", "n_candidates")


def lookback_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    return att.looked_back(_heads(spark, sf), responses(spark, sf), GAP).select(*KEY)


def exclusion_reasons(spark: SparkSession, sf: str) -> DataFrame:
    log = event_log(spark, sf)
    heads = _heads(spark, sf)
    bounced = heads.join(log.where("channel = 'error'").select("thread_id").distinct(), "thread_id", "left_semi")
    found = att.with_exclusions(heads, log, responses(spark, sf), bounced, GAP, ("purchase", "signup"))
    return found.select("event_id", *KEY, F.concat_ws(",", "exclusions").alias("exclusions"))


def thread_earliest(spark: SparkSession, sf: str) -> DataFrame:
    return att.thread_earliest(event_log(spark, sf)).select("thread_id", ses.micros("first_ts"), "first_channel")


def touches_before_response(spark: SparkSession, sf: str) -> DataFrame:
    answered = _answers(spark, sf).where("response_us IS NOT NULL").select(*KEY, "response_us")
    return _sessions(spark, sf).join(answered, KEY).groupBy(*KEY).agg(F.count_if(F.unix_micros("ts") < F.col("response_us")).alias("touches_before"))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def followup_curve(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(funnel.follow_up_curve(spark, _stages(spark, sf)), "rate", "low", "high")


def followup_curve_single_channel(spark: SparkSession, sf: str) -> DataFrame:
    """The curve over sessions all of whose touches are views."""
    sessions = _sessions(spark, sf)
    whole = sessions.groupBy(*KEY).agg(F.bool_and(F.col("channel") == "view").alias("own")).where("own").select(*KEY)
    stages = _stages(spark, sf).join(whole, KEY, "left_semi")
    return _rounded(funnel.follow_up_curve(spark, stages), "rate", "low", "high")


def followup_cumulative(spark: SparkSession, sf: str) -> DataFrame:
    heads = _heads(spark, sf)
    return _rounded(funnel.cumulative(funnel.follow_up_curve(spark, _stages(spark, sf)), heads), "cumulative_share")


def stage_records(spark: SparkSession, sf: str) -> DataFrame:
    return _stages(spark, sf).where("touch_no <= 8").select(*KEY, "touch_no", "replied", "got_next", "still_silent")


def continuation(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(funnel.continuation(_stages(spark, sf)), "continuation")


BANDS = [(0.0, 0.35, "selective"), (0.35, 0.65, "middling"), (0.65, 1.01, "nearly all")]


def persistence_bands(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(funnel.persistence_bands(_stages(spark, sf), 1, 30, BANDS), "rate", "low", "high")


def group_policy(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(funnel.sender_policy(_stages(spark, sf), 20), "mean_touches", "share_reaching_4", "rate")


def session_route_class(spark: SparkSession, sf: str) -> DataFrame:
    return funnel.route_classes(_sessions(spark, sf), "click").groupBy("route_class").agg(F.count(F.lit(1)).alias("sessions"))


def touch_depth_stats(spark: SparkSession, sf: str) -> DataFrame:
    sizes = ses.session_sizes(_sessions(spark, sf))
    return _rounded(funnel.depth_stats(sizes), "median_touches", "mean_touches", "share_one", "share_four")


def latencies(spark: SparkSession, sf: str) -> DataFrame:
    """Days from head to answer by channel, as a table."""
    days = (F.col("response_us") - F.unix_micros("ts")) / ses.DAY
    return written(_answers(spark, sf).where("response_us IS NOT NULL").select("channel", days.alias("days")), "latencies")


def response_latency(spark: SparkSession, sf: str) -> DataFrame:
    found, days = latencies(spark, sf), F.col("days")
    out = found.groupBy("channel").agg(F.count(F.lit(1)).alias("answers"), F.avg((days <= 1).cast("int")).alias("share_in_a_day"))
    out = with_quantiles(out, found, ["channel"], {"median_days": (days, 0.5)})
    return _rounded(out, "median_days", "share_in_a_day")


def ordered_channels(spark: SparkSession, sf: str) -> DataFrame:
    """The channels of each session in order, as a list."""
    parts = F.sort_array(F.collect_list(F.struct("touch_no", "channel")))
    return _sessions(spark, sf).groupBy(*KEY).agg(F.concat_ws(",", F.transform(parts, lambda x: x["channel"])).alias("channels"))


def channel_visibility(spark: SparkSession, sf: str) -> DataFrame:
    """Of the entities that only one channel reached in a session, the share ever seen as a response sender."""
    only = _sessions(spark, sf).where("session_no = 1").groupBy("entity").agg(F.min("channel").alias("channel"), F.max("channel").alias("other")).where("channel = other")
    seen = responses(spark, sf).select("entity").distinct().withColumn("seen", F.lit(1))
    out = only.join(seen, "entity", "left").groupBy("channel").agg(F.count(F.lit(1)).alias("entities"), F.count("seen").alias("seen"))
    return out.withColumn("share", F.round(F.col("seen") / F.col("entities"), 6))


def attribution_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """By channel of the head: how many have a response, and how many have one of the entity at any time."""
    ever = responses(spark, sf).select("entity").distinct().withColumn("ever", F.lit(1))
    out = _answers(spark, sf).join(ever, "entity", "left").groupBy("channel")
    return out.agg(F.count(F.lit(1)).alias("heads"), F.count("response_id").alias("matched"), F.count("ever").alias("entity_responds"))


NAMES = (
    "gap_histogram gap_shares gap_trough session_family sessions_events_24h session_heads next_session_start response_attribution "
    "response_attribution_threaded lookback_exclusion exclusion_reasons thread_earliest touches_before_response followup_curve "
    "followup_curve_single_channel followup_cumulative stage_records continuation persistence_bands group_policy session_route_class "
    "touch_depth_stats response_latency ordered_channels channel_visibility attribution_coverage"
).split()
QUERIES = {n: globals()[n] for n in NAMES} | {"sessions_orders_g30": _orders(30), "sessions_orders_g180": _orders(180)}

_ORDER_GAPS = """
    WITH gapped AS (
        SELECT epoch_us(o_orderdate) - lag(epoch_us(o_orderdate)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS gap_us
        FROM orders),
    hist AS (SELECT least(gap_us // 86400000000, 120) AS unit, count(*) AS n FROM gapped WHERE gap_us IS NOT NULL GROUP BY 1)"""


def _order_sessions(days: int, tag: str = "sized") -> str:
    return f"""
    gapped{days} AS (
        SELECT *, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders),
    numbered{days} AS (
        SELECT o_custkey AS entity, o_orderdate AS ts,
               CAST(sum(CASE WHEN prev IS NULL OR epoch_us(o_orderdate) - epoch_us(prev) >= {days} * 86400000000 THEN 1 ELSE 0 END)
                    OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no
        FROM gapped{days}),
    {tag} AS (SELECT entity, session_no, count(*) AS n_touches, epoch_us(min(ts)) AS "start", epoch_us(max(ts)) AS "end" FROM numbered{days} GROUP BY 1, 2)"""


_LOG = """
    log AS (
        SELECT event_id, user_id AS entity, ts, epoch_us(ts) AS us, event_type AS channel,
               CAST(regexp_extract(props, '[0-9]+') AS BIGINT) % 20 AS sender,
               CAST(user_id AS VARCHAR) || '/' || strftime(ts, '%Y-%m-%d') AS thread_id
        FROM events),
    touches AS (SELECT * FROM log WHERE channel IN ('view', 'click')),
    answers AS (SELECT * FROM log WHERE channel IN ('purchase', 'signup')),
    gapped AS (SELECT *, us - lag(us) OVER (PARTITION BY entity ORDER BY ts, event_id) AS gap_us FROM touches),
    numbered AS (
        SELECT *, CAST(sum(CASE WHEN gap_us IS NULL OR gap_us >= 86400000000 THEN 1 ELSE 0 END)
                  OVER (PARTITION BY entity ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM gapped),
    sessions AS (SELECT *, CAST(row_number() OVER (PARTITION BY entity, session_no ORDER BY ts, event_id) AS INTEGER) AS touch_no FROM numbered),
    heads AS (
        SELECT *, lead(us) OVER (PARTITION BY entity ORDER BY session_no) AS next_us FROM sessions WHERE touch_no = 1),
    pairs AS (
        SELECT h.entity, h.session_no, a.event_id AS response_id, a.us AS response_us
        FROM heads h JOIN answers a ON a.entity = h.entity AND a.us > h.us AND a.us <= least(h.us + 259200000000, coalesce(h.next_us, h.us + 259200000000))),
    best AS (
        SELECT entity, session_no, count(*) AS n_candidates, min(response_us) AS response_us,
               min(response_id) FILTER (WHERE nth = 1) AS response_id
        FROM (SELECT *, row_number() OVER (PARTITION BY entity, session_no ORDER BY response_us, response_id) AS nth FROM pairs) GROUP BY 1, 2),
    found AS (
        SELECT h.*, b.response_us, b.response_id, coalesce(b.n_candidates, 0) AS n_candidates FROM heads h LEFT JOIN best b USING (entity, session_no)),
    stages AS (
        SELECT s.entity, s.session_no, s.touch_no, s.channel, s.sender,
               coalesce(r > us AND (next_touch IS NULL OR r <= next_touch), false) AS replied, next_touch IS NOT NULL AS got_next,
               NOT coalesce(r > us AND (next_touch IS NULL OR r <= next_touch), false) AS still_silent
        FROM (SELECT t.*, b.response_us AS r, lead(t.us) OVER (PARTITION BY t.entity, t.session_no ORDER BY t.touch_no) AS next_touch
              FROM sessions t LEFT JOIN best b USING (entity, session_no)) s
        WHERE r IS NULL OR r > us)"""

_CENTRE = "((k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n))"
_HALF = "(1.96 * sqrt((k / n) * (1 - k / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n))"
WILSON = f"round(CASE WHEN n > 0 THEN greatest(0, {_CENTRE} - {_HALF}) END, 6) AS low, round(CASE WHEN n > 0 THEN least(1, {_CENTRE} + {_HALF}) END, 6) AS high"


def _curve(stages: str) -> str:
    return f"""
    per AS (
        SELECT touch_no, count(*) AS sent, count(*) FILTER (WHERE replied) AS replied, count(*) FILTER (WHERE still_silent AND NOT got_next) AS ended
        FROM {stages} GROUP BY 1),
    dense AS (
        SELECT CAST(i AS INTEGER) AS touch_no, coalesce(sent, 0) AS sent, coalesce(replied, 0) AS replied, coalesce(ended, 0) AS ended
        FROM range(1, 9) t(i) LEFT JOIN per ON per.touch_no = i),
    curve AS (SELECT *, coalesce(lag(ended) OVER (ORDER BY touch_no), 0) AS stopped, CAST(replied AS DOUBLE) AS k, CAST(sent AS DOUBLE) AS n FROM dense)"""


_CURVE_OUT = f"SELECT touch_no, sent + stopped AS at_risk, sent, replied, round(CASE WHEN n > 0 THEN k / n END, 6) AS rate, {WILSON}, stopped FROM curve"

SQL = {
    "gap_histogram": _ORDER_GAPS + " SELECT unit, n FROM hist",
    "gap_shares": _ORDER_GAPS
    + """ SELECT CAST(cut AS INTEGER) AS cut, round(avg(CASE WHEN gap_us < cut * 86400000000 THEN 1.0 ELSE 0.0 END), 6) AS share
          FROM gapped, (SELECT unnest([7, 10, 14, 21, 28, 30, 45, 60]) AS cut) WHERE gap_us IS NOT NULL GROUP BY 1""",
    "gap_trough": _ORDER_GAPS
    + """, dense AS (SELECT i AS unit, coalesce(n, 0) AS n FROM range(121) t(i) LEFT JOIN hist ON unit = i),
          smooth AS (SELECT unit, sum(n) OVER (ORDER BY unit ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7.0 AS smooth FROM dense)
          SELECT unit, round(smooth, 6) AS smooth FROM smooth WHERE unit BETWEEN 3 AND 60 ORDER BY smooth, unit LIMIT 1""",
    "sessions_orders_g30": "WITH" + _order_sessions(30) + " SELECT * FROM sized",
    "sessions_orders_g180": "WITH" + _order_sessions(180) + " SELECT * FROM sized",
    "session_family": "WITH"
    + ",".join(_order_sessions(d, f"s{d}") for d in (21, 30, 45))
    + " UNION ALL ".join(
        f" SELECT CAST({d} AS INTEGER) AS gap_days, count(*) AS sessions, CAST(sum(n_touches) AS BIGINT) AS touches, max(n_touches) AS longest FROM s{d}"
        for d in (21, 30, 45)
    ),
    "sessions_events_24h": "WITH" + _LOG + " SELECT event_id, entity, session_no, touch_no FROM sessions",
    "session_heads": "WITH" + _LOG + " SELECT event_id, entity, session_no, channel, sender, us AS ts FROM heads",
    "next_session_start": "WITH" + _LOG + " SELECT event_id, entity, session_no, next_us AS next_start FROM heads",
    "response_attribution": "WITH" + _LOG + " SELECT event_id, entity, session_no, response_id, response_us, n_candidates FROM found",
    "response_attribution_threaded": "WITH"
    + _LOG
    + """, merged AS (
            SELECT entity, session_no, response_id, response_us, 'entity' AS route, 1 AS rank FROM pairs
            UNION ALL
            SELECT h.entity, h.session_no, a.event_id, a.us, 'thread', 0 FROM heads h JOIN answers a
                ON a.thread_id = h.thread_id AND a.us > h.us AND a.us <= least(h.us + 259200000000, coalesce(h.next_us, h.us + 259200000000))),
        one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, session_no, response_id ORDER BY response_us, rank) AS n FROM merged) WHERE n = 1),
        first AS (
            SELECT *, row_number() OVER (PARTITION BY entity, session_no ORDER BY response_us, rank, response_id) AS nth,
                   count(*) OVER (PARTITION BY entity, session_no) AS n_candidates FROM one)
        SELECT h.event_id, h.entity, h.session_no, f.response_id, f.route, coalesce(f.n_candidates, 0) AS n_candidates
        FROM heads h LEFT JOIN (SELECT * FROM first WHERE nth = 1) f USING (entity, session_no)""",
    "lookback_exclusion": "WITH"
    + _LOG
    + """ SELECT entity, session_no FROM heads h
          WHERE EXISTS (SELECT 1 FROM answers a WHERE a.entity = h.entity AND a.us >= h.us - 86400000000 AND a.us < h.us)""",
    "exclusion_reasons": "WITH"
    + _LOG
    + """, threads AS (SELECT thread_id, min(ts) AS first_ts, arg_min(channel, (us, event_id)) AS first_channel FROM log GROUP BY 1),
          bad AS (SELECT DISTINCT thread_id FROM log WHERE channel = 'error')
          SELECT event_id, entity, session_no, concat_ws(',',
              CASE WHEN thread_id IN (SELECT thread_id FROM bad) THEN 'bounced' END,
              CASE WHEN EXISTS (SELECT 1 FROM answers a WHERE a.entity = h.entity AND a.us >= h.us - 86400000000 AND a.us < h.us) THEN 'incoming_within_gap' END,
              CASE WHEN first_ts < ts AND first_channel IN ('purchase', 'signup') THEN 'prospect_started' WHEN first_ts < ts THEN 'reply_into_existing_thread' END
          ) AS exclusions FROM heads h JOIN threads USING (thread_id)""",
    "thread_earliest": "WITH" + _LOG + " SELECT thread_id, min(us) AS first_ts, arg_min(channel, (us, event_id)) AS first_channel FROM log GROUP BY 1",
    "touches_before_response": "WITH"
    + _LOG
    + " SELECT entity, session_no, count(*) FILTER (WHERE us < response_us) AS touches_before FROM sessions JOIN best USING (entity, session_no) GROUP BY 1, 2",
    "followup_curve": "WITH" + _LOG + "," + _curve("stages") + _CURVE_OUT,
    "followup_curve_single_channel": "WITH"
    + _LOG
    + """, own AS (SELECT entity, session_no FROM sessions GROUP BY 1, 2 HAVING bool_and(channel = 'view')),
          mine AS (SELECT stages.* FROM stages SEMI JOIN own USING (entity, session_no)),"""
    + _curve("mine")
    + _CURVE_OUT,
    "followup_cumulative": "WITH"
    + _LOG
    + ","
    + _curve("stages")
    + """ SELECT touch_no, replied, CAST(sum(replied) OVER (ORDER BY touch_no) AS BIGINT) AS replied_so_far,
          round(sum(replied) OVER (ORDER BY touch_no) / (SELECT count(*) FROM heads), 6) AS cumulative_share FROM curve""",
    "stage_records": "WITH" + _LOG + " SELECT entity, session_no, touch_no, replied, got_next, still_silent FROM stages WHERE touch_no <= 8",
    "continuation": "WITH"
    + _LOG
    + """ SELECT touch_no, count(*) AS silent, count(*) FILTER (WHERE got_next) AS continued, round(avg(CAST(got_next AS INTEGER)), 6) AS continuation
          FROM stages WHERE still_silent AND touch_no <= 8 GROUP BY 1""",
    "persistence_bands": "WITH"
    + _LOG
    + f""", per AS (
            SELECT sender, avg(CAST(got_next AS INTEGER)) AS p FROM stages WHERE still_silent AND touch_no = 1 GROUP BY 1 HAVING count(*) >= 30),
          banded AS (SELECT sender, CASE WHEN p < 0.35 THEN 'selective' WHEN p < 0.65 THEN 'middling' ELSE 'nearly all' END AS band FROM per),
          sums AS (
            SELECT band, count(DISTINCT sender) AS senders, count(*) AS sent, count(*) FILTER (WHERE replied) AS replied,
                   CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE replied) AS DOUBLE) AS k
            FROM stages JOIN banded USING (sender) WHERE touch_no = 2 GROUP BY 1)
          SELECT band, senders, sent, replied, round(k / n, 6) AS rate, {WILSON} FROM sums""",
    "group_policy": "WITH"
    + _LOG
    + """, per AS (
            SELECT sender, entity, session_no, max(touch_no) AS depth, bool_or(replied) AS replied, min(touch_no) AS first FROM stages GROUP BY 1, 2, 3)
          SELECT sender, count(*) FILTER (WHERE first = 1) AS sessions, count(*) FILTER (WHERE replied) AS replied, round(avg(depth), 6) AS mean_touches,
                 round(avg(CASE WHEN depth >= 4 THEN 1.0 ELSE 0.0 END), 6) AS share_reaching_4,
                 round(count(*) FILTER (WHERE replied) / count(*) FILTER (WHERE first = 1), 6) AS rate
          FROM per GROUP BY 1 HAVING count(*) FILTER (WHERE first = 1) >= 20""",
    "session_route_class": "WITH"
    + _LOG
    + """, per AS (
            SELECT entity, session_no, count(*) FILTER (WHERE touch_no > 1) AS further, count(*) FILTER (WHERE touch_no > 1 AND channel = 'click') AS hits
            FROM sessions GROUP BY 1, 2)
          SELECT CASE WHEN further = 0 THEN 'no_followups' WHEN hits = further THEN 'all' WHEN hits = 0 THEN 'none' ELSE 'mixed' END AS route_class,
                 count(*) AS sessions FROM per GROUP BY 1""",
    "touch_depth_stats": "WITH"
    + _LOG
    + """, per AS (SELECT entity, session_no, count(*) AS n FROM sessions GROUP BY 1, 2)
          SELECT count(*) AS sessions, round(CAST(median(n) AS DOUBLE), 6) AS median_touches, round(avg(n), 6) AS mean_touches,
                 round(avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END), 6) AS share_one, round(avg(CASE WHEN n >= 4 THEN 1.0 ELSE 0.0 END), 6) AS share_four FROM per""",
    "response_latency": "WITH"
    + _LOG
    + """ SELECT channel, count(*) AS answers, round(median((response_us - us) / 86400000000), 6) AS median_days,
                 round(avg(CASE WHEN response_us - us <= 86400000000 THEN 1.0 ELSE 0.0 END), 6) AS share_in_a_day
          FROM found WHERE response_us IS NOT NULL GROUP BY 1""",
    "ordered_channels": "WITH" + _LOG + " SELECT entity, session_no, string_agg(channel, ',' ORDER BY touch_no) AS channels FROM sessions GROUP BY 1, 2",
    "channel_visibility": "WITH"
    + _LOG
    + """, reached AS (SELECT entity, min(channel) AS channel FROM sessions WHERE session_no = 1 GROUP BY 1 HAVING min(channel) = max(channel))
          SELECT channel, count(*) AS entities, count(*) FILTER (WHERE entity IN (SELECT entity FROM answers)) AS seen,
                 round(count(*) FILTER (WHERE entity IN (SELECT entity FROM answers)) / count(*), 6) AS share FROM reached GROUP BY 1""",
    "attribution_coverage": "WITH"
    + _LOG
    + """ SELECT channel, count(*) AS heads, count(response_id) AS matched,
                 count(*) FILTER (WHERE entity IN (SELECT entity FROM answers)) AS entity_responds FROM found GROUP BY 1""",
}
