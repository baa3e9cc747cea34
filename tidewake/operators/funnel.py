"""What each further touch adds: the conditional follow-up curve and what follows from it.

A session's touches are numbered; with its one response time every (session, touch) row says by itself whether
it was sent to a silent entity, answered before the next touch, followed by a next one, or the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake.operators.quantiles import with_quantiles
from tidewake.sources.scratch import written
from tidewake.functions.stats import share, wilson

KEY = ["entity", "session_no"]
MOST = 8


def stage_records(sessions: DataFrame, replies: DataFrame) -> DataFrame:
    """(session, touch) rows still silent when the touch went out: replied, got_next, still_silent."""
    t = F.unix_micros("ts").alias("t_us")
    following = F.lead(F.unix_micros("ts")).over(Window.partitionBy(*KEY).orderBy("touch_no")).alias("next_us")
    rows = sessions.select(*KEY, "touch_no", "channel", "sender", t, following).join(replies.select(*KEY, "response_us"), KEY, "left")
    sent = rows.where("response_us IS NULL OR response_us > t_us")
    replied = F.coalesce((F.col("response_us") > F.col("t_us")) & (F.col("next_us").isNull() | (F.col("response_us") <= F.col("next_us"))), F.lit(False))
    return sent.select(
        *KEY, "touch_no", "channel", "sender", replied.alias("replied"), F.col("next_us").isNotNull().alias("got_next"), (~replied).alias("still_silent")
    )


def follow_up_curve(spark: SparkSession, stages: DataFrame, most: int = MOST) -> DataFrame:
    """For touches 1 to ``most``: at risk, sent, replied, rate with its interval, and stopped before it."""
    per = stages.groupBy("touch_no").agg(
        F.count(F.lit(1)).alias("sent"), F.count_if("replied").alias("replied"), F.count_if(F.col("still_silent") & ~F.col("got_next")).alias("ended")
    )
    dense = spark.range(1, most + 1).select(F.col("id").cast("int").alias("touch_no")).join(F.broadcast(per), "touch_no", "left").fillna(0)
    before = F.coalesce(F.lag("ended").over(Window.orderBy("touch_no")), F.lit(0))
    dense = dense.withColumn("stopped", before)
    low, high = wilson(F.col("replied"), F.col("sent"))
    return dense.select(
        "touch_no", (F.col("sent") + F.col("stopped")).alias("at_risk"), "sent", "replied",
        share(F.col("replied"), F.col("sent")).alias("rate"), low.alias("low"), high.alias("high"), "stopped",
    )


def cumulative(curve: DataFrame, n_sessions: DataFrame) -> DataFrame:
    """Share of all sessions answered by each touch."""
    total = n_sessions.agg(F.count(F.lit(1)).alias("n_sessions"))
    run = F.sum("replied").over(Window.orderBy("touch_no"))
    return curve.select("touch_no", "replied", run.alias("replied_so_far")).join(F.broadcast(total), how="cross").select(
        "touch_no", "replied", "replied_so_far", (F.col("replied_so_far") / F.col("n_sessions")).alias("cumulative_share")
    )


def continuation(stages: DataFrame, most: int = MOST) -> DataFrame:
    """Of the sessions still silent after a touch, the share that got another."""
    silent = stages.where(F.col("still_silent") & (F.col("touch_no") <= most))
    return silent.groupBy("touch_no").agg(
        F.count(F.lit(1)).alias("silent"), F.count_if("got_next").alias("continued"), F.avg(F.col("got_next").cast("int")).alias("continuation")
    )


def persistence_bands(stages: DataFrame, stage: int, least: int, bands: list[tuple[float, float, str]]) -> DataFrame:
    """Answer rates to the touch after ``stage``, by how many silent sessions their sender goes on with there."""
    per = stages.where(F.col("still_silent") & (F.col("touch_no") == stage)).groupBy("sender")
    per = per.agg(F.avg(F.col("got_next").cast("int")).alias("persistence"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    band = F.lit(None).cast("string")
    for low, high, name in reversed(bands):
        band = F.when((F.col("persistence") >= low) & (F.col("persistence") < high), name).otherwise(band)
    rows = stages.where(F.col("touch_no") == stage + 1).join(per.select("sender", band.alias("band")), "sender")
    out = rows.groupBy("band").agg(F.count(F.lit(1)).alias("sent"), F.count_if("replied").alias("replied"), F.countDistinct("sender").alias("senders"))
    low, high = wilson(F.col("replied"), F.col("sent"))
    return out.select("band", "senders", "sent", "replied", share(F.col("replied"), F.col("sent")).alias("rate"), low.alias("low"), high.alias("high"))


def sender_policy(stages: DataFrame, least: int) -> DataFrame:
    """For each sender: sessions begun, answered, mean depth, share that reaches four touches, and rate."""
    per = stages.groupBy("sender", *KEY).agg(F.max("touch_no").alias("depth"), F.max("replied").alias("replied"), F.min("touch_no").alias("first"))
    out = per.groupBy("sender").agg(
        F.count_if(F.col("first") == 1).alias("sessions"), F.count_if("replied").alias("replied"), F.avg("depth").alias("mean_touches"),
        F.avg((F.col("depth") >= 4).cast("int")).alias("share_reaching_4"),
    )
    return out.where(F.col("sessions") >= least).withColumn("rate", F.col("replied") / F.col("sessions"))


def route_classes(sessions: DataFrame, channel: str) -> DataFrame:
    """Each session by the channels of its further touches: none, all, no or some of ``channel``."""
    per = sessions.groupBy(*KEY).agg(
        F.count_if(F.col("touch_no") > 1).alias("further"), F.count_if((F.col("touch_no") > 1) & (F.col("channel") == channel)).alias("hits")
    )
    kind = F.when(F.col("further") == 0, "no_followups").when(F.col("hits") == F.col("further"), "all").when(F.col("hits") == 0, "none").otherwise("mixed")
    return per.select(*KEY, kind.alias("route_class"))


def depth_stats(sizes: DataFrame) -> DataFrame:
    """Sizes of sessions: how many, their median and mean, and the shares of one touch and of four and more."""
    n, sizes = F.col("n_touches"), written(sizes, "sizes")
    out = sizes.agg(
        F.count(F.lit(1)).alias("sessions"), F.avg(n).alias("mean_touches"),
        F.avg((n == 1).cast("int")).alias("share_one"), F.avg((n >= 4).cast("int")).alias("share_four"),
    )
    return with_quantiles(out, sizes, [], {"median_touches": (n, 0.5)})
