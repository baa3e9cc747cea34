"""Attribution of responses to session heads, by interval joins on an equal key.

A response counts for a head when it comes after it and not after the deadline: a window from the head,
or the entity's next head if that is earlier (which the deadline includes and the next session excludes).
Every range test rides on an equi-join, so Spark shuffles by key and splits skewed keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["entity", "session_no"]


def deadline(window_us: int) -> Column:
    return F.least(F.unix_micros("ts") + window_us, F.unix_micros("next_start"))


def subjects_match(reply: Column, touches: Column) -> Column:
    """A normalised subject equals one of the touches', or one contains the other and the shorter has six letters."""

    def tied(t: Column) -> Column:
        contained = F.contains(reply, t) | F.contains(t, reply)
        return (t != "") & ((t == reply) | ((F.least(F.length(t), F.length(reply)) >= 6) & contained))

    return F.coalesce((reply != "") & F.exists(touches, tied), F.lit(False))


def _near(heads: DataFrame, responses: DataFrame, width_us: int) -> DataFrame:
    """(head, response) rows with equal ``_on`` whose times can be within a range of ``width_us``.

    Time is cut into stretches of that width, so a head's range touches two of them: the join's key is (_on, stretch),
    and an entity of very many events never meets itself as a whole."""
    stretch = F.floor(F.col("_low") / width_us)
    h = heads.where("_on IS NOT NULL").withColumn("_stretch", F.explode(F.array(stretch, stretch + 1)))
    r = responses.withColumn("_stretch", F.floor(F.col("response_us") / width_us))
    return h.join(r, ["_on", "_stretch"]).drop("_stretch")


def candidates(heads: DataFrame, responses: DataFrame, window_us: int, on: str, route: str, rank: int) -> DataFrame:
    """(head, response) pairs by one route: equal ``on`` and after the head up to its deadline."""
    h = heads.select(*KEY, F.col(on).alias("_on"), F.unix_micros("ts").alias("_low"), deadline(window_us).alias("_end"))
    r = responses.select(F.col(on).alias("_on"), F.col("event_id").alias("response_id"), F.unix_micros("ts").alias("response_us"))
    found = _near(h, r, window_us).where("response_us > _low AND response_us <= _end")
    return found.select(*KEY, "response_id", "response_us", F.lit(route).alias("route"), F.lit(rank).alias("rank"))


def one_route_each(pairs: DataFrame) -> DataFrame:
    """One row for each head and response: the route of least rank."""
    first = Window.partitionBy(*KEY, "response_id").orderBy("response_us", "rank")
    return pairs.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def attributed(heads: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each head with its earliest candidate (null without one) and how many there are."""
    first = pairs.groupBy(*KEY).agg(F.min(F.struct("response_us", "rank", "response_id", "route")).alias("r"), F.count(F.lit(1)).alias("n_candidates"))
    found = heads.join(first, KEY, "left")
    return found.select(
        *heads.columns, F.col("r.response_id").alias("response_id"), F.col("r.response_us").alias("response_us"), F.col("r.route").alias("route"),
        F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
    )


def looked_back(heads: DataFrame, responses: DataFrame, back_us: int) -> DataFrame:
    """Heads with a response of the entity from ``back_us`` before them up to, but not at, their time."""
    h = heads.select(*KEY, F.col("entity").alias("_on"), F.unix_micros("ts").alias("_start"), (F.unix_micros("ts") - back_us).alias("_low"))
    r = responses.select(F.col("entity").alias("_on"), F.unix_micros("ts").alias("response_us")).distinct()
    near = _near(h, r, back_us).where("response_us >= _low AND response_us < _start").select(*KEY).distinct()
    return near.withColumn("looked_back", F.lit(True))


def outcomes(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Of each head with candidates: how many, how many are labelled, whether any is by a person, whether any of those
    shows interest, and the first time of one by a person. ``labels`` has response_id, human, interested; a candidate
    without a label counts as no reply."""
    found = pairs.join(labels, "response_id", "left")
    human = F.coalesce("human", F.lit(False))
    return found.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_candidates"), F.count("human").alias("n_labelled"), F.bool_or(human).alias("replied"),
        F.bool_or(human & F.coalesce("interested", F.lit(False))).alias("interested"), F.min(F.when(human, F.col("response_us"))).alias("reply_us"),
    )


def thread_earliest(events: DataFrame) -> DataFrame:
    """The first time of each thread, and the first known channel in it."""
    order = F.struct("ts", "event_id")
    known = F.when(F.col("channel").isNotNull(), F.col("channel"))
    return events.where("thread_id IS NOT NULL").groupBy("thread_id").agg(
        F.min("ts").alias("first_ts"), F.min_by(known, F.when(F.col("channel").isNotNull(), order)).alias("first_channel")
    )


def with_exclusions(heads: DataFrame, events: DataFrame, responses: DataFrame, bounced: DataFrame, back_us: int, inbound: tuple[str, ...]) -> DataFrame:
    """``exclusions``: why a head is not a clean start, as an array in a fixed order."""
    found = heads.join(looked_back(heads, responses, back_us), KEY, "left").join(thread_earliest(events), "thread_id", "left")
    found = found.join(bounced.select("event_id", F.lit(True).alias("_bounced")), "event_id", "left")
    earlier = F.coalesce(F.col("first_ts") < F.col("ts"), F.lit(False))
    started = F.coalesce(F.col("first_channel").isin(*inbound), F.lit(False))
    reasons = F.array_compact(F.array(
        F.when(F.col("_bounced"), F.lit("bounced")),
        F.when(F.col("looked_back"), F.lit("incoming_within_gap")),
        F.when(earlier & started, F.lit("prospect_started")).when(earlier, F.lit("reply_into_existing_thread")),
    ))
    return found.select(*heads.columns, reasons.alias("exclusions"))
