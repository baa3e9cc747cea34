"""Large entities are cut into slices of time; the numbers are those of a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from tidewake.operators import sessions as ses

HOURS = "event_id long, entity long, hour long"


def events(spark, rows):
    us = F.lit(1_704_067_200_000_000) + F.col("hour") * ses.HOUR
    return spark.createDataFrame(rows, HOURS).select("event_id", "entity", F.timestamp_micros(us).alias("ts"))


def expected(rows, limit):
    """event_id: (gap in hours, session, touch, hour of the next head if it is one)."""
    found, heads = {}, {}
    for entity in {r[1] for r in rows}:
        last, session, touch = None, 0, 0
        for event_id, _, hour in sorted((r for r in rows if r[1] == entity), key=lambda r: (r[2], r[0])):
            gap = None if last is None else hour - last
            session, touch = (session + 1, 1) if gap is None or gap >= limit else (session, touch + 1)
            found[event_id] = (gap, session, touch)
            if touch == 1:
                heads[entity, session] = (event_id, hour)
            last = hour
    following = {i: heads[e, s + 1][1] if (e, s + 1) in heads else None for (e, s), (i, _) in heads.items()}
    return found, following


def skewed(seed, n=600):
    rng = random.Random(seed)
    hours = {
        0: lambda: rng.randrange(2000),
        1: lambda: rng.choice([5, 5, 6, rng.randrange(3000)]),  # bursts, so that cuts fall together
        2: lambda: 7,  # all at once
    }
    big = [(k, 1, hours[seed % 3]()) for k in range(n)]
    return big + [(n + k, 2 + k % 40, rng.randrange(500)) for k in range(n)]


@pytest.mark.parametrize(("seed", "large"), [(0, 1), (0, 100), (1, 100), (2, 100), (0, 10_000)])
def test_numbers_equal_a_loop(spark, monkeypatch, seed, large):
    monkeypatch.setattr(ses, "LARGE", large)
    rows = skewed(seed)
    found, following = expected(rows, 24)
    numbered = ses.sessionized(events(spark, rows), ses.DAY)
    us = F.unix_micros("next_start")
    gap = (F.col("gap_us") / ses.HOUR).cast("long").alias("gap")
    assert {r.event_id: (r.gap, r.session_no, r.touch_no) for r in numbered.select("event_id", gap, "session_no", "touch_no").collect()} == found
    heads = ses.session_heads(numbered).select("event_id", ((us - 1_704_067_200_000_000) / ses.HOUR).cast("long").alias("hour"))
    assert {r.event_id: r.hour for r in heads.collect()} == following
    gaps = ses.gaps(events(spark, rows)).select("event_id", gap).collect()
    assert {r.event_id: r.gap for r in gaps} == {k: v[0] for k, v in found.items()}


def test_a_family_of_gaps_equals_single_ones(spark, monkeypatch):
    monkeypatch.setattr(ses, "LARGE", 50)
    rows = skewed(0)
    family = ses.session_family(events(spark, rows), {k: k * ses.HOUR for k in (3, 24)}, "gap")
    for k in (3, 24):
        one = ses.session_sizes(ses.sessionized(events(spark, rows), k * ses.HOUR)).select("entity", "session_no", "n_touches")
        assert sorted(map(tuple, family.where(F.col("gap") == k).drop("gap").collect())) == sorted(map(tuple, one.collect()))


def test_one_entity_with_half_of_all_events_is_spread(spark, monkeypatch):
    monkeypatch.setattr(ses, "LARGE", 1000)
    rows = spark.range(40_000).select(F.col("id").alias("event_id"), F.when(F.col("id") < 20_000, -1).otherwise(F.col("id") % 500).alias("entity"), F.timestamp_seconds(F.col("id") * 7919 % 1_000_000).alias("ts"))
    assert ses.large_entities(rows) == [-1]
    slices = ses.sliced(rows.where("entity = -1")).groupBy("slice").count().collect()
    assert len(slices) == ses.PARTS**2 and max(r["count"] for r in slices) < 2 * 20_000 / ses.PARTS**2
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        sizes = [r["count"] for r in ses.sessionized(rows, ses.DAY).groupBy(F.spark_partition_id()).agg(F.count("*").alias("count"), F.sum("touch_no")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(sizes) >= 16 and max(sizes) < 40_000 / 4  # files of the large one are read several to a task


def test_only_so_many_entities_are_cut(spark, monkeypatch):
    monkeypatch.setattr(ses, "LARGE", 2)
    monkeypatch.setattr(ses, "HOT", 3)
    rows = [(k, min(k // 10, 9), k) for k in range(200)]
    assert ses.large_entities(events(spark, rows)) == [9, 0, 1]
    assert {r.event_id: (r.session_no, r.touch_no) for r in ses.sessionized(events(spark, rows), ses.DAY).collect()} == {k: v[1:] for k, v in expected(rows, 24)[0].items()}
