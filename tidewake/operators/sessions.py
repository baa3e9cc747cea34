"""Gaps between the touches of an entity, sessions cut at long gaps, and gap statistics.

An event whose gap to the one before is at least the limit starts a session, so equality cuts. Events are in the order of
time and event id. Entities of ordinary size are one window each. Those of very many events (``LARGE`` at least, and among
the ``HOT`` largest, so any that holds over a 4096th of all events) are cut into slices of time with about equal numbers of
events: each slice is a window of its own, its summary (first and last time, events, sessions begun, place of the last
beginning) is combined with those before it, and what they carry over is added to the slice's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake.sources.scratch import written

HOUR, DAY = 3_600_000_000, 86_400_000_000
#: Events from which an entity may be cut, how many entities are at most, and the coarse and fine parts of one.
LARGE, HOT, PARTS = 1 << 20, 4096, 16
#: Large entities by what was asked. An old answer gives the same numbers, as it only says which entities are cut.
_FOUND: dict[tuple, list] = {}


def large_entities(touches: DataFrame) -> list:
    """The entities to cut, at most HOT of them: a count by entity, which runs when it is asked for."""
    key = (touches.sparkSession.sparkContext.applicationId, touches.semanticHash(), LARGE, HOT)
    if key not in _FOUND:
        counts = touches.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {LARGE} AND entity IS NOT NULL")
        _FOUND[key] = [r.entity for r in counts.orderBy(F.desc("n"), "entity").limit(HOT).select("entity").collect()]
    return _FOUND[key]


def _parted(touches: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The touches of ordinary entities, and those of large ones, if there are any, with their slices."""
    found = large_entities(touches)
    if not found:
        return touches, None
    ids = F.broadcast(touches.sparkSession.createDataFrame([(x,) for x in found], touches.select("entity").schema))
    return touches.join(ids, "entity", "left_anti"), sliced(touches.join(ids, "entity", "left_semi"))


def sliced(touches: DataFrame) -> DataFrame:
    """``slice``: one of PARTS ** 2 slices of an entity's time, each with about as many of its events. A row of cuts for
    each entity is broadcast, so this is for HOT entities at most."""
    us = F.unix_micros("ts")
    shares = [k / PARTS**2 for k in range(1, PARTS**2)]
    cuts = written(touches.groupBy("entity").agg(F.percentile_approx(us, shares, 10_000).alias("_cuts")), "cuts")
    # The number of cuts up to a time, first among each PARTS-th of them, then among the few in between.
    steps = F.sequence(F.lit(PARTS), F.lit(PARTS**2 - 1), F.lit(PARTS))
    coarse = F.size(F.filter(F.transform(steps, lambda k: F.element_at("_cuts", k)), lambda c: c <= us))
    fine = F.size(F.filter(F.slice("_cuts", coarse * PARTS + 1, F.lit(PARTS - 1)), lambda c: c <= us))
    return touches.join(F.broadcast(cuts), "entity").withColumn("slice", F.greatest(F.lit(0), coarse * PARTS + fine)).drop("_cuts")


def _by_time(*keys: str):
    return Window.partitionBy(*keys).orderBy("ts", "event_id")


def _plain_gaps(touches: DataFrame, *keys: str) -> DataFrame:
    us = F.unix_micros("ts")
    return touches.withColumn("gap_us", us - F.lag(us).over(_by_time(*keys)))


def _sliced_gaps(touches: DataFrame) -> DataFrame:
    """Gaps within slices; the first of a slice goes back to the last time of the slices before."""
    us, key = F.unix_micros("ts"), ["entity", "slice"]
    local = written(_plain_gaps(touches, *key), "gaps")
    last = local.groupBy(*key).agg(F.max(us).alias("_last"))
    last = last.select(*key, F.lag("_last").over(Window.partitionBy("entity").orderBy("slice")).alias("_last"))
    return local.join(F.broadcast(last), key).withColumn("gap_us", F.coalesce("gap_us", us - F.col("_last"))).drop("_last")


def gaps(touches: DataFrame) -> DataFrame:
    """``gap_us`` since the entity's touch before; null for the first."""
    ordinary, large = _parted(touches)
    found = _plain_gaps(ordinary, "entity")
    return found if large is None else found.unionByName(_sliced_gaps(large).drop("slice"))


def _begins(limit_us: int) -> Column:
    return F.col("gap_us").isNull() | (F.col("gap_us") >= limit_us)


def _plain_sessions(touches: DataFrame, limit_us: int) -> DataFrame:
    run = _by_time("entity").rowsBetween(Window.unboundedPreceding, 0)
    numbered = _plain_gaps(touches, "entity").withColumn("session_no", F.sum(F.when(_begins(limit_us), 1).otherwise(0)).over(run))
    return numbered.withColumn("touch_no", F.row_number().over(_by_time("entity", "session_no")))


def _sliced_sessions(gapped: DataFrame, limit_us: int) -> DataFrame:
    key, order = ["entity", "slice"], _by_time("entity", "slice")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    begins = F.when(_begins(limit_us), 1).otherwise(0)
    # Events so far, sessions begun so far, and at which event the last of those began: within the slice.
    local = gapped.withColumns({"_nth": F.row_number().over(order), "_begun": F.sum(begins).over(run)})
    local = written(local.withColumn("_began", F.max(F.when(_begins(limit_us), F.col("_nth"))).over(run)), "sessions")
    sums = local.groupBy(*key).agg(F.max("_nth").alias("_rows"), F.max("_begun").alias("_sessions"), F.max("_began").alias("_began"))
    past = Window.partitionBy("entity").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(past), F.lit(0))
    sums = sums.select(*key, before("_rows").alias("_rows"), before("_sessions").alias("_sessions"), "_began")
    carried = sums.select(*key, "_rows", "_sessions", F.max(F.col("_rows") + F.col("_began")).over(past).alias("_start"))
    start = F.coalesce(F.col("_rows") + F.col("_began"), "_start")
    return local.join(F.broadcast(carried), key).select(
        *[c for c in gapped.columns if c != "slice"], (F.col("_sessions") + F.col("_begun")).alias("session_no"), (F.col("_rows") + F.col("_nth") - start + 1).cast("int").alias("touch_no")
    )


def sessionized(touches: DataFrame, limit_us: int) -> DataFrame:
    """``session_no`` (from 1) and ``touch_no`` within it."""
    ordinary, large = _parted(touches)
    found = _plain_sessions(ordinary, limit_us)
    return found if large is None else found.unionByName(_sliced_sessions(_sliced_gaps(large), limit_us))


def session_family(touches: DataFrame, limits_us: dict[int, int], name: str) -> DataFrame:
    """Sizes of sessions under several limits at once, with the limit's number as a column: one window gives the session
    number of each limit, and the rows are told apart only when they are grouped."""
    ordinary, large = _parted(touches)
    run = _by_time("entity").rowsBetween(Window.unboundedPreceding, 0)
    starts = {k: F.sum(F.when(_begins(v), 1).otherwise(0)).over(run) for k, v in limits_us.items()}
    numbered = _plain_gaps(ordinary, "entity").select("entity", *[s.alias(f"_{k}") for k, s in starts.items()])
    each = F.inline(F.array(*[F.struct(F.lit(k).alias(name), F.col(f"_{k}").alias("session_no")) for k in limits_us]))
    rows = numbered.select("entity", each)
    if large is not None:
        gapped = _sliced_gaps(large)
        for k, limit in limits_us.items():
            rows = rows.unionByName(_sliced_sessions(gapped, limit).select("entity", "session_no", F.lit(k).alias(name)))
    return rows.groupBy(name, "entity", "session_no").agg(F.count(F.lit(1)).alias("n_touches"))


def session_heads(sessions: DataFrame) -> DataFrame:
    """The first touch of each session, with ``next_start`` of the entity's next one. An entity's heads are at least a gap
    apart, so there are never more than its time has gaps."""
    heads = sessions.where("touch_no = 1")
    return heads.withColumn("next_start", F.lead("ts").over(Window.partitionBy("entity").orderBy("session_no")))


def session_sizes(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("entity", "session_no").agg(F.count(F.lit(1)).alias("n_touches"), F.min("ts").alias("start"), F.max("ts").alias("end"))


def gap_histogram(gapped: DataFrame, unit_us: int = DAY, top: int = 120) -> DataFrame:
    """Counts by whole units, those from ``top`` on together."""
    unit = F.least(F.floor(F.col("gap_us") / unit_us), F.lit(top)).alias("unit")
    return gapped.where("gap_us IS NOT NULL").groupBy(unit).agg(F.count(F.lit(1)).alias("n"))


def gap_shares(gapped: DataFrame, cuts: list[int], unit_us: int = DAY) -> DataFrame:
    """Share of gaps below each cut, in one pass."""
    known = gapped.where("gap_us IS NOT NULL")
    one = known.agg(*[F.avg((F.col("gap_us") < c * unit_us).cast("int")).alias(str(c)) for c in cuts])
    pairs = F.array(*[F.struct(F.lit(c).alias("cut"), F.col(f"`{c}`").alias("share")) for c in cuts])
    return one.select(F.inline(pairs))


def smoothed(spark: SparkSession, histogram: DataFrame, top: int = 120, half: int = 3) -> DataFrame:
    """A centred moving mean over all units from 0 to ``top``; what lies outside counts as nothing."""
    dense = spark.range(top + 1).select(F.col("id").alias("unit")).join(F.broadcast(histogram), "unit", "left").fillna(0, ["n"])
    mean = F.sum("n").over(Window.orderBy("unit").rowsBetween(-half, half)) / (2 * half + 1)
    return dense.withColumn("smooth", mean)


def trough(smooth: DataFrame, low: int = 3, high: int = 60) -> DataFrame:
    """The unit of the least smoothed count, the lowest such."""
    return smooth.where(F.col("unit").between(low, high)).agg(F.min(F.struct("smooth", "unit")).alias("m")).select("m.unit", "m.smooth")


def micros_of(ts: Column) -> Column:
    return F.unix_micros(ts)


def micros(name: str) -> Column:
    return F.unix_micros(name).alias(name)
