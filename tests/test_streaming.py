import random
import tempfile

from pyspark.sql import functions as F

from tidewake.operators import attribution as att
from tidewake.operators import sessions as ses
from tidewake.sources.tables import responses, touches
from tidewake.streaming import attribution as streamed
from tidewake.streaming import twins

SF = "/root/testdata/sf0.001"
END = "event_id long, entity long, ts timestamp"


def fresh():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def in_order(df, files=3):
    """The rows as files in order of time, with a last row far in the future that lets the watermark pass."""
    path = fresh()
    spark = df.sparkSession
    rows = df.select("event_id", "entity", "ts").orderBy("ts").collect()
    step = -(-len(rows) // files)
    for k in range(files):
        spark.createDataFrame(rows[k * step : (k + 1) * step], END).coalesce(1).write.mode("append").parquet(path)
    for days in (400, 401):
        last = df.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("entity"), F.expr(f"ts + INTERVAL {days} DAYS").alias("ts"))
        last.coalesce(1).write.mode("append").parquet(path)
    return path


def drained(df, mode="append"):
    name = f"t{abs(hash(fresh()))}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", fresh()).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_ingest_reads_only_what_is_new(spark):
    src, out, mark = fresh(), fresh(), fresh()
    spark.range(5).write.mode("append").parquet(src)
    schema = spark.range(1).schema
    for more in (0, 3):
        if more:
            spark.range(100, 100 + more).write.mode("append").parquet(src)
        twins.ingest(twins.stream(spark, src, schema), out, mark).awaitTermination()
        assert spark.read.parquet(out).count() == 5 + more


def test_streamed_sessions_equal_batch(spark):
    df = touches(spark, SF)
    path = in_order(df)
    got = drained(twins.sessions(twins.stream(spark, path, spark.read.parquet(path).schema), 86_400, "1 hour")).where("entity >= 0")
    want = ses.session_sizes(ses.sessionized(df, ses.DAY)).select("entity", "n_touches", "start", "end")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_events_exactly_a_gap_apart_are_parted(spark):
    rows = spark.sql("SELECT 1L AS event_id, 1L AS entity, timestamp'2024-01-01 00:00:00' AS ts UNION ALL SELECT 2L, 1L, timestamp'2024-01-02 00:00:00'")
    path = in_order(rows, 1)
    got = drained(twins.sessions(twins.stream(spark, path, spark.read.parquet(path).schema), 86_400, "1 hour")).where("entity >= 0")
    assert got.count() == 2 == ses.session_sizes(ses.sessionized(rows, ses.DAY)).count()


def test_streamed_dedup_keeps_one_of_each_key(spark):
    df = touches(spark, SF)
    path = in_order(df.unionByName(df))
    got = drained(twins.deduplicated(twins.stream(spark, path, spark.read.parquet(path).schema), ["event_id", "entity"], "2 days")).where("entity >= 0")
    assert got.count() == df.count() == got.select("event_id").distinct().count()


def test_streamed_attribution_equals_batch(spark):
    heads, answers = touches(spark, SF).where("event_id % 9 = 0"), responses(spark, SF)
    a, b = in_order(heads), in_order(answers)
    streams = [twins.stream(spark, p, spark.read.parquet(p).schema, 10) for p in (a, b)]
    got = drained(twins.attributed(*streams, "3 DAYS", "1 hour")).where("entity >= 0").select("event_id", "response_id")
    h, r = heads.alias("h"), answers.alias("r")
    on = F.expr("h.entity = r.entity AND r.ts > h.ts AND r.ts <= h.ts + INTERVAL 3 DAYS")
    want = h.join(r, on, "left").select(F.col("h.event_id"), F.col("r.event_id").alias("response_id"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


LOG = "event_id long, entity long, ts timestamp, touch boolean"


def log_files(spark, batches):
    """A file for each batch of (event_id, entity, hour, touch) rows, in order; a far row moves the watermark on."""
    path = fresh()
    start = F.lit("2024-01-01").cast("timestamp")
    for rows in [*batches, [(-1, -1, 1e6, True)], [(-2, -1, 1e6 + 1, True)]]:
        df = spark.createDataFrame(rows, "event_id long, entity long, hour double, touch boolean")
        df = df.select("event_id", "entity", F.timestamp_micros((F.unix_micros(start) + F.col("hour") * 3_600_000_000).cast("long")).alias("ts"), "touch")
        df.coalesce(1).write.mode("append").parquet(path)
    return path


def streamed_heads(spark, path, late):
    stream = twins.stream(spark, path, spark.read.parquet(path).schema)
    found = streamed.attributed(stream, F.col("touch"), ses.DAY, 3 * ses.DAY, late)
    out = fresh()
    twins.ingest(found, out + "/rows", out + "/checkpoint").awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema(streamed.ROWS).parquet(out + "/rows").where("entity >= 0").collect())


def batch_heads(rows):
    heads = ses.session_heads(ses.sessionized(rows.where("touch"), ses.DAY))
    found = att.attributed(heads, att.candidates(heads, rows.where("NOT touch"), 3 * ses.DAY, "entity", "entity", 0))
    return sorted(tuple(r) for r in found.select("event_id", "entity", "session_no", "response_id", "response_us", "n_candidates").collect())


def test_streamed_heads_equal_batch_whatever_the_order(spark):
    rng = random.Random(4)
    rows = [(k, rng.randrange(6), float(rng.randrange(600)), rng.random() < 0.6) for k in range(700)]  # whole hours: many ties
    in_time = sorted(rows, key=lambda r: r[2] + rng.uniform(0, 100))  # up to 100 hours late
    path = log_files(spark, [in_time[k * 140 : (k + 1) * 140] for k in range(5)])
    want = batch_heads(spark.read.parquet(path).where("entity >= 0"))
    assert streamed_heads(spark, path, "101 hours") == want
    assert any(r[3] is None for r in want) and any(r[5] > 1 for r in want)


def test_a_deadline_is_the_next_head_included(spark):
    # Head 1 at 0; head 3 at 48 and response 2 at the same time, which is the first head's; 4 at 121 is out of 3's window of 72 hours.
    rows = [(1, 7, 0.0, True), (2, 7, 48.0, False), (3, 7, 48.0, True), (4, 7, 120.5, False), (5, 8, 5.0, True), (6, 8, 5.0, False)]
    got = streamed_heads(spark, log_files(spark, [rows]), "1 hour")
    us = lambda h: int(1704067200_000_000 + h * 3_600_000_000)
    assert got == [(1, 7, 1, 2, us(48), 1), (3, 7, 2, None, None, 0), (5, 8, 1, None, None, 0)]


def test_rows_behind_the_watermark_are_lost_and_heads_come_as_soon_as_settled(spark):
    batches = [[(1, 7, 0.0, True), (9, 9, 200.0, True)], [(10, 9, 201.0, True)], [(2, 7, 10.0, False), (3, 7, 199.5, True)]]
    got = streamed_heads(spark, log_files(spark, batches), "1 hour")
    assert [(r[0], r[3]) for r in got] == [(1, None), (3, None), (9, None)]
