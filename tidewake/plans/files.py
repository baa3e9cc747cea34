"""Queries over record files: the given tables are written in each form that the readers know, and read back from it,
in batch and as streams that run through once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewake.operators import frame as fr
from tidewake.operators import sessions as ses
from tidewake.operators import sketches as sk
from tidewake.plans import time
from tidewake.sources import records
from tidewake.sources.scratch import folder
from tidewake.sources.tables import TOUCH_TYPES, load, responses, touches
from tidewake.streaming import attribution as streamed
from tidewake.streaming import twins


def nested_records(spark: SparkSession, sf: str) -> DataFrame:
    """Events as compressed lines of JSON with nested properties; read, flattened, times parsed, addresses cut out."""
    path = folder(spark, "nested")
    e = load(spark, sf, "events")
    sent = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).otherwise(F.unix_millis("ts").cast("string"))
    to = F.concat(F.lit("<U"), F.col("user_id").cast("string"), F.lit("@Mail.example>; u1@ours.example; U"), F.col("user_id").cast("string"), F.lit("@mail.example"))
    properties = F.struct(sent.alias("sent"), to.alias("to"), F.when(F.col("value") > 5, F.concat(F.lit(" "), F.initcap("event_type"), F.lit(" "))).alias("kind"))
    e.select(F.col("event_id").cast("string").alias("id"), properties.alias("properties")).write.option("compression", "gzip").json(path)
    found = records.flat(records.nested(spark, path, ["sent", "to", "kind", "absent"], 8), lowered=("kind",))
    found = found.withColumn("to", records.addresses(F.col("to"), F.col("absent")))
    return found.select(
        F.col("id").cast("long").alias("event_id"), ses.micros_of(records.instant(F.col("sent"))).alias("us"), F.array_join("to", " ").alias("to"), "kind",
        records.local_part(F.get("to", F.lit(0))).alias("local"), records.domain(F.get("to", F.lit(1))).alias("domain"),
    )


def outside_recipients(spark: SparkSession, sf: str) -> DataFrame:
    """Messages as rows for each recipient outside: how many each customer gets."""
    o = load(spark, sf, "orders")
    to = F.array(F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@mail.example")), F.lit("desk@ours.example"))
    rows = records.touches_from(o.select(F.col("o_orderkey").alias("event_id"), to.alias("recipients")), ["ours.example"])
    return rows.groupBy("recipient").agg(F.count(F.lit(1)).alias("n"))


#: Objects of one shard.
SHARD = 1000


def batch_files(spark: SparkSession, sf: str) -> DataFrame:
    """Labels in files of JSON arrays, a file for each batch; read back with the name of the file."""
    path = folder(spark, "batches")
    rows = load(spark, sf, "labels").select(F.struct("doc_id", "quality", "toxic").alias("item"), F.floor(F.col("doc_id") / 500).alias("batch"))
    arrays = rows.groupBy("batch").agg(F.to_json(F.collect_list("item")).alias("value"))
    arrays.repartition("batch").write.partitionBy("batch").text(path)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])
    found = records.batches(spark, path, schema)
    return found.select("doc_id", "quality", "toxic", F.rlike("batch", F.lit(r"^part-")).alias("named"))


def association_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of each customer as shards of JSON objects (of a thousand customers each), read as rows with their place."""
    path = folder(spark, "associations")
    o = load(spark, sf, "orders").groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda x: x.cast("string")).alias("others"))
    shards = o.groupBy(F.floor(F.col("o_custkey") / SHARD).alias("shard")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("o_custkey").cast("string"), "others"))).alias("pairs"))
    shards.repartition("shard").select("shard", F.to_json("pairs").alias("value")).write.partitionBy("shard").text(path)
    return records.associations(spark, path).select(F.col("id").cast("long").alias("id"), "place", F.col("other").cast("long").alias("other"))


def csv_dimension(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark, "csv")
    load(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey").write.option("header", True).csv(path)
    schema = T.StructType([T.StructField("s_suppkey", T.LongType()), T.StructField("s_name", T.StringType()), T.StructField("s_nationkey", T.IntegerType())])
    return records.csv(spark, path, schema)


def owner_teams(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as people with nested teams (the parts they supply), in arrays; read as counts."""
    path = folder(spark, "owners")
    li = load(spark, sf, "lineitem").select("l_suppkey", F.pmod("l_partkey", F.lit(3)).cast("string").alias("team")).distinct()
    teams = li.groupBy("l_suppkey").agg(F.collect_list(F.struct(F.col("team").alias("id"), F.concat(F.lit("t"), F.col("team")).alias("name"))).alias("teams"))
    s = load(spark, sf, "supplier").join(teams, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    people = s.select(F.col("s_suppkey").cast("string").alias("id"), F.concat(F.col("s_name"), F.lit("@Ours.example")).alias("email"), "teams", F.when(F.col("s_acctbal") < 0, True).alias("archived"))
    shards = people.groupBy(F.floor(F.col("id").cast("long") / SHARD).alias("shard")).agg(F.to_json(F.collect_list(F.struct("id", "email", "teams", "archived"))).alias("value"))
    shards.write.partitionBy("shard").text(path)  # a file for each array, as a reader of JSON files takes one value from each
    return records.owners(spark, path)


def listed_ids(spark: SparkSession, sf: str) -> DataFrame:
    """A list of ids with repeats and blanks in text files, as distinct ids in the order of their first line."""
    path = folder(spark, "ids")
    c = load(spark, sf, "customer").select("c_custkey", F.concat(F.lit(" "), F.col("c_nationkey").cast("string")).alias("value"))
    c.orderBy("c_custkey").select("value").write.text(path)
    return fr.numbered(records.id_list(spark, path), "at").select("id", (F.col("nth") + 1).cast("int").alias("nth"))


def results_by_run(spark: SparkSession, sf: str) -> DataFrame:
    """Results of several runs in one JSON table with the runs' parameters as folders, none over another."""
    path = folder(spark, "results")
    per = load(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    for year in (1995, 1996):
        one = load(spark, sf, "orders").where(F.year("o_orderdate") == year).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
        records.write_run(one, path, year=str(year), spec="status")
    records.write_run(per, path, year="all", spec="status")
    records.write_run(per, path, year="all", spec="status")  # a second time replaces its own folder alone
    return records.read_runs(spark, path, per.schema, ["year", "spec"])


def appended_shards(spark: SparkSession, sf: str) -> DataFrame:
    """A table that is appended to twice, the second time with rows of which half are there."""
    path = folder(spark, "appended")
    n = load(spark, sf, "nation").select("n_nationkey", "n_name")
    records.write_table(n.where("n_nationkey < 15"), path)
    records.append_missing(n.where("n_nationkey >= 5"), path, "n_nationkey")
    return spark.read.schema(n.schema).parquet(path)


def keyed_appends(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that come in three parts which overlap, each appended to a bucketed table with filters."""
    path = folder(spark, "keyed")
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", F.pmod(F.xxhash64("o_orderkey"), F.lit(3)).alias("part"))
    for part in range(3):
        records.append_keyed(o.where(F.col("part").isin(part, (part + 1) % 3)).drop("part"), path, "o_orderkey")
    return records.keyed_table(spark, path, o.drop("part").schema)


def sketched_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Entities by day as stored sketches, merged into weeks and into all: whether the estimates lie within four standard
    errors of the exact numbers, which stand beside them."""
    path, day = folder(spark, "sketches"), F.dayofmonth("ts")
    e = load(spark, sf, "events").select("user_id", day.alias("day"), F.floor(day / 7).cast("int").alias("week"))
    sk.sketches(e, ["day", "week"], "user_id").write.parquet(path)
    stored = spark.read.parquet(path)
    exact = e.groupBy("week").agg(F.countDistinct("user_id").alias("entities")).unionByName(e.agg(F.lit(-1).alias("week"), F.countDistinct("user_id").alias("entities")))
    merged = sk.merged(stored, ["week"]).unionByName(sk.merged(stored.withColumn("week", F.lit(-1)), ["week"]))
    off = F.abs(F.col("estimate") - F.col("entities")) <= 4 * sk.ERROR * F.col("entities")
    return exact.join(merged, "week").select("week", "entities", off.alias("within"))


def result_files(spark: SparkSession, sf: str) -> DataFrame:
    """A small result as one CSV file, and batches of a fixed size as JSON; rows of each as read back."""
    one, many = folder(spark, "result"), folder(spark, "numbered")
    per = load(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    records.write_result(per, one)
    numbered = load(spark, sf, "region").select("r_regionkey", F.col("r_regionkey").alias("nth"))
    records.write_batches(numbered, many, 2)
    a = records.csv(spark, one, per.schema).select(F.lit("result").alias("kind"), F.col("o_orderpriority").alias("name"), "n")
    b = spark.read.schema("r_regionkey int, batch long").json(many).groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(b.select(F.lit("batch").alias("kind"), F.col("batch").cast("string").alias("name"), "n"))


SLICES = 4


def _replayed(spark: SparkSession, df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows as a stream of several batches in order of time, and a folder for what comes of it. One row in twenty
    comes a slice of time late."""
    source = folder(spark, f"{name}-in")
    us = F.unix_micros("ts")
    cuts = df.select(us.alias("us")).approxQuantile("us", [k / SLICES for k in range(1, SLICES)], 0.01)
    own = sum((F.when(us > c, 1).otherwise(0) for c in cuts), F.lit(0)) + F.when(F.pmod(F.xxhash64("event_id"), F.lit(20)) == 0, 1).otherwise(0)
    for k in range(SLICES + 1):  # files are read in the order in which they were written
        df.where(own == k).coalesce(1).write.mode("append").parquet(source)
    return twins.stream(spark, source, df.schema), folder(spark, f"{name}-out")


def _with_end(df: DataFrame) -> DataFrame:
    """A row far in the future, which is no result, moves the watermark past all others."""
    more = [F.lit(-1).cast(t).alias(c) if c in ("event_id", "entity") else F.lit("2100-01-01" if c == "ts" else None).cast(t).alias(c) for c, t in df.dtypes]
    return df.unionByName(df.sparkSession.range(1).select(*more))


def _run(spark: SparkSession, stream: DataFrame, out: str) -> DataFrame:
    twins.ingest(stream, out + "/rows", out + "/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(out + "/rows")


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Events taken in by a stream that is started twice: nothing is missing and nothing comes twice."""
    stream, out = _replayed(spark, load(spark, sf, "events").select("event_id", "event_type", "ts"), "ingest")
    _run(spark, stream, out)
    return _run(spark, stream, out).select("event_id", "event_type")


def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Events that come twice, each kept once by a stream with a watermark."""
    t = load(spark, sf, "events").select("event_id", "event_type", "ts")
    stream, out = _replayed(spark, t.unionByName(t), "dedup")
    return _run(spark, twins.deduplicated(stream, ["event_id"], "60 days"), out).select("event_id", "event_type")


def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions by a stream."""
    stream, out = _replayed(spark, _with_end(touches(spark, sf).select("event_id", "entity", "ts")), "sessions")
    found = _run(spark, twins.sessions(stream, 86_400, "60 days"), out).where("entity >= 0")
    return found.select("entity", "n_touches", ses.micros("start"), ses.micros("end"))


def stream_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions, their heads and the heads' answers within three days or up to the next head, by a stream over all events."""
    log = touches(spark, sf).unionByName(responses(spark, sf)).select("event_id", "entity", "ts", "channel")
    stream, out = _replayed(spark, _with_end(log), "attribution")
    found = streamed.attributed(stream, F.col("channel").isin(*TOUCH_TYPES), ses.DAY, 3 * ses.DAY, "60 days")
    return _run(spark, found, out).where("entity >= 0")


NAMES = (
    "nested_records outside_recipients batch_files association_rows csv_dimension owner_teams listed_ids results_by_run appended_shards keyed_appends sketched_entities result_files "
    "stream_ingest stream_dedup stream_sessions stream_attribution"
).split()
QUERIES = {n: globals()[n] for n in NAMES}

SQL = {
    "nested_records": """SELECT event_id, epoch_us(ts) // 1000 * 1000 AS us,
        'u' || user_id || '@mail.example' || ' u1@ours.example' AS "to",
        CASE WHEN value > 5 THEN event_type ELSE '' END AS kind, 'u' || user_id AS local, 'ours.example' AS domain FROM events""",
    "outside_recipients": "SELECT 'c' || o_custkey || '@mail.example' AS recipient, count(*) AS n FROM orders GROUP BY 1",
    "batch_files": "SELECT doc_id, CAST(quality AS INTEGER) AS quality, CAST(toxic AS INTEGER) AS toxic, true AS named FROM labels",
    "association_rows": "SELECT o_custkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS place, o_orderkey AS other FROM orders",
    "csv_dimension": "SELECT s_suppkey, s_name, s_nationkey FROM supplier",
    "owner_teams": """SELECT CAST(s_suppkey AS VARCHAR) AS id, lower(s_name) || '@ours.example' AS email,
        CAST((SELECT count(DISTINCT l_partkey % 3) FROM lineitem WHERE l_suppkey = s_suppkey) AS INTEGER) AS n_teams, s_acctbal < 0 AS archived FROM supplier""",
    "listed_ids": """SELECT CAST(c_nationkey AS VARCHAR) AS id, CAST(row_number() OVER (ORDER BY min(c_custkey)) AS INTEGER) AS nth FROM customer GROUP BY c_nationkey""",
    "results_by_run": """SELECT o_orderstatus, count(*) AS n, 'all' AS year, 'status' AS spec FROM orders GROUP BY 1
        UNION ALL SELECT o_orderstatus, count(*), CAST(year(o_orderdate) AS VARCHAR), 'status' FROM orders WHERE year(o_orderdate) IN (1995, 1996) GROUP BY 1, 3""",
    "appended_shards": "SELECT n_nationkey, n_name FROM nation",
    "keyed_appends": "SELECT o_orderkey, o_custkey FROM orders",
    "sketched_entities": """SELECT CAST(day(ts) // 7 AS INTEGER) AS week, count(DISTINCT user_id) AS entities, true AS within FROM events GROUP BY 1
        UNION ALL SELECT -1, count(DISTINCT user_id), true FROM events""",
    "result_files": """SELECT 'result' AS kind, o_orderpriority AS name, count(*) AS n FROM orders GROUP BY 2
        UNION ALL SELECT 'batch', CAST(r_regionkey // 2 AS VARCHAR), count(*) FROM region GROUP BY 2""",
    "stream_ingest": "SELECT event_id, event_type FROM events",
    "stream_dedup": "SELECT event_id, event_type FROM events",
    "stream_sessions": "WITH" + time._LOG + " SELECT entity, count(*) AS n_touches, min(us) AS \"start\", max(us) AS \"end\" FROM sessions GROUP BY entity, session_no",
    "stream_attribution": "WITH" + time._LOG + " SELECT event_id, entity, session_no, response_id, response_us, n_candidates FROM found",
}
