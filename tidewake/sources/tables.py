"""Typed loading of the shared tables, and their binding to the event model.

The model has *touches* (event_id, entity, ts, channel, sender, thread_id) and *responses* (event_id, entity,
ts, thread_id). Timestamps are instants in UTC; Parquet ones without a zone are cast once, here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.sources.records import exists

TOUCH_TYPES = ("view", "click")
RESPONSE_TYPES = ("purchase", "signup")
#: Senders of the bound event table: the number in its properties, modulo this.
SENDERS = 20


def spread(df: DataFrame) -> DataFrame:
    """The rows of one single file dealt to all cores: it may hold one row group, which one task would read and work on
    alone. Tables of more files stay as they lie."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if len(df.inputFiles()) == 1 else df


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])


def load_optional(spark: SparkSession, sf_dir: str, name: str) -> DataFrame | None:
    """A table that may not have been made yet; None then."""
    return load(spark, sf_dir, name) if exists(spark, f"{sf_dir}/{name}.parquet") else None


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events with entity, sender and thread (one for each entity and day)."""
    e = load(spark, sf_dir, "events")
    return e.select(
        "event_id", F.col("user_id").alias("entity"), "ts", F.col("event_type").alias("channel"),
        F.pmod(F.get_json_object("props", "$.k").cast("long"), F.lit(SENDERS)).alias("sender"),
        F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("thread_id"),
        "value",
    )


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).where(F.col("channel").isin(*TOUCH_TYPES))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).where(F.col("channel").isin(*RESPONSE_TYPES))


def order_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as touches of a customer; day resolution, so ties are broken by the order's key."""
    o = load(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("entity"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("channel"))
