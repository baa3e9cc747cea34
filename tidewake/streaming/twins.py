"""Streaming twins of batch operators. Each equals its batch answer on a replay whose rows are late by less than
the watermark; later rows are lost, and state lives as long as the window that it serves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidewake.streaming.attribution import PROVIDER


def stream(spark: SparkSession, path: str, schema: StructType, files_at_once: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def ingest(source: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends what is new in the source and stops; what a checkpoint has seen isn't read again."""
    source.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return source.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(source: DataFrame, keys: list[str], late: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return source.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def sessions(source: DataFrame, gap_seconds: int, late: str) -> DataFrame:
    """Sessions by entity. A window of the whole gap would join events exactly that far apart, which the batch
    operator parts, so its length is a microsecond less."""
    window = F.session_window("ts", f"{gap_seconds * 1_000_000 - 1} microseconds")
    out = source.withWatermark("ts", late).groupBy("entity", window).agg(F.count(F.lit(1)).alias("n_touches"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    return out.select("entity", "n_touches", "start", "end")


def attributed(heads: DataFrame, responses: DataFrame, within: str, late: str) -> DataFrame:
    """(head, response) pairs of an entity with the response after the head and within the window; heads without one
    come once the watermark has passed their window."""
    h = heads.withWatermark("ts", late).alias("h")
    r = responses.select(F.col("entity").alias("r_entity"), F.col("ts").alias("r_ts"), F.col("event_id").alias("response_id")).withWatermark("r_ts", late)
    near = F.expr(f"entity = r_entity AND r_ts > ts AND r_ts <= ts + INTERVAL {within}")
    return h.join(r, near, "leftOuter").select("event_id", "entity", "ts", "response_id")
