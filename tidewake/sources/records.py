"""Readers and writers of the record files around the event log: all schemas are given, none is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewake.sources.scratch import written

ADDRESS = r"[A-Za-z0-9._%+\-']+@[A-Za-z0-9.\-]+"
TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd HH:mm:ss")


def nested(spark: SparkSession, path: str, properties: list[str], partitions: int = 0) -> DataFrame:
    """Lines of JSON with an id and nested string properties. Gzip files can't be split, so rows may be dealt anew."""
    inner = T.StructType([T.StructField(p, T.StringType()) for p in properties])
    df = spark.read.schema(T.StructType([T.StructField("id", T.StringType()), T.StructField("properties", inner)])).json(path)
    return df.repartition(partitions, "id") if partitions else df


def flat(df: DataFrame, lowered: tuple[str, ...] = ()) -> DataFrame:
    """The properties as columns; missing ones are empty strings, and those of ``lowered`` lower case and trimmed."""
    names = df.schema["properties"].dataType.fieldNames()
    value = {n: F.coalesce(F.col(f"properties.{n}"), F.lit("")) for n in names}
    return df.select("id", *[(F.lower(F.trim(v)) if n in lowered else v).alias(n) for n, v in value.items()])


def batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files that hold JSON arrays, with the name of each row's file as ``batch``."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.withColumn("batch", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.json)?$", 1))


def associations(spark: SparkSession, path: str) -> DataFrame:
    """JSON objects {id: [other, ...]} in shards, as (id, place, other) rows; of an id in several shards the last one's."""
    shards = spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_name").alias("shard"))
    pairs = shards.select("shard", F.explode(F.from_json("value", "map<string, array<string>>")).alias("id", "others"))
    last = pairs.groupBy("id").agg(F.max_by("others", "shard").alias("others"))
    return last.select("id", F.posexplode("others").alias("place", "other"))


def csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def owners(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of people with nested teams: id, email, number of teams, archived."""
    team = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType())])
    schema = T.StructType([
        T.StructField("id", T.StringType()), T.StructField("email", T.StringType()), T.StructField("teams", T.ArrayType(team)), T.StructField("archived", T.BooleanType()),
    ])
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.select("id", F.lower("email").alias("email"), F.coalesce(F.size("teams"), F.lit(0)).alias("n_teams"), F.coalesce("archived", F.lit(False)).alias("archived"))


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids with the place (file and line) of their first line, which orders them."""
    lines = spark.read.text(path).select(F.trim("value").alias("id"), F.struct(F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("line")).alias("at"))
    return lines.where("id != ''").groupBy("id").agg(F.min("at").alias("at"))


def instant(c: Column) -> Column:
    """A time in UTC from any of the known formats or from epoch milliseconds; null otherwise."""
    tries = [F.try_to_timestamp(c, F.lit(f)) for f in TIME_FORMATS]
    millis = F.when(F.rlike(c, F.lit(r"^\d{11,14}$")), F.timestamp_millis(F.expr("0L") + c.try_cast("long")))
    return F.coalesce(millis, *tries)


def addresses(*fields: Column) -> Column:
    """Distinct addresses of several fields, lower case, in order."""
    joined = F.concat_ws(";", *fields)
    return F.array_distinct(F.transform(F.regexp_extract_all(joined, F.lit(ADDRESS), F.lit(0)), F.lower))


def domain(address: Column) -> Column:
    return F.substring_index(address, "@", -1)


def local_part(address: Column) -> Column:
    return F.substring_index(address, "@", 1)


def touches_from(messages: DataFrame, internal: list[str]) -> DataFrame:
    """One row for each outside recipient of a message (``recipients`` is an array)."""
    out = messages.withColumn("recipient", F.explode("recipients")).drop("recipients")
    return out.where(~domain(F.col("recipient")).isin(*internal))


def write_table(df: DataFrame, path: str, *partitions: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*partitions).parquet(path)


def write_batches(numbered: DataFrame, path: str, size: int) -> None:
    """Batches of a fixed number of rows (``nth`` from 0) as JSON, a folder for each."""
    numbered.withColumn("batch", F.floor(F.col("nth") / size)).drop("nth").repartition("batch").write.mode("overwrite").partitionBy("batch").json(path)


def write_result(df: DataFrame, path: str) -> None:
    """A result of a few rows as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_run(df: DataFrame, path: str, **run: str) -> None:
    """A result as JSON below ``path``, in a folder that names every parameter of its run: other runs stay as they are."""
    where = "/".join(f"{k}={v}" for k, v in run.items())
    df.write.mode("overwrite").json(f"{path}/{where}")


def read_runs(spark: SparkSession, path: str, schema: T.StructType, run: list[str]) -> DataFrame:
    """All runs' results with their parameters as columns."""
    whole = T.StructType([*schema.fields, *[T.StructField(k, T.StringType()) for k in run]])
    return spark.read.schema(whole).json(path)


def append_missing(incoming: DataFrame, path: str, on: str) -> None:
    """Appends the rows whose key the table at ``path`` doesn't have yet."""
    from tidewake.operators.frame import missing

    existing = incoming.sparkSession.read.schema(incoming.schema).parquet(path)
    missing(incoming, existing, on).write.mode("append").parquet(path)


#: Buckets of a keyed table, bits of a filter chunk (which Spark's bitmaps have), and numbers that a key sets.
BUCKETS, BITS, HASHES = 64, 32768, 4


def _keyed(df: DataFrame, on: str) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(on), F.lit(BUCKETS)).cast("int"))


def _marks(keyed: DataFrame, on: str, chunks: int) -> DataFrame:
    """The bits that each key sets in its bucket's filter: a chunk and a bit in it, for each of HASHES numbers."""
    numbers = F.array(*[F.pmod(F.xxhash64(F.lit(k), on), F.lit(chunks * BITS)) for k in range(HASHES)])
    marks = keyed.select("bucket", on, F.explode(numbers).alias("_at"))
    return marks.select("bucket", on, F.floor(F.col("_at") / BITS).cast("int").alias("chunk"), (F.col("_at") % BITS).alias("bit"))


def append_keyed(incoming: DataFrame, path: str, on: str, chunks: int = 16) -> list[int]:
    """Appends the rows whose key the table at ``path`` doesn't have yet, one of each key; the buckets that had to be read.

    The table lies in buckets by a hash of the key. Beside it is a Bloom filter of each bucket, as bitmaps of the keys that
    each append brought. Keys that a filter has never seen are new without a look at the table; only the buckets of the
    others are read, and only those others are compared. ``chunks`` (of 32768 bits for each bucket) stays the same for a table;
    a fuller filter costs reads and no rows. Rows without a key are left out."""
    spark = incoming.sparkSession
    table, filters = f"{path}/table", f"{path}/filters"
    rows = written(_keyed(incoming.where(F.col(on).isNotNull()).dropDuplicates([on]), on), "incoming")
    marks = _marks(rows, on, chunks)
    met: list[int] = []
    fresh = rows
    if exists(spark, filters):
        seen = spark.read.schema("bucket int, chunk int, bits binary").parquet(filters).groupBy("bucket", "chunk").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))
        byte = F.conv(F.hex(F.expr("substring(bits, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
        is_set = F.coalesce(F.expr("shiftright(_byte, cast(bit % 8 as int)) & 1") == 1, F.lit(False))
        looked = marks.join(seen, ["bucket", "chunk"], "left").withColumn("_byte", byte).groupBy("bucket", on).agg(F.bool_and(is_set).alias("maybe"))
        maybe = written(looked.where("maybe").select("bucket", on), "maybe")
        met = sorted(r.bucket for r in maybe.select("bucket").distinct().collect())  # BUCKETS of them at most
        if met:
            schema = T.StructType([f for f in rows.schema.fields if f.name != "bucket"] + [T.StructField("bucket", T.IntegerType())])
            there = spark.read.schema(schema).parquet(table).where(F.col("bucket").isin(met)).select(on)
            fresh = rows.join(maybe.join(there, on, "left_semi").select(on), on, "left_anti")
    fresh = written(fresh, "fresh")
    fresh.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(table)
    new = _marks(fresh, on, chunks).groupBy("bucket", "chunk").agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))
    new.write.mode("append").parquet(filters)
    return met


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def keyed_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/table").drop("bucket")
