"""Folders of one's own that driver and executors share, and tables written to them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_PATHS: dict[str, list[str]] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new folder where ``spark.checkpoint.dir`` says; where that is unset and all runs on one machine, in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/written"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _PATHS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of its own that is read back: worked out once, however often it is used, and no lineage above it."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folders(spark: SparkSession) -> int:
    """Deletes the folders that this application has asked for, once no result is read from them any more; how many."""
    paths = _PATHS.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)
