"""The folder that driver and executors share, and tables written to it.

Intermediate results that are read more than once are written there as Parquet: a lost executor
costs only the tasks that were running, and the lineage above is cut. Shuffle files of the steps that write them go
at once: Spark else keeps them until the driver happens to collect its garbage, which is late where it has much memory.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of an Arrow batch: long texts would make batches of the default 10,000 rows too large.
BATCH_ROWS = "1024"


#: With this Spark deletes the shuffle files of a query as soon as it has ended.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Tables that this process has written, by application.
_PATHS: dict[str, list[str]] = {}
#: Those that the innermost ``noted`` of this thread takes down.
_NOTED: ContextVar[list[str] | None] = ContextVar("noted", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset and all runs on one machine, one in the warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (path or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/written").rstrip("/")


def keep_path(spark: SparkSession, path: str) -> str:
    """Notes a path that ``drop_written`` deletes."""
    _PATHS.setdefault(spark.sparkContext.applicationId, []).append(path)
    if (paths := _NOTED.get()) is not None:
        paths.append(path)
    return path


@contextmanager
def noted() -> Iterator[list[str]]:
    """The paths that are written meanwhile, in their order."""
    token = _NOTED.set([])
    try:
        yield _NOTED.get()
    finally:
        _NOTED.reset(token)


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Queries that run meanwhile leave no shuffle files."""
    before = spark.conf.get(CLEANED, "false")
    spark.conf.set(CLEANED, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANED, before)


def written(df: DataFrame, name: str, schema: StructType | None = None) -> DataFrame:
    """``df`` written as a table of its own in the shared folder, and read from it (as ``schema``, if its types have
    another view of the same data)."""
    spark = df.sparkSession
    path = keep_path(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    with cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables at these paths, once nothing reads them any more; those that are gone already are passed over."""
    known = _PATHS.get(spark.sparkContext.applicationId, [])
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        if path in known:
            known.remove(path)


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` gave, once nothing reads them any more."""
    for table in tables:
        spark = table.sparkSession
        folders = {file.split("/")[-2] for file in table.inputFiles()}
        drop_paths(spark, [p for p in _PATHS.get(spark.sparkContext.applicationId, []) if p.rpartition("/")[2] in folders])


def drop_written(spark: SparkSession) -> int:
    """Deletes the tables that this application's calls of ``written`` left, once no result is read from them any more;
    how many there were."""
    paths = _PATHS.pop(spark.sparkContext.applicationId, [])
    drop_paths(spark, paths)
    return len(paths)


def quoted(name: str) -> str:
    """A column's name as an expression takes it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def as_row(df: DataFrame) -> Column:
    """All columns as one struct, within which no name can clash with an operator's own."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns])


def small_batches(spark: SparkSession) -> None:
    """Limits the rows of the Arrow batches that Python tasks get."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one single file, which may hold one row group that one task would work on alone, is dealt to all cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.repartition(spark.sparkContext.defaultParallelism) if name == "documents" and len(df.inputFiles()) == 1 else df
