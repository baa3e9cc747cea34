"""Distinct counts by sketches that are stored once and merged at will: days into weeks, sources into all."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Binary logarithm of a sketch's registers, and the standard error that follows (relative; small numbers are exact).
REGISTERS = 12
ERROR = 1.04 / math.sqrt(1 << REGISTERS)


def sketches(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by`` and a sketch of the distinct values, of a few kilobytes whatever their number."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(value, F.lit(REGISTERS)).alias("sketch"))


def merged(stored: DataFrame, by: list[str]) -> DataFrame:
    """Stored sketches of parts as one for each of ``by``, and its estimate."""
    one = stored.groupBy(*by).agg(F.hll_union_agg("sketch", F.lit(False)).alias("sketch"))
    return one.select(*by, "sketch", F.hll_sketch_estimate("sketch").alias("estimate"))
