"""Exact quantiles of groups of any size, by refinement of histograms.

Values are counted first. Of a group with few different values the counts are summed in order. Of others the range is cut
into cells of equal width, cells are counted, and the one that holds the wanted place is looked into again, from its
least value to its greatest, until few different values are left in it. No task ever holds more than a histogram or
``FEW`` values of a group. Rounds run while the plan is built; one group in a thousand or none needs any.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.sources.scratch import written

#: Cells of a histogram, and different values that are sorted together.
CELLS = FEW = 4096
MOST = 1.7976931348623157e308


def _met(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with equal keys, null ones too; the right side's keys go."""
    other = right.select(*[F.col(k).alias(f"_{k}") if k in keys else F.col(k) for k in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return left.join(other, same).drop(*[f"_{k}" for k in keys])


def _refined(counts: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """Each bracket's cell that holds its place: between two values that occur."""
    met = _met(counts, brackets, keys).where("v BETWEEN low AND high")
    share = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
    cells = met.groupBy(*keys, "place", "skip", F.least(F.lit(CELLS - 1), F.floor(share * CELLS)).alias("cell"))
    cells = cells.agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("d"))
    upto = F.col("skip") + F.sum("n").over(Window.partitionBy(*keys, "place").orderBy("cell"))
    found = cells.withColumn("_upto", upto).where("_upto > place AND _upto - n <= place")
    return found.select(*keys, "place", (F.col("_upto") - F.col("n")).alias("skip"), "low", "high", "d")


def quantiles(df: DataFrame, by: list[str], measures: dict[str, Column], shares: list[float]) -> DataFrame:
    """``by``, measure, share, value: quantiles of numeric columns within groups, between two values as the share lies
    between their places. Nulls and NaN don't count; a group without a value has no row."""
    keys = [*by, "measure"]
    each = F.inline(F.array(*[F.struct(F.lit(n).alias("measure"), c.cast("double").alias("v")) for n, c in measures.items()]))
    rows = df.select(*by, each).where("v IS NOT NULL AND NOT isnan(v)").withColumn("v", F.greatest(F.lit(-MOST), F.least(F.lit(MOST), "v")))
    counts = written(rows.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n")), "value-counts")
    groups = counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"), F.min("v").alias("low"), F.max("v").alias("high"))
    at = F.explode(F.array(*map(F.lit, shares))).alias("share")
    spots = groups.select("*", at).withColumn("_at", F.col("share") * (F.col("n") - 1))
    below = F.floor("_at")
    pair = F.array(F.struct(below.alias("place"), (1 - F.col("_at") + below).alias("weight")), F.struct((below + 1).alias("place"), (F.col("_at") - below).alias("weight")))
    spots = spots.select(*keys, "share", "low", "high", "d", F.inline(F.filter(pair, lambda x: x["weight"] > 0)))
    brackets = written(spots.select(*keys, "place", F.lit(0).cast("long").alias("skip"), "low", "high", "d").distinct(), "brackets")
    while not (wide := brackets.where(F.col("d") > FEW)).isEmpty():
        brackets = written(brackets.where(F.col("d") <= FEW).unionByName(_refined(counts, wide, keys)), "brackets")
    few = _met(counts, brackets, keys).where("v BETWEEN low AND high")
    upto = F.col("skip") + F.sum("n").over(Window.partitionBy(*keys, "place").orderBy("v"))
    values = few.withColumn("_upto", upto).where("_upto > place AND _upto - n <= place").select(*keys, "place", "v")
    found = _met(spots.select(*keys, "share", "place", "weight"), values, [*keys, "place"])
    return found.groupBy(*keys, "share").agg(F.sum(F.col("weight") * F.col("v")).alias("value"))


def with_quantiles(summary: DataFrame, df: DataFrame, by: list[str], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """``summary``, a row for each group, with quantiles as columns: name: (measure, share)."""
    measures = {str(c): c for c, _ in wanted.values()}
    found = quantiles(df, by, measures, sorted({s for _, s in wanted.values()}))
    hit = lambda c, s: (F.col("measure") == str(c)) & (F.col("share") == s)
    columns = found.groupBy(*by).agg(*[F.max(F.when(hit(c, s), F.col("value"))).alias(n) for n, (c, s) in wanted.items()])
    other = columns.select(*[F.col(k).alias(f"_{k}") if k in by else F.col(k) for k in columns.columns])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by], F.lit(True))
    return summary.join(other, same, "left").drop(*[f"_{k}" for k in by])
