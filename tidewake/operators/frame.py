"""Building an analysis frame: routes united and de-duplicated, lookups, filters with their losses, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.sources.scratch import written

BUCKET_SECONDS = 7200


def time_bucket(ts: Column | str, seconds: int = BUCKET_SECONDS) -> Column:
    """Which two-hour floor a time is in; events on both sides of a floor stay apart."""
    return F.floor(F.unix_seconds(F.col(ts) if isinstance(ts, str) else ts) / seconds)


def preferred(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in the order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def united(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two capture routes as one log, tagged."""
    return first.withColumn("route", F.lit("sync")).unionByName(second.withColumn("route", F.lit("log")))


def deduplicated_routes(log: DataFrame, key: list[str]) -> DataFrame:
    """Equal key in the same time bucket is one event; the synchronised route is preferred."""
    rank = F.when(F.col("route") == "sync", 0).otherwise(1)
    return preferred(log.withColumn("_bucket", time_bucket("ts")), [*key, "_bucket"], [rank, F.col("ts"), F.col("event_id")]).drop("_bucket")


def missing(incoming: DataFrame, existing: DataFrame, on: str) -> DataFrame:
    """What is not there yet: the part of an ingest that still has to be read."""
    return incoming.join(existing.select(on), on, "left_anti")


def waterfall(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """Rows left after each filter in turn and rows that it took, in one pass."""
    running, counts = F.lit(True), [F.count(F.lit(1)).alias("s0")]
    for i, (_, ok) in enumerate(steps, 1):
        running = running & F.coalesce(ok, F.lit(False))
        counts.append(F.count_if(running).alias(f"s{i}"))
    one = df.agg(*counts)
    rows = [F.struct(F.lit(0).alias("step"), F.lit("all").alias("name"), F.col("s0").alias("n"), F.lit(0).cast("long").alias("dropped"))]
    for i, (name, _) in enumerate(steps, 1):
        rows.append(F.struct(F.lit(i).alias("step"), F.lit(name).alias("name"), F.col(f"s{i}").alias("n"), (F.col(f"s{i - 1}") - F.col(f"s{i}")).alias("dropped")))
    return one.select(F.inline(F.array(*rows)))


def fill_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Of each column, how many values are neither null nor an empty string."""
    full = {c: F.col(c).isNotNull() & (F.col(c).cast("string") != "") for c in columns}
    one = df.agg(F.count(F.lit(1)).alias("_all"), *[F.count_if(e).alias(c) for c, e in full.items()])
    rows = [F.struct(F.lit(c).alias("column"), F.col(c).alias("filled"), (F.col(c) / F.col("_all")).alias("share")) for c in columns]
    return one.select(F.inline(F.array(*rows)))


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """Counts and shares of their row, with totals ('all')."""
    cells = df.cube(row, column).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    name = lambda c, bit: F.when(F.col("_g").bitwiseAND(bit) > 0, "all").otherwise(F.col(c)).alias(c)
    named = cells.select(name(row, 2), name(column, 1), "n")
    total = F.max(F.when(F.col(column) == "all", F.col("n"))).over(Window.partitionBy(row))
    return named.withColumn("share", F.col("n") / total)


def ranked_lookup(left: DataFrame, offered: DataFrame, key: str, matches: Column, *order: str) -> DataFrame:
    """The offered row that matches, else the first, for each key; ``how`` says which."""
    best = preferred(offered.withColumn("_match", F.coalesce(matches, F.lit(False))), [key], [F.desc("_match"), *map(F.col, order)])
    best = best.withColumn("how", F.when(F.col("_match"), "match").otherwise("first")).drop("_match")
    return left.join(best, key, "left").withColumn("how", F.coalesce("how", F.lit("none")))


def first_filled(*columns: str) -> Column:
    return first_filled_of(*map(F.col, columns))


def first_filled_of(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values])


def without_clash(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """A join that refuses columns which both sides have, besides the key, and keys that repeat on the right."""
    clash = (set(left.columns) & set(right.columns)) - set(on)
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    # A repeated key ends the query where it is read; with partial counts it costs one grouping of the right side.
    others = [c for c in right.columns if c not in on]
    one = right.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"), F.first(F.struct(*others) if others else F.lit(1)).alias("_first"))
    failed = F.raise_error(F.concat(F.lit("a key repeats on the right: "), F.to_json(F.struct(*on)))).cast("int")
    one = one.withColumn("_rows", F.when(F.col("_rows") > 1, failed).otherwise(1)).where("_rows = 1")
    one = one.select(*on, *([F.col(f"_first.`{c}`").alias(c) for c in others]))
    return left.join(one, on, how)


def optional(left: DataFrame, right: DataFrame | None, on: list[str]) -> DataFrame:
    return left if right is None else without_clash(left, right, on)


def visible_months(out: DataFrame, addressed: DataFrame, threaded: DataFrame) -> DataFrame:
    """Sender months with at least one incoming event, addressed to them or in a thread of theirs that month."""
    key = ["sender", "month"]
    base = out.groupBy(*key).agg(F.count(F.lit(1)).alias("n_out"))
    to = addressed.groupBy(*key).agg(F.count(F.lit(1)).alias("n_to"))
    own = out.where("thread_id IS NOT NULL").select(*key, "thread_id").distinct()
    seen = threaded.where("thread_id IS NOT NULL").select("thread_id", "month").distinct()
    thread = own.join(seen, ["thread_id", "month"]).groupBy(*key).agg(F.count(F.lit(1)).alias("n_thread"))
    found = base.join(to, key, "left").join(thread, key, "left").fillna(0, ["n_to", "n_thread"])
    return found.withColumn("ok", F.greatest("n_to", "n_thread") > 0)


def range_chunks(df: DataFrame, bucket: Column, period: Column, most: int) -> DataFrame:
    """Ranges of buckets within a period that never hold more than ``most`` rows, unless one bucket alone does: periods
    are halved, and halves again, until each part is small enough or one bucket wide.

    Counts by bucket come first; the halving looks at them alone, level by level, as sums over aligned ranges of
    2 ** level buckets, and a range stays where it is small enough and its double is not.
    """
    fine = df.groupBy(period.alias("period"), bucket.cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    # As many doublings as the buckets of a period need to lie in one range.
    apart = F.col("_low").bitwiseXOR(F.col("_high"))
    top = fine.groupBy("period").agg(F.min("bucket").alias("_low"), F.max("bucket").alias("_high"))
    top = top.select("period", F.least(F.lit(62), F.when(apart == 0, 0).otherwise(F.length(F.bin(apart)))).alias("_top"))
    levels = F.explode(F.sequence(F.lit(0), F.coalesce("_top", F.lit(0))))
    sums = fine.join(top, "period", "left").select("period", "bucket", "n", levels.alias("level")).withColumn("part", F.expr("shiftright(bucket, level)"))
    sums = sums.groupBy("period", "level", "part").agg(F.min("bucket").alias("low"), F.max("bucket").alias("high"), F.sum("n").alias("n"))
    fits = (F.col("n") <= most) | (F.col("level") == 0)
    above = sums.select("period", (F.col("level") - 1).alias("level"), F.col("part").alias("whole"), (F.col("n") <= most).alias("covered"))
    found = sums.where(fits).withColumn("whole", F.expr("shiftright(part, 1)")).join(above, ["period", "level", "whole"], "left")
    return found.where(~F.coalesce("covered", F.lit(False))).select("period", "low", "high", "n")


def ranked(df: DataFrame, by: list[str], part: Column, order: list[Column], name: str) -> DataFrame:
    """``name``: the place (from 0) of each row among those that agree in ``by``.

    ``part`` is a number that never falls along the order. Rows are counted by part first, and only those of a part
    are sorted together, so no group has to fit into one task.
    """
    parted = df.withColumn("_part", part)
    sizes = parted.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_size"))
    running = F.sum("_size").over(Window.partitionBy(*by).orderBy("_part") if by else Window.orderBy("_part"))
    before = sizes.select(*by, "_part", (running - F.col("_size")).alias("_before"))
    nth = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)) - 1 + F.col("_before")
    return parted.join(before, [*by, "_part"]).withColumn(name, nth).drop("_part", "_before")


def in_ranges(df: DataFrame, *order: str) -> DataFrame:
    """``_range``: the range of the order that a row lies in. Spark samples the bounds, so ranges have about as many rows
    each, however uneven the keys are; the rows are written, as another sample could draw other bounds."""
    return written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")


def with_previous(df: DataFrame, by: str, key: str, value: str, name: str) -> DataFrame:
    """``name``: the value of the row before (by a key) among those that agree in ``by``.

    Only the rows of a range of keys are sorted together; the first of each takes the last value of the ranges before, of
    which there is one row each."""
    ranged = in_ranges(df, key)
    lasts = ranged.groupBy(by, "_range").agg(F.max_by(value, key).alias("_own"))
    lasts = lasts.select(by, "_range", F.lag("_own").over(Window.partitionBy(by).orderBy("_range")).alias("_last"))
    order = Window.partitionBy(by, "_range").orderBy(key)
    found = ranged.withColumns({name: F.lag(value).over(order), "_nth": F.row_number().over(order)}).join(lasts, [by, "_range"])
    return found.withColumn(name, F.when(F.col("_nth") == 1, F.col("_last")).otherwise(F.col(name))).drop("_range", "_nth", "_last")


def numbered(df: DataFrame, key: str) -> DataFrame:
    """``nth`` (from 0) in order of a key, whose ranges are counted first."""
    return ranked(in_ranges(df, key), [], F.col("_range"), [F.col(key)], "nth").drop("_range")


def hashed(key: str, seed: str | Column) -> Column:
    return F.md5(F.concat_ws("#", F.col(key).cast("string"), F.lit(seed)))


def hash_part(hash_: Column) -> Column:
    """One of 4,096 ranges of a hash."""
    return F.conv(F.substring(hash_, 1, 3), 16, 10).cast("int")


def hashed_order(key: str, seed: str) -> list[Column]:
    """An order that depends on key and seed alone, not on where rows lie."""
    return [hashed(key, seed), F.col(key)]


def sampled(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    return df.orderBy(*hashed_order(key, seed)).limit(n)


def booster(df: DataFrame, primary: DataFrame, key: str, klass: str, seed: str, n: int) -> DataFrame:
    """Up to n more rows of each class, none of them in the primary sample."""
    rest = df.join(primary.select(key), key, "left_anti")
    return rest.withColumn("_n", F.row_number().over(Window.partitionBy(klass).orderBy(*hashed_order(key, seed)))).where(F.col("_n") <= n).drop("_n")


def share_of(df: DataFrame, key: str, seed: str, share: float) -> DataFrame:
    """About that share of the rows, by a seeded hash of the key: the same rows whatever else is in the table."""
    return df.where(F.substring(hashed(key, seed), 1, 7) < f"{int(share * 16**7):07x}")


def examples(df: DataFrame, key: str, klass: str, seed: str, n: int) -> DataFrame:
    """n rows of each class in a seeded order."""
    ranked_ = ranked(df, [klass], hash_part(hashed(key, seed)), hashed_order(key, seed), "_n")
    return ranked_.where(F.col("_n") < n).drop("_n")


def content_identity(subset: DataFrame, source: DataFrame, key: str, columns: list[str], by: str) -> DataFrame:
    """By class of ``by``: rows of the subset, those whose content differs from the source's, and those it doesn't have."""
    digest = F.sha2(F.to_json(F.struct(*columns)), 256)
    a, b = subset.select(key, by, digest.alias("_a")), source.select(key, digest.alias("_b"))
    out = a.join(b, key, "left").groupBy(by)
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_a") != F.col("_b")).alias("changed"), F.count_if(F.col("_b").isNull()).alias("unknown"))


def common(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many distinct keys two tables share."""
    return left.select(key).intersect(right.select(key)).agg(F.count(F.lit(1)).alias("n_common"))


def distinct_union(parts: list[DataFrame], key: str) -> DataFrame:
    """Rows of several frames, one for each key: that of the first frame that has it."""
    both = None
    for k, part in enumerate(parts):
        one = part.withColumn("_set", F.lit(k))
        both = one if both is None else both.unionByName(one)
    return both.groupBy(key).agg(F.min_by(F.struct(*[c for c in parts[0].columns if c != key]), "_set").alias("_r"), F.count(F.lit(1)).alias("n_frames")).select(key, "_r.*", "n_frames")


def top_values(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """The k most frequent values of each column, ties by value."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])))
    counts = long.where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
