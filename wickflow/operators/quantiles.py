"""Exact percentiles of groups of any size, by narrowing histograms.

A round counts the values of each open interval in buckets that keep their order: first by sign and logarithm, then linearly between
the least and the largest value of a bucket. Only the buckets that hold a wanted rank stay open, and one whose values are all equal is
an answer. So a round aggregates a bounded number of counters for each group, whatever its size, and after the first ones few rows are
left. No values of a group ever meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickflow.storage import checkpoint

#: Buckets for each doubling of the value in the first round, and in each interval of the later ones.
LOG_BUCKETS, LINEAR_BUCKETS = 16, 4096
#: Rows of the largest group up to which the built-in percentile is taken, which holds a group's distinct values in one task.
MOST = 1_000_000


def log_bucket(x: Column) -> Column:
    """A number that grows with x: 0 for 0, below it for negative values."""
    size = F.least(F.lit(1100.0), F.greatest(F.lit(-1100.0), F.log2(F.abs(x)))) + 1101
    at = F.floor(size * LOG_BUCKETS)
    return F.when(x > 0, at).when(x < 0, -at).otherwise(F.lit(0)).cast("long")


def linear_bucket(x: Column, low: Column, high: Column) -> Column:
    """Which of the equal parts of an interval x lies in; halves keep the differences of very large values finite."""
    share = F.try_divide(x / 2 - low / 2, high / 2 - low / 2)
    return F.least(F.lit(LINEAR_BUCKETS - 1), F.floor(F.coalesce(share, F.lit(0.0)) * LINEAR_BUCKETS)).cast("long")


def _found(counts: DataFrame, wanted: DataFrame, names: list[str]) -> DataFrame:
    """(names, rank, low, high, base) of the bucket of each wanted rank; counts: names, base, bucket, n, low, high."""
    before = Window.partitionBy(*names, "base").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    upto = counts.withColumn("first", F.col("base") + F.coalesce(F.sum("n").over(before), F.lit(0)))
    both = wanted.join(upto.drop("bucket"), [*names, "base"])
    inside = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))
    return both.where(inside).select(*names, "rank", "low", "high", F.col("first").alias("base"))


def values_at(rows: DataFrame, names: list[str], ranks: DataFrame) -> DataFrame:
    """(names, rank, v): the values at these ranks, from 0 in ascending order. rows: names and x, without NULL or NaN; names not NULL."""
    figures = [F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")]
    wanted = ranks.withColumn("base", F.lit(0).cast("long"))
    counts = rows.groupBy(*names, F.lit(0).cast("long").alias("base"), log_bucket(F.col("x")).alias("bucket")).agg(*figures)
    done = None
    while True:
        state = checkpoint(_found(counts, wanted, names))
        ready = state.where("low = high").select(*names, "rank", F.col("low").alias("v"))
        done = ready if done is None else done.unionAll(ready)
        open_ranks = state.where("low < high")
        if open_ranks.isEmpty():
            return done
        spans = open_ranks.select(*names, "base", "low", "high").distinct()
        near = rows.join(spans, names).where(F.col("x").between(F.col("low"), F.col("high")))
        bucket = linear_bucket(F.col("x"), F.col("low"), F.col("high")).alias("bucket")
        counts = near.select(*names, "base", bucket, "x").groupBy(*names, "base", "bucket").agg(*figures)
        wanted = open_ranks.select(*names, "rank", "base")


def percentiles(df: DataFrame, keys: list[str], value: Column, shares: list[float], most: int = MOST) -> DataFrame:
    """(keys, q): the interpolated percentiles of each group, as the built-in percentile gives them; NULL and NaN don't count.

    The built-in one is taken if the largest group has at most `most` rows. Groups without values are left out; keys may be NULL.
    """
    rows = df.select(*keys, F.nanvl(value.cast("double"), F.lit(None)).alias("x")).where("x is not null")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    if (sizes.agg(F.max("n")).first()[0] or 0) <= most:
        found = rows.groupBy(*keys).agg(F.percentile("x", F.array(*map(F.lit, shares))).alias("q"))
        return found.where("q is not null")
    # one column without NULL in place of the keys, for joins
    group = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")
    places = F.array(*(F.lit(s) * (F.col("n") - 1) for s in shares))
    asked = sizes.select(*keys, group.alias("group"), places.alias("places"))
    ends = F.array_distinct(F.concat(F.transform("places", lambda p: F.floor(p)), F.transform("places", lambda p: F.ceil(p))))
    found = values_at(rows.select(group.alias("group"), "x"), ["group"], asked.select("group", F.explode(ends).alias("rank")))
    held = found.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))

    def between(p: Column) -> Column:
        low, high = F.col("at")[F.floor(p)], F.col("at")[F.ceil(p)]
        return F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    return asked.join(held, "group").select(*keys, F.transform("places", between).alias("q"))
