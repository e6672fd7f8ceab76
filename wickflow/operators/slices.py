"""Row slices: last bars, date splits, forecast contexts and future stamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickflow.operators.clean import by_symbol


def latest_first():
    return Window.partitionBy("symbol").orderBy(F.desc("ts"))


def last_bars(bars: DataFrame, n: int) -> DataFrame:
    return bars.withColumn("back", F.row_number().over(latest_first())).where(F.col("back") <= n).drop("back")


def split_by_date(ts: Column, train_end: str, val_end: str) -> Column:
    """train before the first cut, val before the second, test from there on."""
    return (
        F.when(ts < F.lit(train_end).cast("timestamp"), "train").when(ts < F.lit(val_end).cast("timestamp"), "val").otherwise("test")
    )


def context_slice(bars: DataFrame, lookback: int, horizon: int, start: str | None = None, holdout: int = 7) -> DataFrame:
    """part = context or actual for the bars of a forecast.

    With a start, the first `lookback` bars from there on and what follows. Without, the bars before the last
    `holdout`, and the first of those; a symbol with fewer than lookback + holdout bars gives its last ones as context.
    """
    if start:
        rows = bars.where(F.col("ts") >= F.lit(start).cast("timestamp")).withColumn("k", F.row_number().over(by_symbol()))
        part = F.when(F.col("k") <= lookback, "context").when(F.col("k") <= lookback + horizon, "actual")
        rows = rows.withColumn("n", F.max("k").over(Window.partitionBy("symbol"))).where(F.col("n") >= lookback)
    else:
        if horizon > holdout:
            raise ValueError("the horizon is longer than the holdout")
        rows = bars.withColumn("k", F.row_number().over(latest_first())).withColumn("n", F.count("*").over(Window.partitionBy("symbol")))
        k = F.col("k")
        part = (
            F.when((F.col("n") < lookback + holdout) & (k <= lookback), "context")
            .when(F.col("n") < lookback + holdout, None)
            .when((k > holdout) & (k <= lookback + holdout), "context")
            .when((k > holdout - horizon) & (k <= holdout), "actual")
        )
    return rows.withColumn("part", part).where("part is not null").drop("k", "n")


def future_index(context: DataFrame, horizon: int) -> DataFrame:
    """(symbol, step, ts): stamps after the last one, at its distance from the one before; one bar alone counts a day."""
    last = last_bars(context, 2).groupBy("symbol").agg(F.max("ts").alias("last"), F.min("ts").alias("prev"), F.count("*").alias("n"))
    seconds = F.unix_timestamp(F.col("last").cast("timestamp")) - F.unix_timestamp(F.col("prev").cast("timestamp"))
    gap = F.when(F.col("n") < 2, F.lit(86400)).otherwise(seconds)
    return last.select("symbol", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"), "last", gap.alias("gap")).select(
        "symbol", "step", F.timestamp_seconds(F.unix_timestamp(F.col("last").cast("timestamp")) + F.col("step") * F.col("gap")).alias("ts")
    )


def era(ts: Column, cut: str) -> Column:
    return F.when(ts < F.lit(cut).cast("timestamp"), "before").otherwise("after")


def page(df: DataFrame, order: list, first: int, size: int) -> DataFrame:
    """Rows first .. first + size - 1 in this order."""
    return df.orderBy(*order).offset(first).limit(size)


def find_symbol(df: DataFrame, asked: str) -> DataFrame:
    return df.where(F.col("symbol") == F.upper(F.trim(F.lit(asked))))


def check_batch(history: DataFrame, futures: DataFrame, lookback: int, horizon: int) -> DataFrame:
    """(symbol, history_rows, future_rows, fits): whether each series has the lengths that a batch needs."""
    h = history.groupBy("symbol").agg(F.count("*").alias("history_rows"))
    f = futures.groupBy("symbol").agg(F.count("*").alias("future_rows"))
    both = h.join(f, "symbol", "full").na.fill(0, ["history_rows", "future_rows"])
    return both.withColumn("fits", (F.col("history_rows") == lookback) & (F.col("future_rows") == horizon))
