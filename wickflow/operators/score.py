"""Forecasts: a pluggable function over groups of bars, and forecasters that need no model."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickflow.functions.scalars import keyed_uniform
from wickflow.operators.clean import by_symbol, number_rows
from wickflow.schema import PRICES

#: (context of one series, horizon, samples, seed) to rows sample_id, step, open, high, low, close.
Forecaster = Callable[[pd.DataFrame, int, int, int], pd.DataFrame]
PATH_SCHEMA = "symbol string, asof_ts timestamp, sample_id int, step int, open double, high double, low double, close double, status string, error string"


def score(contexts: DataFrame, forecaster: Forecaster, horizon: int, samples: int, seed: int = 42, least: int = 1) -> DataFrame:
    """Paths of each series (symbol, asof_ts). A series that is too short or that raises ValueError gives one row with
    status skipped and the reason. A group is one series' context, whose length the caller bounds.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ts")
        symbol, asof = frame["symbol"].iloc[0], frame["asof_ts"].iloc[0]
        names = [f.split()[0] for f in PATH_SCHEMA.split(", ")]
        try:
            if len(frame) < least:
                raise ValueError(f"{len(frame)} bars, {least} needed")
            paths = forecaster(frame, horizon, samples, seed).assign(status="ok", error=None)
        except ValueError as error:
            paths = pd.DataFrame([{"status": "skipped", "error": str(error)}])
        return paths.assign(symbol=symbol, asof_ts=asof).reindex(columns=names)

    rows = contexts.withColumn("asof_ts", F.col("asof_ts").cast("timestamp")).withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.groupBy("symbol", "asof_ts").applyInPandas(run, PATH_SCHEMA)


def last_value(frame: pd.DataFrame, horizon: int, samples: int, seed: int) -> pd.DataFrame:
    """Every step of every sample repeats the last bar."""
    last = {c: float(frame[c].iloc[-1]) for c in PRICES}
    return pd.DataFrame([{"sample_id": s, "step": k + 1} | last for s in range(samples) for k in range(horizon)])


def eligible(bars: DataFrame, asked: DataFrame, lookback: int) -> DataFrame:
    """(symbol, status) of the asked symbols: ok, short or unknown."""
    counts = bars.groupBy("symbol").agg(F.count("*").alias("n_bars"))
    status = F.when(F.col("n_bars").isNull(), "unknown").when(F.col("n_bars") < lookback, "short").otherwise("ok")
    return asked.join(counts, "symbol", "left").select("symbol", F.coalesce("n_bars", F.lit(0)).alias("n_bars"), status.alias("status"))


def baselines(bars: DataFrame, lookback: int, horizon: int) -> DataFrame:
    """Bars with three forecasts of the close `horizon` rows on: the last close, its mean over the lookback, and its drift."""
    back = by_symbol().rowsBetween(-(lookback - 1), 0)
    full = F.count("close").over(back) == lookback
    drift = F.col("close") + horizon * (F.col("close") - F.first("close").over(back)) / (lookback - 1)
    return bars.withColumns(
        {
            "pred_last": F.when(full, F.col("close")),
            "pred_mean": F.when(full, F.avg("close").over(back)),
            "pred_drift": F.when(full, drift),
        }
    )


def resampled_paths(bars: DataFrame, lookback: int, horizon: int, samples: int, seed: int = 42) -> DataFrame:
    """(symbol, asof_ts, last_close, sample_id, step, close): returns of a series' last bars, drawn again by keyed numbers.

    A step's return is the one at index floor(u * returns); draws meet returns in an equi-join on (symbol, index).
    """
    back = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    rows = bars.withColumn("back", F.row_number().over(back)).where(F.col("back") <= lookback)
    prev = F.lag("close").over(by_symbol())
    rows = rows.withColumn("ratio", F.try_divide(F.col("close"), prev))
    last = rows.groupBy("symbol").agg(
        F.max("ts").alias("asof_ts"), F.max_by("close", "ts").alias("last_close"), F.count("ratio").alias("n")
    )
    pool = rows.where("ratio is not null").select(
        "symbol", (F.row_number().over(by_symbol()) - 1).alias("index"), "ratio"
    )
    draws = last.where("n > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample_id"))
    draws = draws.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    u = keyed_uniform(F.lit(seed), F.col("symbol"), F.col("sample_id"), F.col("step"))
    draws = draws.withColumn("index", F.floor(u * F.col("n")).cast("int"))
    path = Window.partitionBy("symbol", "sample_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    joined = draws.join(pool, ["symbol", "index"])
    return joined.withColumn("close", F.col("last_close") * F.exp(F.sum(F.log("ratio")).over(path))).select(
        "symbol", "asof_ts", "last_close", "sample_id", "step", "close"
    )


def mean_path(paths: DataFrame, columns: tuple[str, ...] = ("close",)) -> DataFrame:
    """The mean over samples at each step, of the closes or of every feature that the paths have."""
    return paths.groupBy("symbol", "asof_ts", "step").agg(*(F.avg(c).alias(c) for c in columns))


def fan(paths: DataFrame) -> DataFrame:
    """Paths and, as sample -1, their mean, each led by the last close as step 0."""
    mean = paths.groupBy("symbol", "last_close", "step").agg(F.avg("close").alias("close")).withColumn("sample_id", F.lit(-1))
    every = paths.select("symbol", "sample_id", "step", "close", "last_close").unionByName(mean.select("symbol", "sample_id", "step", "close", "last_close"))
    lead = every.where("step = 1").select("symbol", "sample_id", F.lit(0).alias("step"), F.col("last_close").alias("close"), "last_close")
    return every.unionByName(lead).drop("last_close")


def realised(forecast: DataFrame, bars: DataFrame, horizon: int, columns: tuple[str, ...] = ("close",)) -> DataFrame:
    """Forecast steps beside the bars that came: forecast has symbol, asof_ts, step and the columns, close or all prices."""
    rows = number_rows(bars).select("symbol", "rn", F.col("ts").alias("real_ts"), *(F.col(c).alias(f"real_{c}") for c in columns))
    at = rows.select("symbol", F.col("real_ts").alias("asof_ts"), F.col("rn").alias("asof_rn"))
    steps = forecast.join(at, ["symbol", "asof_ts"]).withColumn("rn", F.col("asof_rn") + F.col("step"))
    return steps.join(rows, ["symbol", "rn"], "left").select(
        "symbol", "asof_ts", "step", "real_ts", *columns, *(f"real_{c}" for c in columns)
    )


def step_changes(forecast: DataFrame) -> DataFrame:
    """Change of each forecast step against the one before; the first against the last close."""
    w = Window.partitionBy("symbol").orderBy("step")
    prev = F.coalesce(F.lag("close").over(w), F.col("last_close"))
    return forecast.withColumn("change", F.col("close") - prev).withColumn("change_pct", F.try_divide(F.col("close") - prev, prev) * 100)
