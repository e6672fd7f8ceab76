"""Risk and trend figures of forecast paths, rankings, screens and dashboard tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickflow.functions.scalars import clip
from wickflow.operators.clean import by_symbol
from wickflow.operators.slices import last_bars, latest_first
from wickflow.schema import FEATURES, PRICES


def trend(ret: Column) -> Column:
    return F.when(ret > 0.03, "UP").when(ret < -0.03, "DOWN").otherwise("SIDEWAY")


def risk_metrics(paths: DataFrame) -> DataFrame:
    """A row for each series from the closes of its last step; percentiles are exact and interpolated."""
    end = Window.partitionBy("symbol", "asof_ts")
    last = paths.withColumn("end", F.max("step").over(end)).where(F.col("step") == F.col("end"))
    q = F.percentile("close", F.array(F.lit(0.05), F.lit(0.95)))
    found = last.groupBy("symbol", "asof_ts", "last_close").agg(
        F.avg("close").alias("pred_close"), F.stddev_pop("close").alias("std"), q.alias("q")
    )
    ret = F.try_divide(F.col("pred_close") - F.col("last_close"), F.col("last_close"))
    return found.select(
        "symbol",
        "asof_ts",
        "last_close",
        "pred_close",
        F.try_divide("std", "pred_close").alias("volatility"),
        F.col("q")[0].alias("p5"),
        F.col("q")[1].alias("p95"),
        (F.col("q")[1] - F.col("q")[0]).alias("width"),
        ret.alias("expected_return"),
        trend(ret).alias("trend"),
    )


def ranking_score(width: Column, pred: Column, ret: Column) -> Column:
    raw = F.try_divide(width, pred) * 600 + F.abs(ret) * 100
    return F.least(F.lit(100), F.greatest(F.lit(0), raw.cast("int")))


def confidence(width: Column, pred: Column) -> Column:
    share = F.try_divide(width, pred)
    return F.when(share > 0.15, 1).when(share > 0.10, 2).when(share > 0.07, 3).when(share > 0.05, 4).otherwise(5)


def confidence_text(stars: Column) -> Column:
    return F.when(stars >= 4, "high").when(stars == 3, "medium").otherwise("low")


def detail_score(width_pct: Column, ret_pct: Column) -> Column:
    return clip(F.round(width_pct * 4 + F.abs(ret_pct) * 4), 0.0, 100.0).cast("int")


def detail_label(score: Column) -> Column:
    return F.when(score < 20, "very low").when(score < 40, "low").when(score < 60, "medium").when(score < 80, "high").otherwise("very high")


def direction_odds(ret: Column) -> tuple[Column, Column, Column]:
    up, down = clip(0.33 + 2.5 * ret, 0.05, 0.85), clip(0.33 - 2 * ret, 0.05, 0.85)
    return up, down, 1.0 - up - down


def display_upper(pred: Column, p5: Column) -> Column:
    return 2 * pred - p5


def dimension(rows: DataFrame, dim: DataFrame, sector: str = "Other", exchange: str = "HOSE") -> DataFrame:
    """Rows with name, sector and exchange; symbols that the dimension lacks get the defaults. Spark sends dim around if it is small."""
    return rows.join(dim, "symbol", "left").withColumns(
        {
            "name": F.coalesce("name", "symbol"),
            "sector": F.coalesce("sector", F.lit(sector)),
            "exchange": F.coalesce("exchange", F.lit(exchange)),
        }
    )


def sparkline(bars: DataFrame, forecast: DataFrame, n: int = 3) -> DataFrame:
    """(symbol, candles): the last n bars and then the forecast steps, each with a flag and its close scaled to 0..1."""
    past = bars.withColumn("k", F.row_number().over(latest_first())).where(F.col("k") <= n)
    past = past.select("symbol", (-F.col("k")).alias("at"), "close", F.lit(False).alias("fcst"))
    both = past.unionByName(forecast.select("symbol", F.col("step").alias("at"), "close", F.lit(True).alias("fcst")))
    w = Window.partitionBy("symbol")
    span = F.max("close").over(w) - F.min("close").over(w)
    scaled = (F.col("close") - F.min("close").over(w)) / F.coalesce(F.nullif(span, F.lit(0.0)), F.lit(1.0))
    rows = both.withColumn("scaled", scaled)
    return rows.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("at", "close", "scaled", "fcst"))).alias("candles"))


def candle_sparkline(bars: DataFrame, forecast: DataFrame, n: int = 3) -> DataFrame:
    """(symbol, at, open, high, low, close, fcst): the last n bars and the forecast's steps as whole candles, scaled to 0..1.

    The scale is from the lowest low to the highest high of all of them; where they are equal all is 0.
    """
    past = bars.withColumn("k", F.row_number().over(latest_first())).where(F.col("k") <= n)
    past = past.select("symbol", (-F.col("k")).alias("at"), *PRICES, F.lit(False).alias("fcst"))
    both = past.unionByName(forecast.select("symbol", F.col("step").alias("at"), *PRICES, F.lit(True).alias("fcst")))
    w = Window.partitionBy("symbol")
    low = F.min("low").over(w)
    span = F.coalesce(F.nullif(F.max("high").over(w) - low, F.lit(0.0)), F.lit(1.0))
    return both.select("symbol", "at", *(((F.col(c) - low) / span).alias(c) for c in PRICES), "fcst")


def rankings(risks: DataFrame, bars: DataFrame, dim: DataFrame, forecast: DataFrame | None = None) -> DataFrame:
    """The ranking table: risk figures with last and previous close, score, confidence and the dimension, best return first.

    With the mean path of a forecast, also sparkline_candles: the last bars and the forecast's steps.
    """
    two = last_bars(bars, 2)
    closes = two.groupBy("symbol").agg(F.max_by("close", "ts").alias("last_bar"), F.min_by("close", "ts").alias("prev_bar"))
    rows = dimension(risks.join(closes, "symbol"), dim)
    if forecast is not None:
        rows = rows.join(sparkline(bars, forecast).withColumnRenamed("candles", "sparkline_candles"), "symbol", "left")
    stars = confidence(F.col("width"), F.col("pred_close"))
    rows = rows.withColumns(
        {
            "risk_score": ranking_score(F.col("width"), F.col("pred_close"), F.col("expected_return")),
            "confidence": stars,
            "confidence_text": confidence_text(stars),
            "volatility_pct": F.col("volatility") * 100,
            "change_pct": F.try_divide(F.col("last_bar") - F.col("prev_bar"), F.col("prev_bar")) * 100,
        }
    )
    order = Window.orderBy(F.desc("expected_return"), "symbol")  # one row a symbol
    return rows.withColumn("place", F.row_number().over(order))


def screen(
    ranked: DataFrame, sector: str | None = None, trend: str | None = None, min_confidence: int | None = None, max_risk: int | None = None
) -> DataFrame:
    for column, value in (("sector", sector), ("trend", trend)):
        if value is not None:
            ranked = ranked.where(F.col(column) == value)
    if min_confidence is not None:
        ranked = ranked.where(F.col("confidence") >= min_confidence)
    if max_risk is not None:
        ranked = ranked.where(F.col("risk_score") <= max_risk)
    return ranked


def risk_alerts(ranked: DataFrame, least: int = 70) -> DataFrame:
    return ranked.where(F.col("risk_score") >= least)


def watched(ranked: DataFrame, watchlist: DataFrame) -> DataFrame:
    return ranked.join(watchlist, "symbol", "left_semi")


def sector_counts(dim: DataFrame) -> DataFrame:
    """Symbols of each sector, and of all as sector NULL."""
    return dim.rollup("sector").agg(F.count("*").alias("n"))


def trend_overview(ranked: DataFrame) -> DataFrame:
    """(trend, n, share_pct, mean_return_pct) with a row for each trend."""
    trends = ranked.sparkSession.createDataFrame([("UP",), ("DOWN",), ("SIDEWAY",)], "trend string")
    counts = ranked.groupBy("trend").agg(F.count("*").alias("n"), F.avg("expected_return").alias("mean"))
    every = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return trends.join(counts, "trend", "left").na.fill(0, ["n"]).select(
        "trend", "n", F.coalesce(F.try_divide(F.col("n") * 100.0, every), F.lit(0.0)).alias("share_pct"), (F.coalesce("mean", F.lit(0.0)) * 100).alias("mean_return_pct")
    )


def risk_bands(ranked: DataFrame) -> DataFrame:
    band = F.when(F.col("risk_score") >= 60, "high").when(F.col("risk_score") >= 40, "medium").otherwise("low")
    return ranked.groupBy(band.alias("band")).agg(F.count("*").alias("n"))


def history_card(bars: DataFrame, n: int = 8) -> DataFrame:
    """By symbol: last and previous close, the range of dates and rows, and the last n closes in order."""
    whole = bars.groupBy("symbol").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_rows"))
    prev = F.coalesce(F.lag("close").over(by_symbol()), F.col("close"))
    tail = last_bars(bars.withColumn("prev", prev), n)
    cards = tail.groupBy("symbol").agg(
        F.max_by("close", "ts").alias("last_close"),
        F.max_by("prev", "ts").alias("prev_close"),
        F.transform(F.array_sort(F.collect_list(F.struct("ts", "close"))), lambda x: x["close"]).alias("closes"),
    )
    return whole.join(cards, "symbol")


def whole_records(risks: DataFrame, paths: DataFrame, bars: DataFrame, frequencies: DataFrame, dim: DataFrame, candles: int = 126) -> DataFrame:
    """(symbol, record): one JSON text for each series with its name, sector and exchange, trend, risk figures, the last
    candles and then the mean path (raw_candles, with fcst), all paths, and the token frequencies, most frequent first.

    frequencies: symbol, token, n. A symbol without them has an empty list, one that the dimension lacks the defaults.
    """

    def listed(rows: DataFrame, name: str, order: list[Column], *fields: str) -> DataFrame:
        one = F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order)), F.struct(*fields).alias("x"))
        return rows.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(one)), lambda r: r["x"]).alias(name))

    mean = paths.groupBy("symbol", "step").agg(F.avg("close").alias("close"))
    past = last_bars(bars, candles).select("symbol", F.date_format("ts", "yyyy-MM-dd").alias("date"), *FEATURES, F.lit(0).alias("step"), F.lit(False).alias("fcst"))
    ahead = mean.select("symbol", F.lit(None).cast("string").alias("date"), *(F.col("close").alias(c) if c == "close" else F.lit(None).cast("double").alias(c) for c in FEATURES), "step", F.lit(True).alias("fcst"))
    parts = [
        listed(past.unionByName(ahead), "raw_candles", [F.col("step"), F.col("date")], "date", *FEATURES, "step", "fcst"),
        listed(paths, "stochastic_paths", [F.col("sample_id"), F.col("step")], "sample_id", "step", "close"),
        listed(frequencies, "xai_data", [-F.col("n"), F.col("token")], "token", F.col("n").alias("frequency")),
    ]
    rows = dimension(risks, dim)
    for part in parts:
        rows = rows.join(part, "symbol", "left")
    figures = F.struct("volatility", "p5", "p95", "width").alias("risk_metrics")
    trend_part = F.struct(F.col("trend").alias("trend_class"), F.col("expected_return").alias("predicted_return")).alias("trend")
    none = F.array().cast("array<struct<token:int,frequency:long>>")
    xai = F.coalesce(F.col("xai_data").cast("array<struct<token:int,frequency:long>>"), none).alias("xai_data")
    return rows.select("symbol", F.to_json(F.struct("symbol", "name", "sector", "exchange", trend_part, figures, "raw_candles", "stochastic_paths", xai)).alias("record"))


def prediction_records(risks: DataFrame, paths: DataFrame) -> DataFrame:
    """(symbol, record): figures, mean path and samples of a series as one JSON text."""
    mean = paths.groupBy("symbol", "step").agg(F.avg("close").alias("close"))
    mean = mean.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("step", "close"))).alias("mean_path"))
    samples = paths.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("sample_id", "step", "close"))).alias("paths"))
    figures = F.struct("volatility", "p5", "p95", "width", "expected_return").alias("risk_metrics")
    rows = risks.join(mean, "symbol").join(samples, "symbol")
    return rows.select("symbol", F.to_json(F.struct("trend", figures, "mean_path", "paths")).alias("record"))
