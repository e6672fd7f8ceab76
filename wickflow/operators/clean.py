"""Schema repair, filling and quality checks of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickflow.schema import BAR_COLUMNS, FEATURES, PRICES

TIME_NAMES = ("ts", "timestamps", "timestamp", "date")


def by_symbol():
    """The window of all running figures: a symbol's bars in time order."""
    return Window.partitionBy("symbol").orderBy("ts")


def require_prices(df: DataFrame) -> DataFrame:
    missing = [c for c in PRICES if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def mean_price():
    return (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4


def normalize_schema(df: DataFrame, amount: str = "repair", order: str | None = None) -> DataFrame:
    """symbol, ts and the six features as doubles, in this order, rows with a NULL dropped.

    The time column is the first of TIME_NAMES that is there; without any, days from 2024-01-01 in the order of
    the column `order`. Text that is no number is NULL. A missing volume is 0. amount is volume times the
    mean price where a symbol has none at all; with "predictor", where the column is absent, and 0 if volume is too.
    """
    require_prices(df)
    time = next((c for c in TIME_NAMES if c in df.columns), None)
    if time:
        df = df.withColumn("ts", F.to_timestamp(F.col(time)))
    else:
        within = Window.partitionBy("symbol").orderBy(order)
        df = df.withColumn("ts", F.date_add(F.lit("2024-01-01").cast("date"), F.row_number().over(within) - 1).cast("timestamp"))
    had_volume, had_amount = "volume" in df.columns, "amount" in df.columns
    for c in FEATURES:
        value = F.col(c).cast("string").try_cast("double") if c in df.columns else F.lit(None).cast("double")
        df = df.withColumn(c, F.nanvl(value, F.lit(None)))
    if not had_volume:
        df = df.withColumn("volume", F.lit(0.0))
    made = F.col("volume") * mean_price()
    if amount == "predictor":
        if not had_amount or not had_volume:
            df = df.withColumn("amount", made)
    else:
        none = F.count("amount").over(Window.partitionBy("symbol")) == 0
        df = df.withColumn("amount", F.when(none, made).otherwise(F.col("amount")))
    return df.select("symbol", "ts", *FEATURES).na.drop("any")


def reject_nulls(df: DataFrame) -> DataFrame:
    """The same bars, with an error at run time for a row that has a NULL, whichever columns are read after it."""
    bad = F.lit(False)
    for c in FEATURES:
        bad |= F.col(c).isNull()
    return df.where(F.when(bad, F.raise_error(F.lit("bars have NULLs")).cast("boolean")).otherwise(F.lit(True)))


def column_order(headers: DataFrame) -> DataFrame:
    """headers: file, header (the first line). Whether each has the canonical columns, and in that order."""
    names = F.transform(F.split("header", ","), lambda c: F.trim(c))
    want = F.array(*map(F.lit, BAR_COLUMNS))
    return headers.select("file", (F.array_sort(names) == F.array_sort(want)).alias("same_columns"), (names == want).alias("same_order"))


def number_rows(bars: DataFrame) -> DataFrame:
    """rn: the row of a symbol in time order from 0."""
    return bars.withColumn("rn", F.row_number().over(by_symbol()) - 1)


def fill(df: DataFrame, how: str = "series", keys: tuple[str, ...] = ("symbol",), order: str = "ts") -> DataFrame:
    """NULL features filled from the row before; "series" then looks ahead, "window" does not; what is left is 0."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    filled = {}
    for c in FEATURES:
        values = [F.last(c, ignorenulls=True).over(before)]
        if how == "series":
            values.append(F.first(c, ignorenulls=True).over(ahead))
        filled[c] = F.coalesce(*values, F.lit(0.0))
    return df.withColumns(filled)


def _hits(condition):
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def quality_report(bars: DataFrame, tol: float = 0.01) -> DataFrame:
    """Counts of impossible bars for each symbol: geometry with a tolerance, negative values."""
    o, h, low, c = (F.col(x) for x in PRICES)
    return bars.groupBy("symbol").agg(
        _hits(h + tol < low).alias("high_below_low"),
        _hits(h + tol < o).alias("high_below_open"),
        _hits(h + tol < c).alias("high_below_close"),
        _hits(low - tol > o).alias("low_above_open"),
        _hits(low - tol > c).alias("low_above_close"),
        _hits((o < 0) | (h < 0) | (low < 0) | (c < 0)).alias("negative_price"),
        _hits(F.col("volume") < 0).alias("negative_volume"),
        _hits(F.col("amount") < 0).alias("negative_amount"),
    )


def calendar_report(bars: DataFrame) -> DataFrame:
    """Rows of each symbol outside Monday to Friday, and whether its dates are sound."""
    return bars.groupBy("symbol").agg(
        _hits(F.weekday("ts") > 4).alias("weekend_rows"),
        F.every(F.dayofmonth("ts").between(1, 31) & F.month("ts").between(1, 12)).alias("sound_dates"),
    )


def anomalies(bars: DataFrame, limit: float = 0.15) -> DataFrame:
    """Bars whose close moved by more than the limit against the one before."""
    prev = F.lag("close").over(by_symbol())
    moved = bars.select("symbol", "ts", prev.alias("prev_close"), "close").withColumn(
        "ret", F.try_divide(F.col("close") - F.col("prev_close"), F.col("prev_close"))
    )
    return moved.where(F.abs("ret") > limit)
