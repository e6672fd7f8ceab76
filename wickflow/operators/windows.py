"""Sliding windows: enumeration, leak-free splits, statistics, normalisation and export.

A window is a row (symbol, start) with figures from row frames; where its rows are needed, a frame gathers them as an
array. All frames share one specification, so a table of windows takes one exchange and one sort by symbol, and bars are
never sent once for each window that holds them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickflow.functions.scalars import clip as clipped
from wickflow.operators.clean import by_symbol, fill, mean_price, number_rows
from wickflow.operators.slices import split_by_date
from wickflow.schema import CLIP, FEATURES, GAP, HORIZON, LOOKBACK, MAX_NULL, STD_EPSILON, STD_GUARD


def _ahead(first: int, last: int):
    return by_symbol().rowsBetween(first, last)


def make_windows(bars: DataFrame, lookback: int = LOOKBACK, horizon: int = HORIZON, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """A row for each start that has lookback + horizon + 1 rows of its symbol before it ends.

    ts_first, ts_target (first row after the lookback), ts_last, asof_ts, the share of NULL cells, and the mean and
    population deviation of each feature over the lookback.
    """
    width = lookback + horizon + 1
    cells = reduce(lambda a, b: a + b, (F.col(c).isNull().cast("int") for c in features))
    rows = number_rows(bars).withColumn("n", F.count("*").over(Window.partitionBy("symbol")))
    rows = rows.withColumn("cells", cells)
    out = rows.select(
        "symbol",
        F.col("rn").alias("start"),
        "n",
        F.col("ts").alias("ts_first"),
        F.lead("ts", lookback - 1).over(by_symbol()).alias("asof_ts"),
        F.lead("ts", lookback).over(by_symbol()).alias("ts_target"),
        F.lead("ts", width - 1).over(by_symbol()).alias("ts_last"),
        (F.sum("cells").over(_ahead(0, width - 1)) / (width * len(features))).alias("null_share"),
        *(F.avg(c).over(_ahead(0, lookback - 1)).alias(f"{c}_mean") for c in features),
        *(F.stddev_pop(c).over(_ahead(0, lookback - 1)).alias(f"{c}_std") for c in features),
    )
    return out.where(F.col("start") + width <= F.col("n")).drop("n")


def assign_split(
    bars: DataFrame, windows: DataFrame, train_end: str, val_end: str, lookback: int = LOOKBACK, gap: int = GAP
) -> DataFrame:
    """Windows with their split; those that fit none go.

    train ends before train_end. val has its first target at least `gap` rows after the first row from train_end on, and
    ends before val_end; test likewise after val_end. Lookbacks may reach back over a cut.
    """
    # the first row from a day on has as many rows before it as there are earlier ones
    before = {n: F.count(F.when(F.col("ts") < F.lit(day).cast("timestamp"), 1)).alias(n) for n, day in (("train_cut", train_end), ("val_cut", val_end))}
    cuts = bars.groupBy("symbol").agg(*before.values())
    target = F.col("start") + lookback
    split = (
        F.when(F.col("ts_last") < F.lit(train_end).cast("timestamp"), "train")
        .when((target >= F.col("train_cut") + gap) & (F.col("ts_last") < F.lit(val_end).cast("timestamp")), "val")
        .when(target >= F.col("val_cut") + gap, "test")
    )
    return windows.join(cuts, "symbol").withColumn("split", split).where("split is not null").drop("train_cut", "val_cut")


def drop_sparse(windows: DataFrame, max_null: float = MAX_NULL) -> DataFrame:
    return windows.where(F.col("null_share") <= max_null)


def window_counts(bars: DataFrame, lookback: int = LOOKBACK, horizon: int = HORIZON, max_null: float = MAX_NULL) -> DataFrame:
    """total, valid and discarded windows of each symbol, and the discarded in %; windows of lookback + horizon rows."""
    windows = make_windows(bars, lookback, horizon - 1)
    return windows.groupBy("symbol").agg(
        F.count("*").alias("total"), F.sum((F.col("null_share") <= max_null).cast("long")).alias("valid")
    ).select("symbol", "total", "valid", (F.col("total") - F.col("valid")).alias("discarded"), (100.0 * (F.col("total") - F.col("valid")) / F.col("total")).alias("discarded_pct"))


def min_window_std(bars: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """(symbol, feature, min_std): the smallest deviation of any full window without NULL."""
    w = by_symbol().rowsBetween(-(lookback - 1), 0)
    rows = bars.select("symbol", *(F.when(F.count(c).over(w) == lookback, F.stddev_pop(c).over(w)).alias(c) for c in FEATURES))
    return rows.groupBy("symbol").agg(*(F.min(c).alias(c) for c in FEATURES)).unpivot("symbol", list(FEATURES), "feature", "min_std")


def zero_std_symbols(stds: DataFrame) -> DataFrame:
    return stds.groupBy("feature").agg(F.count(F.when(F.col("min_std") == 0, 1)).alias("zero_symbols"))


def gathered(rows: DataFrame, width: int, columns: dict[str, Column]) -> DataFrame:
    """(symbol, start, rows): each full window of numbered rows with these columns of its rows, as one array.

    Rows may have a column `wanted`; windows whose first row lacks it go.
    """
    picked = F.col("wanted") if "wanted" in rows.columns else F.lit(True)
    out = rows.select(
        "symbol",
        F.col("rn").alias("start"),
        F.count("*").over(_ahead(0, width - 1)).alias("n"),
        picked.alias("picked"),
        F.collect_list(F.struct(*(c.alias(n) for n, c in columns.items()))).over(_ahead(0, width - 1)).alias("rows"),
    )
    return out.where((F.col("n") == width) & F.col("picked")).drop("n", "picked")


def _moments(values: str, n: int) -> tuple[Column, Column]:
    """Mean and population deviation of the first n elements of an array column."""
    part = F.slice(values, 1, n)
    mean = F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / n
    square = F.aggregate(part, F.lit(0.0), lambda a, x: a + (x - F.col(f"{values}_mean")) * (x - F.col(f"{values}_mean")))
    return mean, F.sqrt(square / n)


def scale(x: Column, mean: Column, std: Column, clip: float | None = CLIP) -> Column:
    """(x - mean) / (std + 1e-5), with a deviation below 1e-6 taken as 1, clipped."""
    safe = F.when(std < STD_GUARD, F.lit(1.0)).otherwise(std)
    z = (x - mean) / (safe + F.lit(STD_EPSILON))
    return z if clip is None else clipped(z, -clip, clip)


def unscale(z: Column, mean: Column, std: Column) -> Column:
    """The inverse of scale without a clip."""
    safe = F.when(std < STD_GUARD, F.lit(1.0)).otherwise(std)
    return z * (safe + F.lit(STD_EPSILON)) + mean


def window_arrays(
    bars: DataFrame, windows: DataFrame | None = None, lookback: int = LOOKBACK, horizon: int = HORIZON, clip: float = CLIP
) -> DataFrame:
    """(symbol, start, ts, the features, z_ of each feature) as arrays: the rows of each window, filled inside it, and their z-scores.

    The scores are by the window's lookback, so no figure comes from after it. NULLs take the last value before them in the
    window, or 0. That value is found once for each bar, with its row, and counts if the row lies in the window. Without
    `windows`, all full windows are taken, and bars move once, to their symbol.
    """
    width = lookback + horizon + 1
    upto = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    rows = number_rows(bars)
    if windows is not None:
        first = windows.select("symbol", F.col("start").alias("rn"), F.lit(True).alias("wanted"))
        rows = rows.join(first, ["symbol", "rn"], "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))
    held = {c: F.last(c, True).over(upto) for c in FEATURES}
    since = {f"{c}_at": F.last(F.when(F.col(c).isNotNull(), F.col("rn")), True).over(upto) for c in FEATURES}
    rows = rows.withColumns(since | {f"{c}_held": v for c, v in held.items()})
    found = gathered(rows, width, {"ts": F.col("ts"), **{n: F.col(n) for c in FEATURES for n in (f"{c}_held", f"{c}_at")}})

    def inside(c: str) -> Column:
        return F.transform("rows", lambda r: F.when(r[f"{c}_at"] >= F.col("start"), r[f"{c}_held"]).otherwise(0.0)).alias(c)

    def scores(c: str) -> Column:
        return F.transform(c, lambda x: scale(x, F.col(f"{c}_mean"), F.col(f"{c}_std"), clip))

    found = found.select("symbol", "start", F.transform("rows", lambda r: r["ts"]).alias("ts"), *map(inside, FEATURES))
    found = found.withColumns({f"{c}_mean": _moments(c, lookback)[0] for c in FEATURES})
    found = found.withColumns({f"{c}_std": _moments(c, lookback)[1] for c in FEATURES})
    return found.select("symbol", "start", "ts", *FEATURES, *(scores(c).alias(f"z_{c}") for c in FEATURES))


def normalize_windows(
    bars: DataFrame, windows: DataFrame | None = None, lookback: int = LOOKBACK, horizon: int = HORIZON, clip: float = CLIP
) -> DataFrame:
    """window_arrays as rows (symbol, start, pos, ts, features, z-scores)."""
    found = window_arrays(bars, windows, lookback, horizon, clip)
    names = found.columns[2:]
    zipped = found.select("symbol", "start", F.posexplode(F.arrays_zip(*names)).alias("pos", "r"))
    return zipped.select("symbol", "start", "pos", *(F.col(f"r.{n}").alias(n) for n in names))


def export_windows(arrays: DataFrame, stamps: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(symbol, start, x, stamp): each window of window_arrays as arrays of floats, in order, for training; stamps are functions of ts."""
    rows = F.transform(F.arrays_zip(*(f"z_{c}" for c in FEATURES)), lambda r: F.array(*(r[f"z_{c}"].cast("float") for c in FEATURES)))
    times = F.transform("ts", lambda t: F.array(*(f(t).cast("float") for f in stamps.values())))
    return arrays.select("symbol", "start", rows.alias("x"), times.alias("stamp"))


def clip_rate(bars: DataFrame, width: int = LOOKBACK, clip: float = CLIP) -> DataFrame:
    """(feature, rate): share of cells in all full windows whose z-score within the window is beyond the clip."""
    w = by_symbol().rowsBetween(0, width - 1)
    figures = {f"{c}_{n}": f(c).over(w) for c in FEATURES for n, f in (("mean", F.avg), ("std", F.stddev_pop))}
    rows = number_rows(bars).withColumns(figures)
    found = rows.select("*", F.count("*").over(w).alias("n"), F.collect_list(F.struct(*FEATURES)).over(w).alias("rows")).where(F.col("n") == width)

    def beyond(c: str) -> Column:
        far = F.filter("rows", lambda r: F.abs(scale(r[c], F.col(f"{c}_mean"), F.col(f"{c}_std"), None)) > clip)
        return (F.sum(F.size(far)) / (F.count("*") * width)).alias(c)

    return found.agg(*map(beyond, FEATURES)).unpivot([], list(FEATURES), "feature", "rate")


def leak_report(bars: DataFrame, lookback: int = LOOKBACK, horizon: int = HORIZON, column: str = "close") -> DataFrame:
    """By symbol: how far z-scores of the lookback move if the statistics see the whole window, and the window that shifts most."""
    width = lookback + horizon
    w_past, w_all, w_next = _ahead(0, lookback - 1), _ahead(0, width - 1), _ahead(lookback, width - 1)
    rows = number_rows(bars).withColumn("n", F.count("*").over(Window.partitionBy("symbol")))
    x = F.col(column)
    stats = rows.select(
        "symbol",
        "rn",
        "n",
        x.alias("x"),
        F.avg(x).over(w_past).alias("m1"),
        F.stddev_pop(x).over(w_past).alias("s1"),
        F.avg(x).over(w_all).alias("m2"),
        F.stddev_pop(x).over(w_all).alias("s2"),
        F.avg(x).over(w_next).alias("m3"),
    ).where(F.col("rn") + width <= F.col("n"))
    diff = F.abs(scale(F.col("x"), F.col("m1"), F.col("s1"), None) - scale(F.col("x"), F.col("m2"), F.col("s2"), None))
    shift = F.abs(F.col("m3") - F.col("m1"))
    return stats.groupBy("symbol").agg(
        F.avg(diff).alias("mean_diff"), F.max(diff).alias("max_diff"), F.max(F.struct(shift, -F.col("rn"))).alias("most")
    ).select("symbol", "mean_diff", "max_diff", (-F.col("most.col2")).cast("long").alias("most_shifted_start"))


def sample_starts(windows: DataFrame, n: int, seed: int = 42, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """n windows of each key, the first by a hash of the seed, symbol and start."""
    order = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), "symbol", F.col("start").cast("string")))
    ranked = windows.withColumn("draw", F.row_number().over(order.orderBy(key, "symbol", "start")))
    return ranked.where(F.col("draw") <= n).drop("draw")


def benchmark_windows(bars: DataFrame, split: str, train_end: str, val_end: str, lookback: int = LOOKBACK, n: int = 100, seed: int = 42) -> DataFrame:
    """(symbol, start, pos, ts and features): the rows of at most n windows of each symbol, drawn inside one split.

    Rows are split by date first; amount is repaired where the split has none of a symbol; NULLs are filled from before, then from
    after, then 0. Symbols with fewer than `lookback` rows there give none. Starts are drawn before rows are touched, and meet
    them by buckets of `lookback` rows, of which a window has two at most: windows that are not drawn are never built.
    """
    rows = bars.where(split_by_date(F.col("ts"), train_end, val_end) == split)
    none = F.count("amount").over(Window.partitionBy("symbol")) == 0
    rows = rows.withColumn("amount", F.when(none, F.col("volume") * mean_price()).otherwise(F.col("amount")))
    rows = number_rows(fill(rows, "series")).withColumn("bucket", F.floor(F.col("rn") / lookback))
    counts = rows.groupBy("symbol").agg(F.count("*").cast("int").alias("rows")).where(F.col("rows") >= lookback)
    starts = sample_starts(counts.select("symbol", F.explode(F.sequence(F.lit(0), F.col("rows") - lookback)).alias("start")), n, seed)
    ends = F.array_distinct(F.array(F.floor(F.col("start") / lookback), F.floor((F.col("start") + lookback - 1) / lookback)))
    found = starts.withColumn("bucket", F.explode(ends)).join(rows, ["symbol", "bucket"])
    found = found.where((F.col("rn") >= F.col("start")) & (F.col("rn") < F.col("start") + lookback))
    return found.select("symbol", "start", (F.col("rn") - F.col("start")).alias("pos"), "ts", *FEATURES)
