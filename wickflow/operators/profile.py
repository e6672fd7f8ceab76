"""Profiles of bar tables: coverage, returns, streaks, distributions and correlations."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickflow.functions.scalars import normal_quantile
from wickflow.operators.clean import by_symbol
from wickflow.operators.quantiles import percentiles

QUARTILES = [0.25, 0.5, 0.75]
#: Symbols and dates of a block of correlations (about), and pairs of blocks whose sums a task holds, 3 MB each.
SYMBOLS, DATES, HELD_PAIRS = 256, 512, 24
#: Bins of a bandwidth in a density curve, the last Hermite moment of a bin, and how many bandwidths a bin reaches.
BINS_A_BANDWIDTH, ORDER, REACH = 16, 5, 8


def profile(bars: DataFrame, year: int = 250) -> DataFrame:
    return bars.groupBy("symbol").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_rows")
    ).withColumn("years", F.col("n_rows") / year)


def trading_dates(bars: DataFrame) -> DataFrame:
    return bars.select("ts").distinct()


def missing_map(bars: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """(ts, symbol, missing) for each trading date and symbol. The grid is dates by symbols, the size of a dense bar table."""
    symbols = bars.select("symbol").distinct() if symbols is None else symbols
    grid = trading_dates(bars).join(symbols)
    return grid.join(bars.select("ts", "symbol", F.lit(True).alias("there")), ["ts", "symbol"], "left").select(
        "ts", "symbol", F.col("there").isNull().alias("missing")
    )


def densify(bars: DataFrame) -> DataFrame:
    """A row for every date and symbol, NULL where the symbol has no bar."""
    return trading_dates(bars).join(bars.select("symbol").distinct()).join(bars, ["ts", "symbol"], "left")


def log_returns(bars: DataFrame) -> DataFrame:
    """r = ln(close / previous close); the first bar of a symbol has none."""
    prev = F.lag("close").over(by_symbol())
    return bars.withColumn("r", F.when((prev > 0) & (F.col("close") > 0), F.log(F.col("close") / prev)))


def rolling_volatility(returns: DataFrame, spans: tuple[int, ...] = (20, 50), year: int = 250) -> DataFrame:
    """Sample deviation of the last n returns over a year, NULL until there are n."""
    for n in spans:
        w = by_symbol().rowsBetween(-(n - 1), 0)
        value = F.when(F.count("r").over(w) == n, F.stddev_samp("r").over(w) * F.sqrt(F.lit(float(year))))
        returns = returns.withColumn(f"vol_{n}", value)
    return returns


def flat_runs(bars: DataFrame, min_run: int = 5) -> DataFrame:
    """Longest run of unchanged closes of each symbol, and whether it is longer than min_run."""
    flat = F.col("close").eqNullSafe(F.lag("close").over(by_symbol()))
    rows = bars.select("symbol", "ts", flat.alias("flat"))
    rows = rows.withColumn("island", F.sum(F.when(F.col("flat"), 0).otherwise(1)).over(by_symbol()))
    runs = rows.groupBy("symbol", "island").agg(F.sum(F.col("flat").cast("int")).alias("run"))
    return runs.groupBy("symbol").agg(F.max("run").cast("long").alias("longest")).withColumn("flagged", F.col("longest") > min_run)


def shape(df: DataFrame, column: str, key: str = "symbol", least: int = 10) -> DataFrame:
    """Population skewness and excess kurtosis of a column and of its log, for keys with `least` values or more."""
    logged = F.log(F.col(column) + 1e-5)
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(key)
        .agg(
            F.count("*").alias("n"),
            F.skewness(column).alias("skew_raw"),
            F.kurtosis(column).alias("kurt_raw"),
            F.skewness(logged).alias("skew_log"),
            F.kurtosis(logged).alias("kurt_log"),
        )
        .where(F.col("n") >= least)
    )


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample deviation, minimum, quartiles and maximum of each column, one row for each."""
    long = df.unpivot([], columns, "feature", "value")
    figures = long.groupBy("feature").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
    )
    q = percentiles(long, ["feature"], F.col("value"), QUARTILES)
    return figures.join(q, "feature", "left").select("feature", "n", "mean", "std", "low", *_quartiles(), "high")


def _quartiles() -> list[Column]:
    return [F.col("q")[k].alias(n) for k, n in enumerate(("q25", "q50", "q75"))]


def box(df: DataFrame, value: str, keys: list[Column]) -> DataFrame:
    """Quartiles and whiskers (the outermost values within 1.5 interquartile ranges) by these keys."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("x"))
    names = rows.columns[:-1]
    q = percentiles(rows, names, F.col("x"), QUARTILES).select(*names, *_quartiles())
    low = F.col("q25") - 1.5 * (F.col("q75") - F.col("q25"))
    high = F.col("q75") + 1.5 * (F.col("q75") - F.col("q25"))
    inside = rows.join(q, names).where(F.col("x").between(low, high))
    return inside.groupBy(*names, "q25", "q50", "q75").agg(
        F.min("x").alias("whisker_low"), F.max("x").alias("whisker_high"), F.count("*").alias("n_inside")
    )


def histogram(df: DataFrame, column: str, bins: int = 100, keys: tuple[str, ...] = ()) -> DataFrame:
    """(bin, n, density) over equal bins from the minimum to the maximum, by keys; empty bins are left out."""
    rows = df.where(F.col(column).isNotNull()).select(*keys, F.col(column).alias("x"))
    span = rows.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("total"))
    rows = rows.join(F.broadcast(span)) if not keys else rows.join(span, list(keys))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width == 0, 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / width)))
    counts = rows.select(*keys, at.cast("int").alias("bin"), "lo", "hi", "total").groupBy(*keys, "bin", "lo", "hi", "total").agg(F.count("*").alias("n"))
    return counts.select(*keys, "bin", "n", F.try_divide(F.col("n"), F.col("total") * width).alias("density"))


def density_curve(df: DataFrame, column: str, keys: tuple[str, ...] = (), points: int = 200, cut: float = 3.0) -> DataFrame:
    """(keys, point, x, density): a Gaussian kernel estimate at `points` places from `cut` bandwidths below the least value to as many above the greatest.

    The bandwidth is Scott's: the sample deviation by n to the power -1/5. Values are first counted in bins of a sixteenth of it, each
    with its Hermite moments up to the fifth, so only bins move, and a curve is within 1e-9 of the sum over all values (in units of one
    by bandwidth). NULL and NaN are left out, and so are keys with fewer than two different values. The density of a curve sums to one.
    """
    names = [f"`{k}`" for k in keys]
    rows = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).select(*names, F.col(column).cast("double").alias("x"))
    span = rows.groupBy(*names).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("total"), F.stddev_samp("x").alias("sd"))
    h = F.col("sd") * F.pow(F.col("total").cast("double"), F.lit(-0.2))
    span = span.where("lo < hi").select(*names, "lo", "total", h.alias("h"), (F.col("hi") - F.col("lo")).alias("range"))
    span = span.select("*", (F.col("lo") - cut * F.col("h")).alias("origin"), ((F.col("range") + 2 * cut * F.col("h")) / (points - 1)).alias("step"))
    rows = rows.join(F.broadcast(span)) if not keys else rows.join(span, list(keys))
    bin_ = F.floor((F.col("x") - F.col("lo")) / F.col("h") * BINS_A_BANDWIDTH)
    t = (F.col("x") - F.col("lo")) / F.col("h") - (F.col("bin") + 0.5) / BINS_A_BANDWIDTH
    curve = [*names, "lo", "h", "total", "origin", "step"]
    moments = [F.sum(F.pow(F.col("t"), F.lit(float(k))) / math.factorial(k)).alias(f"m{k}") for k in range(ORDER + 1)]
    bins = rows.withColumn("bin", bin_).withColumn("t", t).groupBy(*curve, "bin").agg(*moments)
    centre = F.col("lo") + (F.col("bin") + 0.5) / BINS_A_BANDWIDTH * F.col("h")
    first, last = (F.ceil((F.col("centre") + side * REACH * F.col("h") - F.col("origin")) / F.col("step")) for side in (-1, 1))
    reach = F.sequence(F.greatest(first, F.lit(0)), F.least(last, F.lit(points - 1)))
    near = bins.withColumn("centre", centre).withColumn("point", F.explode(reach))
    u = (F.col("origin") + F.col("point") * F.col("step") - F.col("centre")) / F.col("h")
    hermite = [F.lit(1.0), F.col("u")]
    for k in range(1, ORDER):
        hermite.append(F.col("u") * hermite[k] - k * hermite[k - 1])
    share = F.exp(-F.col("u") * F.col("u") / 2) * sum((F.col(f"m{k}") * he for k, he in enumerate(hermite)), F.lit(0.0))
    sums = near.withColumn("u", u).groupBy(*names, "point").agg(F.sum(share).alias("mass"))
    every = span.withColumn("point", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))))
    density = F.coalesce("mass", F.lit(0.0)) / (F.col("total") * F.col("h") * math.sqrt(2 * math.pi))
    return every.join(sums, [*keys, "point"], "left").select(*names, "point", (F.col("origin") + F.col("point") * F.col("step")).alias("x"), density.alias("density"))


def correlation_pairs(returns: DataFrame, symbols: int = SYMBOLS, dates: int = DATES) -> DataFrame:
    """(symbol_a, symbol_b, corr) for symbols a < b on their common dates; undefined ones are 0, pairs without a common date are left out.

    Returns become dense blocks of dates by symbols with gaps; each pair of blocks of the same dates is one set of matrix
    products, whose sums (of x, y, their squares and products, and common dates) add up over the dates. So no pair has a row for each date.
    """
    rows = returns.where("r is not null").select("ts", "symbol", "r")
    ends = rows.agg(F.approx_count_distinct("symbol").alias("s"), F.approx_count_distinct("ts").alias("t")).first()
    parts, spans = -(-ends["s"] // symbols) or 1, -(-ends["t"] // dates) or 1
    keyed = rows.withColumns({"part": F.pmod(F.xxhash64("symbol"), F.lit(parts)), "span": F.pmod(F.xxhash64("ts"), F.lit(spans))})
    names = keyed.groupBy("part").agg(F.sort_array(F.collect_set("symbol")).alias("names"))
    cells = F.collect_list(F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("day"), "symbol", "r"))
    blocks = keyed.groupBy("span", "part").agg(cells.alias("cells")).join(names, "part")
    left, right = (blocks.select("span", *(F.col(c).alias(f"{c}_{s}") for c in ("part", "names", "cells"))) for s in "ab")
    pairs = left.join(right, "span").where("part_a <= part_b")
    columns = ["part_a", "part_b", "names_a", "names_b", "cells_a", "cells_b"]
    figures = ("n", "x", "y", "xx", "yy", "xy")
    sums = pairs.select(*columns).mapInArrow(_products, "symbol_a string, symbol_b string, " + ", ".join(f"{f} double" for f in figures))
    n, x, y, xx, yy, xy = (F.col(f) for f in figures)
    found = sums.groupBy("symbol_a", "symbol_b").agg(*(F.sum(f).alias(f) for f in figures))
    va, vb = xx - x * x / n, yy - y * y / n
    corr = F.when((va > 1e-12) & (vb > 1e-12), (xy - x * y / n) / (F.sqrt(va) * F.sqrt(vb)))
    return found.select("symbol_a", "symbol_b", F.coalesce(corr, F.lit(0.0)).alias("corr"))


def _products(batches):
    """Sums over common dates for pairs of symbols a < b, added up for each pair of parts while its blocks come one after another."""
    held: dict[tuple[int, int], list] = {}

    def dense(cells, days, names):
        out = np.full((len(days), len(names)), np.nan)
        at = {s: k for k, s in enumerate(names)}
        fields = cells.values.flatten()
        rows = np.searchsorted(days, fields[0].to_numpy())
        out[rows, [at[s] for s in fields[1].to_pylist()]] = fields[2].to_numpy()
        return out

    def flush():
        for names_a, names_b, total in held.values():
            a, b = np.meshgrid(np.array(names_a, object), np.array(names_b, object), indexing="ij")
            keep = (total[0] > 0) & (a != b)
            if len(names_a) == len(names_b) and names_a == names_b:
                keep &= a < b
            swap = (a > b)[keep]
            n, x, y, xx, yy, xy = (t[keep] for t in total)
            first, second = np.where(swap, b[keep], a[keep]), np.where(swap, a[keep], b[keep])
            values = [n, np.where(swap, y, x), np.where(swap, x, y), np.where(swap, yy, xx), np.where(swap, xx, yy), xy]
            arrays = [pa.array(first, pa.string()), pa.array(second, pa.string()), *(pa.array(v, pa.float64()) for v in values)]
            yield pa.RecordBatch.from_arrays(arrays, ["symbol_a", "symbol_b", "n", "x", "y", "xx", "yy", "xy"])
        held.clear()

    for batch in batches:
        for part_a, part_b, names_a, names_b, cells_a, cells_b in zip(*batch.columns):
            key = part_a.as_py(), part_b.as_py()
            days = np.unique(np.concatenate([c.values.field("day").to_numpy() for c in (cells_a, cells_b)]))
            if key not in held:
                if len(held) == HELD_PAIRS:
                    yield from flush()
                held[key] = [names_a.as_py(), names_b.as_py(), None]
            one = held[key]
            a, b = dense(cells_a, days, one[0]), dense(cells_b, days, one[1])
            here_a, here_b = ~np.isnan(a), ~np.isnan(b)
            a, b, ma, mb = np.nan_to_num(a), np.nan_to_num(b), here_a.astype(float), here_b.astype(float)
            found = np.array([ma.T @ mb, a.T @ mb, ma.T @ b, (a * a).T @ mb, ma.T @ (b * b), a.T @ b])
            one[2] = found if one[2] is None else one[2] + found
    yield from flush()


def rebased(bars: DataFrame) -> DataFrame:
    """Closes as multiples of the first in the table."""
    return bars.withColumn("rebased", F.try_divide(F.col("close"), F.first("close").over(by_symbol())))


def change(bars: DataFrame) -> DataFrame:
    """Change against the previous close and in %; a first bar counts itself as previous."""
    prev = F.coalesce(F.lag("close").over(by_symbol()), F.col("close"))
    return bars.withColumn("change", F.col("close") - prev).withColumn("change_pct", F.try_divide(F.col("close") - prev, prev) * 100)


def qq(returns: DataFrame, column: str = "r", key: str = "symbol") -> DataFrame:
    """(key, theoretical, ordered) pairs against the normal, with Filliben's plotting positions."""
    rows = returns.where(F.col(column).isNotNull()).select(key, F.col(column).alias("ordered"))
    by_value, whole = Window.partitionBy(key).orderBy("ordered"), Window.partitionBy(key)
    rows = rows.withColumn("i", F.row_number().over(by_value)).withColumn("n", F.count("*").over(whole))
    end = F.pow(F.lit(0.5), 1.0 / F.col("n"))
    p = F.when(F.col("i") == F.col("n"), end).when(F.col("i") == 1, 1 - end).otherwise((F.col("i") - 0.3175) / (F.col("n") + 0.365))
    return rows.withColumn("p", p).select(key, "ordered", normal_quantile(F.col("p")).alias("theoretical"))


def qq_fit(pairs: DataFrame, key: str = "symbol") -> DataFrame:
    return pairs.groupBy(key).agg(
        F.regr_slope("ordered", "theoretical").alias("slope"),
        F.regr_intercept("ordered", "theoretical").alias("intercept"),
        F.regr_r2("ordered", "theoretical").alias("r2"),
    )
