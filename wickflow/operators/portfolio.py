"""Top-k portfolios over a table of predictions: returns, turnover, fees, curves and statistics.

After aggregation there is a row for each date, so the running figures sort a short series; they are
partitioned by `run`, and several runs (models, splits) proceed side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickflow.functions.scalars import pearson
from wickflow.operators.quality import direction, every_nth_date, wide_dates, with_ranks, with_sides
from wickflow.schema import FEE, MIN_SYMBOLS, PERIODS_A_YEAR, RISK_FREE, TOP_K

CURVES = ("long", "ls", "bench", "long_mag", "ls_mag")


def _ln1p(x: Column) -> Column:
    return F.when(x > -1, F.log1p(x))


def _weighted(side: str, sign: int, top_k: int) -> tuple[Column, Column, Column]:
    """Return, members and divisor of a side weighted by the size of the prediction; without any of its sign, all weigh the same."""
    weight = F.when(F.col(side) & (F.col("pred_return") * sign > 0), F.col("pred_return") * sign)
    mean = F.avg(F.when(F.col(side), F.col("actual_return")))
    value = F.coalesce(F.try_divide(F.sum(weight * F.col("actual_return")), F.sum(weight)), mean)
    members = F.when(
        F.count(weight) > 0, F.sort_array(F.collect_list(F.when(weight.isNotNull(), F.col("symbol"))))
    ).otherwise(F.sort_array(F.collect_list(F.when(F.col(side), F.col("symbol")))))
    divisor = F.when(F.count(weight) > 0, F.count(weight)).otherwise(F.lit(top_k))
    return value, members, divisor


def portfolio_returns(rows: DataFrame, top_k: int = TOP_K, min_symbols: int = MIN_SYMBOLS, fee: float = FEE, every: int = 5) -> DataFrame:
    """A row for each rebalance date: equal-weight and magnitude-weighted returns, turnover, and net log returns.

    Dates are each `every`-th, then those with enough symbols. The first portfolio is all turnover. Fees come off the
    log returns. A return of -1 or less has no log and gives NULL. rows: the columns of eval_rows; with a column `run`, of
    which a date has one, each run goes by itself. rank_ic and hit_rate of the date come with them.
    """
    keys = ("run",) if "run" in rows.columns else ()
    rows = wide_dates(every_nth_date(rows, every, keys=keys), min_symbols)
    sides = with_sides(with_ranks(with_ranks(rows, "pred_return", "rp"), "actual_return", "ra"), top_k)
    up, up_set, up_div = _weighted("is_long", 1, top_k)
    down, down_set, down_div = _weighted("is_short", -1, top_k)
    won = F.when(F.col("is_long"), F.when(F.col("actual_return") > 0, 1.0).otherwise(0.0))
    days = sides.groupBy(*keys, "t_date").agg(
        F.when(F.count("*") >= 3, F.coalesce(pearson("rp", "ra"), F.lit(0.0))).alias("rank_ic"),
        (F.avg(won) * 100).alias("hit_rate"),
        F.avg(F.when(F.col("is_long"), F.col("actual_return"))).alias("long_ret"),
        F.avg(F.when(F.col("is_short"), F.col("actual_return"))).alias("short_ret"),
        F.avg("actual_return").alias("bench_ret"),
        F.sort_array(F.collect_list(F.when(F.col("is_long"), F.col("symbol")))).alias("long_set"),
        F.sort_array(F.collect_list(F.when(F.col("is_short"), F.col("symbol")))).alias("short_set"),
        up.alias("long_mag_ret"),
        up_set.alias("long_mag_set"),
        up_div.alias("long_mag_div"),
        down.alias("short_mag_ret"),
        down_set.alias("short_mag_set"),
        down_div.alias("short_mag_div"),
    )
    w = Window.partitionBy(*(keys or [F.lit("run")])).orderBy("t_date")

    def turnover(name: str, divisor: Column) -> Column:
        before = F.lag(f"{name}_set").over(w)
        return F.when(before.isNull(), 1.0).otherwise(1.0 - F.size(F.array_intersect(f"{name}_set", before)) / divisor)

    days = days.withColumns(
        {f"{n}_turnover": turnover(n, F.lit(top_k)) for n in ("long", "short")}
        | {f"{n}_turnover": turnover(n, F.col(f"{n}_div")) for n in ("long_mag", "short_mag")}
    )
    net = {n: _ln1p(F.col(f"{n}_ret")) for n in ("long", "short", "bench", "long_mag", "short_mag")}
    paid = {n: F.col(f"{n}_turnover") * fee for n in ("long", "short", "long_mag", "short_mag")}
    return days.withColumns(
        {
            "long": net["long"] - paid["long"],
            "ls": net["long"] - net["short"] - paid["long"] - paid["short"],
            "bench": net["bench"],
            "long_mag": net["long_mag"] - paid["long_mag"],
            "ls_mag": net["long_mag"] - net["short_mag"] - paid["long_mag"] - paid["short_mag"],
        }
    )


def curves(returns: DataFrame) -> DataFrame:
    """(curve, t_date, net, cum, equity, drawdown): long form of the five curves. The peak starts at the first equity."""
    long = returns.unpivot("t_date", list(CURVES), "curve", "net")
    run = Window.partitionBy("curve").orderBy("t_date").rowsBetween(Window.unboundedPreceding, 0)
    long = long.withColumn("cum", F.sum("net").over(run)).withColumn("equity", F.exp("cum"))
    peak = F.max("equity").over(run)
    return long.withColumn("drawdown", (peak - F.col("equity")) / peak)


def _figures(mean: Column, std: Column, worst: Column, periods: float, risk_free: float) -> dict[str, Column]:
    ann, mdd = mean * periods * 100, worst * 100
    sharpe = F.when(std < 1e-6, 0.0).otherwise(F.try_divide(mean - risk_free / periods, std) * F.sqrt(F.lit(periods)))
    return {"ann_return": ann, "sharpe": sharpe, "mdd": mdd, "calmar": F.when(mdd > 1e-4, ann / mdd).otherwise(0.0)}


def _win_rate(net: Column) -> Column:
    return F.avg(F.when(net > 0, 1.0).otherwise(0.0)) * 100


def portfolio_stats(curve_rows: DataFrame, periods: float = PERIODS_A_YEAR, risk_free: float = RISK_FREE) -> DataFrame:
    """(curve, periods, ann_return, sharpe, mdd, calmar, win_rate) in % but for Sharpe and Calmar."""
    figures = _figures(F.avg("net"), F.stddev_pop("net"), F.max("drawdown"), periods, risk_free)
    return curve_rows.groupBy("curve").agg(
        F.count("net").alias("periods"), *(c.alias(n) for n, c in figures.items()), _win_rate(F.col("net")).alias("win_rate")
    )


#: Statistics that a summary shows, and of which curves.
SHOWN = {"ann_return": CURVES, "sharpe": CURVES, "mdd": CURVES, "calmar": ("long", "ls"), "win_rate": ("long", "ls")}


def summary(
    rows: DataFrame,
    top_k: int = TOP_K,
    min_symbols: int = MIN_SYMBOLS,
    every: int = 5,
    periods: float = PERIODS_A_YEAR,
    risk_free: float = RISK_FREE,
) -> DataFrame:
    """(metric, value), by run where rows have that column: 23 figures: accuracy over all rows, the rest over the rebalance dates.

    All figures of the dates come from one table of a row for each date.
    """
    keys = ["run"] if "run" in rows.columns else []
    whole = direction(rows, *keys).unpivot(keys, ["da", "mw_da"], "metric", "value")
    days = portfolio_returns(rows, top_k, min_symbols, every=every)
    upto = Window.partitionBy(*(keys or [F.lit("run")])).orderBy("t_date").rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumns({f"{c}_equity": F.exp(F.sum(c).over(upto)) for c in CURVES})
    peaks = {c: F.max(f"{c}_equity").over(upto) for c in CURVES}
    days = days.withColumns({f"{c}_down": (peaks[c] - F.col(f"{c}_equity")) / peaks[c] for c in CURVES})
    found = {"rank_ic": F.avg("rank_ic"), "hit_rate": F.avg("hit_rate")}
    for curve in CURVES:
        stats = _figures(F.avg(curve), F.stddev_pop(curve), F.max(f"{curve}_down"), periods, risk_free) | {"win_rate": _win_rate(F.col(curve))}
        found |= {f"{n}_{curve}": c for n, c in stats.items() if curve in SHOWN[n]}
    figures = days.groupBy(*keys).agg(*(c.alias(n) for n, c in found.items()))
    return whole.unionByName(figures.unpivot(keys, list(found), "metric", "value"))
