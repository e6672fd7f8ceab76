"""Forecast quality: accuracy of direction, rank correlation, tests between models."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickflow.functions.scalars import clip, pearson
from wickflow.operators.clean import by_symbol
from wickflow.schema import HORIZON, RETURN_BOUND


def eval_rows(forecasts: DataFrame, horizon: int = HORIZON, pred: str = "pred_drift") -> DataFrame:
    """Forecasts beside what came `horizon` rows on. The predicted return is clipped, the actual one is not."""
    rows = forecasts.select(
        "symbol",
        F.col("ts").alias("t_date"),
        F.lead("ts", horizon).over(by_symbol()).alias("t5_date"),
        F.col("close").alias("actual_close_t"),
        F.lead("close", horizon).over(by_symbol()).alias("actual_close_t5"),
        F.col(pred).alias("pred_close_t5"),
    ).where("pred_close_t5 is not null and actual_close_t5 is not null")
    now = F.col("actual_close_t")
    return rows.withColumn("actual_return", F.try_divide(F.col("actual_close_t5") - now, now)).withColumn(
        "pred_return", clip(F.try_divide(F.col("pred_close_t5") - now, now), -RETURN_BOUND, RETURN_BOUND)
    )


def hit():
    return F.when((F.col("actual_return") > 0) == (F.col("pred_return") > 0), 1.0).otherwise(0.0)


def direction(rows: DataFrame, *keys: str) -> DataFrame:
    """da and mw_da (weighted by the size of the move) in %, by keys."""
    size = F.abs("actual_return")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        (F.avg(hit()) * 100).alias("da"),
        (F.try_divide(F.sum(size * hit()), F.sum(size)) * 100).alias("mw_da"),
    )


def every_nth_date(
    rows: DataFrame, n: int = 5, date: str = "t_date", offset: int = 0, most: int | None = None, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Rows of each n-th of the distinct dates (of each key), from the offset on, of the first `most` of those."""
    order = Window.partitionBy(*keys).orderBy(date)  # one row a date
    dates = rows.select(*keys, date).distinct().withColumn("at", F.row_number().over(order) - 1)
    chosen = dates.where((F.col("at") >= offset) & ((F.col("at") - offset) % n == 0))
    if most is not None:
        chosen = chosen.where((F.col("at") - offset) / n < most)
    return rows.join(chosen.select(*keys, date), [*keys, date], "left_semi")


def sample_step(n_dates: int, limit: int, symbols: int = 50, seed: int = 42) -> tuple[int, int, int]:
    """(step, offset, dates) for about `limit` windows spread over the dates, `step` apart and 5 at least."""
    import random

    wanted = max(1, limit // symbols)
    step = max(5, n_dates // wanted)
    return step, random.Random(seed).randint(0, max(1, step - 1)), wanted


def evaluation_order(rows: DataFrame, date: str = "t_date") -> DataFrame:
    """place: rows by date and then symbol, from 0. Dates are counted, so that no task sorts all rows."""
    before = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, -1)  # one row a date
    starts = rows.groupBy(date).agg(F.count("*").alias("n")).select(date, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from"))
    within = F.row_number().over(Window.partitionBy(date).orderBy("symbol")) - 1
    return rows.withColumn("at", within).join(starts, date).withColumn("place", F.col("from") + F.col("at")).drop("at", "from")


def wide_dates(rows: DataFrame, least: int, date: str = "t_date") -> DataFrame:
    """Rows of the dates with `least` symbols or more."""
    return rows.withColumn("n", F.count("*").over(Window.partitionBy(date))).where(F.col("n") >= least).drop("n")


def with_ranks(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Ranks within a date, ties averaged."""
    by_value, ties = Window.partitionBy("t_date").orderBy(column), Window.partitionBy("t_date", column)
    return rows.withColumn(name, F.rank().over(by_value) + (F.count("*").over(ties) - 1) / 2.0)


def rank_ic(rows: DataFrame, least: int = 3) -> DataFrame:
    """(t_date, rank_ic): Spearman of predicted and actual returns, 0 where undefined, for dates with `least` rows."""
    ranked = with_ranks(with_ranks(rows, "pred_return", "rp"), "actual_return", "ra")
    found = ranked.groupBy("t_date").agg(F.coalesce(pearson("rp", "ra"), F.lit(0.0)).alias("rank_ic"), F.count("*").alias("n"))
    return found.where(F.col("n") >= least).select("t_date", "rank_ic")


def with_sides(rows: DataFrame, top_k: int) -> DataFrame:
    """up and down: the place of a row from the best and from the worst predicted return of its date."""
    best = Window.partitionBy("t_date").orderBy(F.desc("pred_return"), "symbol")
    worst = Window.partitionBy("t_date").orderBy("pred_return", F.desc("symbol"))
    return rows.withColumn("up", F.row_number().over(best)).withColumn("down", F.row_number().over(worst)).withColumns(
        {"is_long": F.col("up") <= top_k, "is_short": F.col("down") <= top_k}
    )


def hit_rate(rows: DataFrame, top_k: int) -> DataFrame:
    """(t_date, hit_rate): share of the top rows whose return was positive, in %."""
    longs = with_sides(rows, top_k).where("is_long")
    return longs.groupBy("t_date").agg((F.avg(F.when(F.col("actual_return") > 0, 1.0).otherwise(0.0)) * 100).alias("hit_rate"))


def per_date(rows: DataFrame, top_k: int, least: int) -> DataFrame:
    """(t_date, da, rank_ic, hit_rate, long_symbols) of the dates with enough symbols; ranks, sides and figures share one exchange by date."""
    rows = with_sides(with_ranks(with_ranks(wide_dates(rows, least), "pred_return", "rp"), "actual_return", "ra"), top_k)
    longs = F.array_sort(F.collect_list(F.when(F.col("is_long"), F.struct("up", "symbol"))))
    won = F.when(F.col("is_long"), F.when(F.col("actual_return") > 0, 1.0).otherwise(0.0))
    return rows.groupBy("t_date").agg(
        (F.avg(hit()) * 100).alias("da"),
        F.when(F.count("*") >= 3, F.coalesce(pearson("rp", "ra"), F.lit(0.0))).alias("rank_ic"),
        (F.avg(won) * 100).alias("hit_rate"),
        F.transform(longs, lambda x: x["symbol"]).alias("long_symbols"),
    )


def vote_accuracy(paths: DataFrame, actual: DataFrame) -> DataFrame:
    """One row: accuracy in % of the mean path's sign, of the majority vote (a tie is down), and of single paths."""
    last = paths.groupBy("symbol", "asof_ts").agg(F.max("step").alias("step"))
    ends = paths.join(last, ["symbol", "asof_ts", "step"]).join(actual, ["symbol", "asof_ts"])
    up = F.when(F.col("close") > F.col("last_close"), 1).otherwise(-1)
    true = F.when(F.col("actual_close") > F.col("last_close"), 1).otherwise(-1)
    series = ends.groupBy("symbol", "asof_ts", true.alias("true"), "last_close").agg(
        F.avg("close").alias("mean_close"), F.sum(up).alias("votes"), F.avg(F.when(up == true, 1.0).otherwise(0.0)).alias("single")
    )
    mean_sign = F.when(F.col("mean_close") > F.col("last_close"), 1).otherwise(-1)
    vote = F.when(F.col("votes") > 0, 1).otherwise(-1)
    return series.agg(
        F.count("*").alias("n"),
        (F.avg(F.when(mean_sign == F.col("true"), 1.0).otherwise(0.0)) * 100).alias("mean_path"),
        (F.avg(F.when(vote == F.col("true"), 1.0).otherwise(0.0)) * 100).alias("majority"),
        (F.avg("single") * 100).alias("single_path"),
    )


def paired_t(base: DataFrame, candidate: DataFrame, metrics: tuple[str, ...] = ("da", "rank_ic"), date: str = "t_date") -> DataFrame:
    """(metric, n, mean_diff, t, p): paired t-tests over the dates in both. NULLs are left out; fewer than 2 dates give NULL."""
    both = base.select(date, *(F.col(m).alias(f"{m}_b") for m in metrics)).join(
        candidate.select(date, *(F.col(m).alias(f"{m}_c") for m in metrics)), date
    )
    pairs = both.select(*((F.col(f"{m}_c") - F.col(f"{m}_b")).alias(m) for m in metrics)).unpivot([], list(metrics), "metric", "d")
    found = pairs.groupBy("metric").agg(
        F.count("d").alias("n"), F.avg("d").alias("mean_diff"), F.try_divide(F.avg("d"), F.stddev_samp("d") / F.sqrt(F.count("d"))).alias("t")
    )
    return found.withColumn("p", t_p_value(F.col("t"), F.col("n") - 1))


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t for whole degrees of freedom, by the finite series in the angle atan(t / sqrt(df))."""
    angle = F.atan(F.abs(t) / F.sqrt(df))
    cos, sin = F.cos(angle), F.sin(angle)
    odd = df % 2 == 1
    terms = F.floor((df - 1) / 2).cast("int") + F.when(odd, 0).otherwise(1)
    steps = F.when(terms > 1, F.sequence(F.lit(1), (terms - 1).cast("int"))).otherwise(F.array().cast("array<int>"))

    def more(state: Column, k: Column) -> Column:
        factor = F.when(odd, (2 * k) / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
        term = state["term"] * factor * cos * cos
        return F.struct((state["total"] + term).alias("total"), term.alias("term"))

    start = F.when(odd, cos).otherwise(F.lit(1.0))
    total = F.aggregate(steps, F.struct(start.alias("total"), start.alias("term")), more)["total"]
    inside = F.when(odd, (angle + sin * F.when(terms > 0, total).otherwise(0.0)) * (2 / math.pi)).otherwise(sin * total)
    return F.when((df >= 1) & t.isNotNull(), F.greatest(1 - inside, F.lit(0.0)))


def mean_overlap(base: DataFrame, candidate: DataFrame, date: str = "t_date") -> DataFrame:
    """One row: the mean share of the base's long list that the candidate's holds too."""
    both = base.select(date, F.col("long_symbols").alias("a")).join(candidate.select(date, F.col("long_symbols").alias("b")), date)
    return both.agg(F.avg(F.try_divide(F.size(F.array_intersect("a", "b")), F.size("a"))).alias("overlap"), F.count("*").alias("dates"))


def path_mse(compared: DataFrame, key: tuple[str, ...] = ("symbol", "asof_ts"), columns: tuple[str, ...] = ("close",)) -> DataFrame:
    """Mean over series of the mean squared error of their steps and columns; compared has each column and real_ it."""
    square = sum((F.pow(F.col(c) - F.col(f"real_{c}"), 2) for c in columns), F.lit(0.0)) / len(columns)
    each = compared.where(f"real_{columns[0]} is not null").groupBy(*key).agg(F.avg(square).alias("mse"))
    return each.agg(F.avg("mse").alias("mse"), F.count("*").alias("series"))


def golden_difference(rows: DataFrame, golden: DataFrame, on: list[str], columns: tuple[str, ...], rtol: float = 1e-5) -> DataFrame:
    """One row: the largest relative difference to golden rows, and whether it is within rtol."""
    g = golden.select(*on, *(F.col(c).alias(f"{c}_golden") for c in columns))
    worst = F.greatest(*(F.try_divide(F.abs(F.col(c) - F.col(f"{c}_golden")), F.abs(f"{c}_golden")) for c in columns), F.lit(0.0))
    return rows.join(g, on).agg(F.max(worst).alias("worst"), F.count("*").alias("n")).withColumn("within", F.col("worst") <= rtol)


def by_year(per_date_rows: DataFrame, date: str = "t_date") -> DataFrame:
    return per_date_rows.groupBy(F.year(date).alias("year")).agg(F.avg("da").alias("da"))


def compare_years(base: DataFrame, candidate: DataFrame, default: float = 50.0) -> DataFrame:
    """Mean daily accuracy by year, rounded half to even; a year that one lacks counts the default."""
    b, c = (by_year(x).withColumnRenamed("da", n) for x, n in ((base, "base_da"), (candidate, "candidate_da")))
    both = b.join(c, "year", "full")
    return both.select("year", *(F.bround(F.coalesce(n, F.lit(default)), 1).alias(n) for n in ("base_da", "candidate_da")))


def grade(da):
    """good from 55, ok from 52, else bad."""
    return F.when(da >= 55, "good").when(da >= 52, "ok").otherwise("bad")


def status_flags(metrics: DataFrame, bars: dict[str, float] | None = None) -> DataFrame:
    """(metric, split, value, good) of the metrics that have a bar on the dashboard: accuracy 52 %, win rate 50 %."""
    bars = {"da": 52.0, "win_rate_long": 50.0} if bars is None else bars
    limit = F.create_map(*(F.lit(x) for pair in bars.items() for x in pair))[F.col("metric")]
    return metrics.where(F.col("metric").isin(*bars)).withColumn("good", F.col("value") >= limit)


# The metrics of a frozen record and the names that its readers expect.
CONTRACT = {"da": "DA", "mw_da": "MW-DA", "rank_ic": "RankIC", "hit_rate": "HitRate"}


def contract_metrics(metrics: DataFrame) -> DataFrame:
    """The metrics of the contract, by their names there; others go."""
    names = F.create_map(*(F.lit(x) for pair in CONTRACT.items() for x in pair))
    return metrics.where(F.col("metric").isin(*CONTRACT)).withColumn("metric", names[F.col("metric")])


def compare_metrics(base: DataFrame, candidate: DataFrame, bar: float = 52.0) -> DataFrame:
    """(metric, split, base, candidate, better, base_passes, passes): long metric tables side by side; the bar is for da."""
    names = tuple(CONTRACT)
    b = base.where(F.col("metric").isin(*names)).withColumnRenamed("value", "base")
    c = candidate.where(F.col("metric").isin(*names)).withColumnRenamed("value", "candidate")
    both = b.join(c, ["metric", "split"])
    flags = {n: F.when(F.col("metric") == "da", F.col(c) >= bar) for n, c in (("base_passes", "base"), ("passes", "candidate"))}
    return both.withColumns({"better": F.col("candidate") > F.col("base")} | flags)


def weighted_loss(batches: DataFrame, *keys: str) -> DataFrame:
    """Mean loss by sample count; batches: loss, n."""
    return batches.groupBy(*keys).agg(F.try_divide(F.sum(F.col("loss") * F.col("n")), F.sum("n")).alias("loss"))
