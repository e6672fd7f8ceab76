"""Symbols that are too long for one task: rows in time blocks.

Figures of row frames (lags, sliding means, windows) need a few rows around each row: a block gets copies of its neighbours' nearest
rows, its halo, and the ordinary operator runs on each block as if it were a symbol. Figures that run from the first row on (sums,
maxima, the last value that is there) take two passes: totals of each block, carried over the few blocks of a symbol, and
a running figure inside each block. Row numbers are made in the same way from counts of short spans of time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickflow.schema import FEATURES

#: Rows of a block.
BLOCK = 200_000
#: Spans of time for each block, when rows are numbered.
SPANS = 8


def longest(bars: DataFrame) -> int:
    """Rows of the longest symbol."""
    return bars.groupBy("symbol").count().agg(F.max("count")).first()[0] or 0


def number_in_spans(bars: DataFrame, block: int = BLOCK) -> DataFrame:
    """rn as clean.number_rows gives it. No task sorts more than the rows of one span, an equal share of the symbol's time;
    bars that all fall into one instant would have to be coarsened first.
    """
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    ends = bars.groupBy("symbol").agg(F.min(t).alias("lo"), F.max(t).alias("hi"), F.ceil(F.count("*") * SPANS / block).alias("spans"))
    share = (t - F.col("lo")) / (F.col("hi") - F.col("lo") + 1)
    rows = bars.join(ends, "symbol").withColumn("span", F.floor(share * F.col("spans"))).drop("lo", "hi", "spans")
    before = F.sum("n").over(Window.partitionBy("symbol").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    counts = rows.groupBy("symbol", "span").agg(F.count("*").alias("n")).select("symbol", "span", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("symbol", "span").orderBy("ts"))
    rows = rows.withColumn("within", within).join(counts, ["symbol", "span"])
    return rows.withColumn("rn", F.col("before") + F.col("within") - 1).drop("span", "before", "within")


def haloed(numbered: DataFrame, back: int, ahead: int, block: int = BLOCK) -> DataFrame:
    """Rows with block, once in their own (core) and once in each block that begins at most `back` rows after them or ends at most
    `ahead` rows before them. So a block has at most back + block + ahead rows.
    """
    first = F.greatest(F.lit(0), F.floor((F.col("rn") - ahead) / block))
    blocks = F.explode(F.sequence(first, F.floor((F.col("rn") + back) / block)))
    return numbered.withColumn("block", blocks).withColumn("core", F.floor(F.col("rn") / block) == F.col("block"))


def in_blocks(bars: DataFrame, function: Callable[[DataFrame], DataFrame], back: int = 0, ahead: int = 0, block: int = BLOCK) -> DataFrame:
    """function(bars) for an operator that keeps its rows and whose figures need at most so many rows before and after each row."""
    rows = haloed(number_in_spans(bars, block), back, ahead, block)
    # blocks whose rows are only copies (beyond a symbol's end) have no core
    rows = rows.withColumn("symbol", F.struct("symbol", "block")).drop("block", "rn")
    return function(rows).where("core").withColumn("symbol", F.col("symbol.symbol")).drop("core")


def windows_in_blocks(bars: DataFrame, function: Callable[[DataFrame], DataFrame], width: int, block: int = BLOCK) -> DataFrame:
    """function(bars) for an operator that returns figures of windows of `width` rows by symbol and start."""
    rows = haloed(number_in_spans(bars, block), 0, width - 1, block)
    found = function(rows.withColumn("symbol", F.struct("symbol", "block")).drop("block", "rn", "core"))
    start = (F.col("start") + F.col("symbol.block") * block).cast("int")
    return found.where(F.col("start") < block).withColumn("start", start).withColumn("symbol", F.col("symbol.symbol"))


def running(numbered: DataFrame, scans: dict[str, tuple[str, Column]], block: int = BLOCK, backward: bool = False) -> DataFrame:
    """Figures from the first row of a symbol up to each row, or with backward from the last row down to it.

    scans: name to (kind, value): sum, count, max, min, or last (the value nearest before, itself included, that is not NULL).
    Sums of doubles add up block by block, so their last digits may differ from those of one long frame.
    """
    way = F.desc if backward else F.asc
    upto = Window.partitionBy("symbol", "block").orderBy(way("rn")).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("symbol").orderBy(way("block")).rowsBetween(Window.unboundedPreceding, -1)
    plain = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}
    rows = numbered.withColumn("block", F.floor(F.col("rn") / block))
    totals, carried, local, joined = [], [], {}, {}
    for name, (kind, value) in scans.items():
        here, carry, total = F.col(f"{name}_here"), F.col(f"{name}_carry"), f"{name}_total"
        if kind == "last":
            place = F.when(value.isNotNull(), -F.col("rn") if backward else F.col("rn"))
            totals.append(F.max_by(value, place).alias(total))
            carried.append(F.last(total, True).over(before).alias(f"{name}_carry"))
            local[f"{name}_here"] = F.last(value, True).over(upto)
            joined[name] = F.coalesce(here, carry)
        else:
            totals.append(plain[kind](value).alias(total))
            carried.append((F.sum if kind == "count" else plain[kind])(total).over(before).alias(f"{name}_carry"))
            local[f"{name}_here"] = plain[kind](value).over(upto)
            both = {"max": F.greatest, "min": F.least}.get(kind, lambda a, b: F.coalesce(a + b, a, b))
            joined[name] = both(here, carry)
    sums = rows.groupBy("symbol", "block").agg(*totals).select("symbol", "block", *carried)
    out = rows.withColumns(local).join(sums, ["symbol", "block"]).withColumns(joined)
    return out.drop("block", *(f"{n}_{part}" for n in scans for part in ("here", "carry")))


def fill_series(bars: DataFrame, block: int = BLOCK) -> DataFrame:
    """clean.fill of whole series: the value before, else the next one, else 0."""
    rows = number_in_spans(bars, block)
    rows = running(rows, {f"{c}_before": ("last", F.col(c)) for c in FEATURES}, block)
    rows = running(rows, {f"{c}_next": ("last", F.col(c)) for c in FEATURES}, block, backward=True)
    rows = rows.withColumns({c: F.coalesce(f"{c}_before", f"{c}_next", F.lit(0.0)) for c in FEATURES})
    return rows.drop("rn", *(f"{c}_{s}" for c in FEATURES for s in ("before", "next")))


def flat_runs(bars: DataFrame, min_run: int = 5, block: int = BLOCK) -> DataFrame:
    """profile.flat_runs: runs may cross blocks, so islands are numbered by a running count."""
    flat = F.col("close").eqNullSafe(F.lag("close").over(Window.partitionBy("symbol").orderBy("ts")))
    rows = in_blocks(bars, lambda b: b.withColumn("flat", flat), back=1, block=block)
    rows = running(number_in_spans(rows, block), {"island": ("sum", F.when(F.col("flat"), 0).otherwise(1))}, block)
    runs = rows.groupBy("symbol", "island").agg(F.sum(F.col("flat").cast("int")).alias("run"))
    return runs.groupBy("symbol").agg(F.max("run").cast("long").alias("longest")).withColumn("flagged", F.col("longest") > min_run)


def curves(returns: DataFrame, value: str, block: int = BLOCK) -> DataFrame:
    """Log returns of each symbol added up (cum), their equity, its peak so far from the first equity on, and the drawdown from it."""
    rows = running(number_in_spans(returns, block), {"cum": ("sum", F.col(value))}, block)
    rows = running(rows.withColumn("equity", F.exp("cum")), {"peak": ("max", F.col("equity"))}, block).drop("rn")
    return rows.withColumn("drawdown", (F.col("peak") - F.col("equity")) / F.col("peak"))
