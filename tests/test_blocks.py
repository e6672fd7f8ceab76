"""Operators on time blocks give the rows that they give on whole symbols, and no block is larger than its bound."""

import random

import pytest
from pyspark.sql import functions as F

from wickflow.operators import blocks, clean, profile, windows
from wickflow.schema import FEATURES


@pytest.fixture(scope="module")
def bars(spark):
    rng, rows = random.Random(4), []
    for symbol, n in (("A", 1), ("B", 47), ("C", 300), ("D", 10)):
        close, t = 100.0, 0
        for _ in range(n):
            t += rng.choice([1, 1, 1, 60, 5000])
            close = close if rng.random() < 0.4 else round(close * rng.uniform(0.95, 1.05), 2)
            cells = [None if rng.random() < 0.15 else x for x in (close, close + 1, close - 1, close, 10.0, 10 * close)]
            cells[3] = close
            rows.append((symbol, t, *cells))
    df = spark.createDataFrame(rows, "symbol string, t long, " + ", ".join(f"{c} double" for c in FEATURES))
    return df.withColumn("ts", F.timestamp_seconds("t")).drop("t").repartition(3).cache()


def shown(df):
    columns = sorted(df.columns)
    return sorted(repr([round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in columns)]) for r in df.collect())


@pytest.mark.parametrize("block", [1, 7, 50, 1000])
def test_row_numbers(bars, block):
    assert shown(blocks.number_in_spans(bars, block).withColumn("rn", F.col("rn").cast("int"))) == shown(clean.number_rows(bars))


@pytest.mark.parametrize(("back", "ahead", "block"), [(0, 0, 7), (3, 2, 7), (9, 20, 7), (1, 0, 300)])
def test_halos_are_bounded_and_hold_all_neighbours(bars, back, ahead, block):
    rows = blocks.haloed(clean.number_rows(bars), back, ahead, block).collect()
    found = {}
    for r in rows:
        found.setdefault((r["symbol"], r["block"]), set()).add(r["rn"])
    n = {s: max(r["rn"] for r in rows if r["symbol"] == s) + 1 for s in "ABCD"}
    assert all(len(v) <= back + block + ahead for v in found.values())
    for symbol, count in n.items():
        for k in range(-(-count // block)):
            assert found[symbol, k] == set(range(max(0, k * block - back), min(count, (k + 1) * block + ahead)))
    assert sum(r["core"] for r in rows) == sum(n.values())


@pytest.mark.parametrize("block", [1, 7, 64])
def test_frames(bars, block):
    def figures(b):
        return profile.rolling_volatility(profile.log_returns(b), (5, 20))

    assert shown(blocks.in_blocks(bars, figures, back=20, block=block)) == shown(figures(bars))


@pytest.mark.parametrize("block", [1, 9, 64])
def test_windows(bars, block):
    def made(b):
        return windows.make_windows(b, 12, 3)

    def normal(b):
        return windows.normalize_windows(b, made(b), 12, 3)

    found = blocks.windows_in_blocks(bars, made, 16, block)
    assert found.columns == made(bars).columns and shown(found) == shown(made(bars))
    cuts = ("1970-01-01 12:00:00", "1970-01-02 06:00:00")
    assert shown(windows.assign_split(bars, found, *cuts, 12, 2)) == shown(windows.assign_split(bars, made(bars), *cuts, 12, 2))
    assert shown(blocks.windows_in_blocks(bars, normal, 16, block)) == shown(normal(bars))


@pytest.mark.parametrize("block", [1, 7, 64])
def test_running_figures(bars, block):
    rows = clean.number_rows(bars)
    w = clean.by_symbol().rowsBetween(-(10**9), 0)
    scans = {"total": ("sum", F.col("open")), "n": ("count", F.col("open")), "top": ("max", F.col("open")), "low": ("min", F.col("open")), "held": ("last", F.col("open"))}
    want = rows.withColumns({"total": F.sum("open").over(w), "n": F.count("open").over(w), "top": F.max("open").over(w), "low": F.min("open").over(w), "held": F.last("open", True).over(w)})
    assert shown(blocks.running(rows, scans, block)) == shown(want)
    ahead = clean.by_symbol().rowsBetween(0, 10**9)
    back = blocks.running(rows, {"total": scans["total"], "held": scans["held"]}, block, backward=True)
    assert shown(back) == shown(rows.withColumns({"total": F.sum("open").over(ahead), "held": F.first("open", True).over(ahead)}))


@pytest.mark.parametrize("block", [3, 40])
def test_fill_runs_and_curves(bars, block):
    assert shown(blocks.fill_series(bars, block)) == shown(clean.fill(bars))
    assert shown(blocks.flat_runs(bars, 2, block)) == shown(profile.flat_runs(bars, 2))
    returns = profile.log_returns(bars).where("r is not null").select("symbol", "ts", "r")
    w = clean.by_symbol().rowsBetween(-(10**9), 0)
    want = returns.withColumn("cum", F.sum("r").over(w)).withColumn("equity", F.exp("cum")).withColumn("peak", F.max("equity").over(w))
    assert shown(blocks.curves(returns, "r", block)) == shown(want.withColumn("drawdown", (F.col("peak") - F.col("equity")) / F.col("peak")))


def test_one_symbol_in_many_tasks(spark):
    """A million bars of one symbol: no block has more than its rows and halo, and the blocks lie in many tasks."""
    bars = spark.range(1_000_000).selectExpr("'X' symbol", "timestamp_seconds(id * 60) ts", "100 + sin(id) close")
    rows = blocks.haloed(blocks.number_in_spans(bars, 50_000), 49, 0, 50_000)
    counts = {r["block"]: r["count"] for r in rows.groupBy("block").count().collect()}
    assert max(counts.values()) <= 50_049 and sum(counts.values()) == 1_000_000 + 19 * 49 + 49 and blocks.longest(bars) == 1_000_000
    spans = blocks.number_in_spans(bars, 50_000).groupBy(F.floor(F.col("rn") / 6250)).count()
    assert spans.count() == 160
