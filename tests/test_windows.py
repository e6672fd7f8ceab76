"""Windows, splits and normalisation on small made bars."""

import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F

from wickflow.operators import windows
from wickflow.schema import FEATURES

COLUMNS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, amount double"


def made(spark, symbol, n, price, start=dt.datetime(2022, 1, 1), missing=()):
    rows = []
    for i in range(n):
        p = price(i)
        values = (p, p + 2.0, p - 2.0, p + 1.0) if i not in missing else (None,) * 4
        rows.append((symbol, start + dt.timedelta(days=i), *values, 1000.0, 100000.0))
    return spark.createDataFrame(rows, COLUMNS)


def test_windows_stay_inside_a_symbol(spark):
    bars = made(spark, "A", 60, lambda i: 100.0 + i).union(made(spark, "B", 40, lambda i: 50.0))
    found = windows.make_windows(bars, 30, 5)
    counts = {r["symbol"]: (r["n"], r["top"]) for r in found.groupBy("symbol").agg(F.count("*").alias("n"), F.max("start").alias("top")).collect()}
    assert counts == {"A": (25, 24), "B": (5, 4)}
    rows = windows.normalize_windows(bars, found, 30, 5)
    assert rows.count() == 30 * 36
    two = found.where("start in (3, 4) and symbol = 'B'")
    assert {(r["symbol"], r["start"]) for r in windows.normalize_windows(bars, two, 30, 5).collect()} == {("B", 3), ("B", 4)}


def test_normalisation_needs_no_exchange_for_each_window(spark):
    """Bars are numbered, joined with the windows' starts and gathered: nothing is exchanged after the rows are gathered."""
    bars = made(spark, "A", 60, lambda i: 100.0 + i)
    rows = windows.normalize_windows(bars, windows.make_windows(bars, 30, 5), 30, 5)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("collect_list")]
    assert "Exchange" not in above


def test_unscale_inverts_scale(spark):
    row = spark.createDataFrame([(7.0, 3.0, 2.0), (3.0, 3.0, 0.0)], "x double, m double, s double")
    z = windows.scale(F.col("x"), F.col("m"), F.col("s"), None)
    got = row.select("x", windows.unscale(z, F.col("m"), F.col("s")).alias("back")).collect()
    assert all(r["back"] == pytest.approx(r["x"]) for r in got)


def test_clip_rate_against_a_loop(spark):
    prices = [100.0 + (50.0 if i == 20 else i % 3) for i in range(40)]
    bars = made(spark, "A", 40, lambda i: prices[i])
    beyond = total = 0
    for start in range(40 - 10 + 1):
        part = prices[start : start + 10]
        mean, std = statistics.fmean(part), statistics.pstdev(part)
        beyond += sum(abs((x - mean) / (std + 1e-5)) > 2.5 for x in part)
        total += 10
    got = {r["feature"]: r["rate"] for r in windows.clip_rate(bars, 10, 2.5).collect()}
    assert got["open"] == pytest.approx(beyond / total) and got["volume"] == 0


def test_splits_against_a_loop(spark):
    bars = made(spark, "A", 200, lambda i: 100.0 + i)
    lookback, horizon, gap = 30, 5, 5
    train_end, val_end = dt.datetime(2022, 6, 1), dt.datetime(2022, 7, 5)
    days = [dt.datetime(2022, 1, 1) + dt.timedelta(days=i) for i in range(200)]
    first = {c: next((i for i, d in enumerate(days) if d >= c), 200) for c in (train_end, val_end)}
    want = {}
    for i in range(200 - 36 + 1):
        last = days[i + 35]
        if last < train_end:
            want[i] = "train"
        elif i + lookback >= first[train_end] + gap and last < val_end:
            want[i] = "val"
        elif i + lookback >= first[val_end] + gap:
            want[i] = "test"
    found = windows.assign_split(bars, windows.make_windows(bars, lookback, horizon), "2022-06-01", "2022-07-05", lookback, gap)
    assert {r["start"]: r["split"] for r in found.collect()} == want
    assert set(want.values()) == {"train", "val", "test"}


def test_cut_beyond_the_bars_gives_only_training(spark):
    bars = made(spark, "A", 60, lambda i: 100.0)
    found = windows.assign_split(bars, windows.make_windows(bars, 30, 5), "2030-01-01", "2031-01-01", 30)
    assert {r["split"] for r in found.collect()} == {"train"}


def test_sparse_windows_go(spark):
    bars = made(spark, "B", 50, lambda i: 50.0, missing=range(21))
    found = windows.make_windows(bars, 30, 5)
    kept = {r["start"] for r in windows.drop_sparse(found).collect()}
    want = {i for i in range(15) if sum(1 for k in range(i, i + 36) if k < 21) * 4 <= 0.10 * 36 * 6}
    assert kept == want


def test_no_leak_from_the_future(spark):
    a = made(spark, "A", 111, lambda i: 100.0 + i * 0.2)
    b = made(spark, "A", 111, lambda i: 100.0 + i * 0.2 if i < 100 else 100.0 * i)
    z = []
    for bars in (a, b):
        rows = windows.normalize_windows(bars, windows.make_windows(bars, 100, 10), 100, 10)
        z.append([r["z_close"] for r in rows.where("start = 0 and pos < 100").orderBy("pos").collect()])
    assert z[0] == pytest.approx(z[1], abs=1e-12)


def test_exact_formula_and_clip(spark):
    bars = made(spark, "A", 40, lambda i: 100.0 + i**2 * 0.1)
    rows = windows.normalize_windows(bars, windows.make_windows(bars, 30, 5), 30, 5)
    got = [r["z_open"] for r in rows.where("start = 0").orderBy("pos").collect()]
    opens = [100.0 + i**2 * 0.1 for i in range(36)]
    mean, std = statistics.fmean(opens[:30]), statistics.pstdev(opens[:30])
    assert got == pytest.approx([max(-5, min(5, (x - mean) / (std + 1e-5))) for x in opens], rel=1e-9)


def test_flat_lookback_is_zero_and_the_future_is_clipped(spark):
    bars = made(spark, "A", 40, lambda i: 100.0 if i < 30 else 200.0)
    rows = windows.normalize_windows(bars, windows.make_windows(bars, 30, 5), 30, 5).where("start = 0")
    values = {r["pos"]: r["z_close"] for r in rows.collect()}
    assert all(values[i] == 0 for i in range(30)) and all(values[i] == 5 for i in range(30, 36))


def test_fill_does_not_look_behind_the_window(spark):
    bars = made(spark, "A", 12, lambda i: 10.0 + i, missing=(4, 5))
    rows = windows.normalize_windows(bars, windows.make_windows(bars, 5, 1), 5, 1)
    at = {(r["start"], r["pos"]): r["close"] for r in rows.collect()}
    assert at[(3, 1)] == 14.0 and at[(4, 0)] == 0.0  # filled from row 3; window 4 starts with a gap


def test_export_keeps_the_order(spark):
    bars = made(spark, "A", 12, lambda i: 10.0 + i)
    rows = windows.window_arrays(bars, windows.make_windows(bars, 5, 1), 5, 1)
    out = windows.export_windows(rows, {"day": F.dayofmonth}).where("start = 2").first()
    assert len(out["x"]) == 7 and len(out["x"][0]) == len(FEATURES)
    assert [s[0] for s in out["stamp"]] == [3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0]


def test_all_windows_without_naming_them(spark):
    """The same rows, and bars move once."""
    bars = made(spark, "A", 30, lambda i: 10.0 + i)
    named = windows.normalize_windows(bars, windows.make_windows(bars, 5, 1), 5, 1)
    every = windows.normalize_windows(bars, None, 5, 1)
    assert every._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(str, every.collect())) == sorted(map(str, named.collect()))


def test_sample_is_the_same_each_time(spark):
    bars = made(spark, "A", 60, lambda i: 100.0)
    found = windows.make_windows(bars, 10, 5)
    a, b = (sorted(r["start"] for r in windows.sample_starts(found, 7).collect()) for _ in range(2))
    assert a == b and len(a) == 7
    assert len(windows.sample_starts(found, 5, keys=()).collect()) == 5
