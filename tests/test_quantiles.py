"""Exact percentiles by narrowing histograms against the built-in ones, and correlations in blocks against a plain sum."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wickflow.operators import profile, quantiles

SHARES = [0.0, 0.05, 0.25, 0.5, 0.61, 0.95, 1.0]


def groups():
    rng = random.Random(5)
    near = [1.0 + k * 2.0**-52 for k in range(300)]
    return {
        "normal": [rng.gauss(0, 1) for _ in range(700)],
        "ties": [float(rng.choice([-2, 0, 0, 5])) for _ in range(500)],
        "one": [3.5],
        "two": [-1.0, 8.0],
        "signs": [s * 10.0 ** rng.uniform(-300, 300) for s in (-1, 1) for _ in range(200)],
        "near": near,
        "ends": [1.7e308, -1.7e308, 5e-324, -5e-324, 0.0, -0.0, 1e-310],
        "missing": [None, math.nan],
        None: [rng.expovariate(1) for _ in range(90)] + [None, math.nan],
    }


@pytest.fixture(scope="module")
def rows(spark):
    cells = [(k, 1, v) for k, values in groups().items() for v in values]
    return spark.createDataFrame(cells, "key string, q int, x double").repartition(3)


def plain(values):
    good = sorted(v for v in values if v is not None and not math.isnan(v))
    out = []
    for share in SHARES:
        place = share * (len(good) - 1)
        low, high = good[math.floor(place)], good[math.ceil(place)]
        out.append(low if low == high else (math.ceil(place) - place) * low + (place - math.floor(place)) * high)
    return out


@pytest.mark.parametrize("most", [0, 10**6])
def test_percentiles_of_groups(rows, most):
    found = {r["key"]: r["q"] for r in quantiles.percentiles(rows, ["key"], F.col("x"), SHARES, most).collect()}
    assert set(found) == set(groups()) - {"missing"}
    for key, got in found.items():
        assert got == pytest.approx(plain(groups()[key]), rel=1e-14, abs=0.0)


def test_percentiles_of_all_rows_and_of_nothing(rows):
    every = [v for values in groups().values() for v in values]
    got = quantiles.percentiles(rows, [], F.col("x"), SHARES, 0).first()["q"]
    assert got == pytest.approx(plain(every), rel=1e-14)
    assert quantiles.percentiles(rows.where("false"), ["key"], F.col("x"), [0.5], 0).count() == 0
    assert quantiles.percentiles(rows.where("key = 'missing'"), ["key"], F.col("x"), [0.5], 0).count() == 0


def test_a_round_counts_a_bounded_number_of_buckets(spark):
    """Of 300,000 values, no aggregation has more groups than buckets."""
    values = spark.range(300_000).selectExpr("cast(pow(10, rand(1) * 20 - 10) * (rand(2) - 0.5) as double) x")
    assert values.select(quantiles.log_bucket(F.col("x"))).distinct().count() < 2 * 2201 * quantiles.LOG_BUCKETS
    low, high = values.agg(F.min("x"), F.max("x")).first()
    assert values.select(quantiles.linear_bucket(F.col("x"), F.lit(low), F.lit(high))).distinct().count() <= quantiles.LINEAR_BUCKETS
    ordered = [tuple(r) for r in values.limit(3000).select("x", quantiles.log_bucket(F.col("x"))).collect()]
    assert [b for _, b in sorted(ordered)] == sorted(b for _, b in ordered)


@pytest.mark.parametrize(("symbols", "dates"), [(256, 512), (3, 4), (1, 1)])
def test_correlations_in_blocks(spark, symbols, dates):
    rng = np.random.default_rng(6)
    common = rng.standard_normal(40)
    table = {f"S{k}": [(d, float(common[d] * (k % 3) + rng.standard_normal())) for d in range(40) if rng.random() < 0.7] for k in range(9)}
    table |= {"flat": [(d, 0.25) for d in range(40)], "early": [(-1, 1.0)], "once": [(5, 1.0)]}
    rows = [(s, d, r) for s, v in table.items() for d, r in v] + [("S1", 99, None)]
    df = spark.createDataFrame(rows, "symbol string, d int, r double").selectExpr("symbol", "date_add(date'2020-01-01', d) ts", "r", "1 corr")
    got = {(r["symbol_a"], r["symbol_b"]): r["corr"] for r in profile.correlation_pairs(df, symbols, dates).collect()}
    want = {}
    for a in table:
        for b in table:
            x, y = dict(table[a]), dict(table[b])
            both = sorted(set(x) & set(y))
            if a < b and both:
                p, q = np.array([x[d] for d in both]), np.array([y[d] for d in both])
                flat = np.var(p) * len(p) < 1e-12 or np.var(q) * len(q) < 1e-12
                want[a, b] = 0.0 if flat else float(np.corrcoef(p, q)[0, 1])
    assert set(got) == set(want) and got == pytest.approx(want, abs=1e-9)


def test_no_pair_has_a_row_for_each_date(spark):
    df = spark.range(2000).selectExpr("concat('S', id % 20) symbol", "date_add(date'2020-01-01', cast(id div 20 as int)) ts", "sin(id * id) r")
    found = profile.correlation_pairs(df)
    text = found._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in text.split("\n") if "Join" in line]
    assert joins and all("span" in line or "part" in line for line in joins) and found.count() == 190
