"""Density curves, codec health from code counts, figures by date, and requests answered from a stored set, each against a plain version."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wickflow.operators import monitor, profile, quality, tokens


def plain_curve(x, points=200, cut=3.0):
    x = np.array(x)
    h = x.std(ddof=1) * len(x) ** -0.2
    at = np.linspace(x.min() - cut * h, x.max() + cut * h, points)
    return at, np.exp(-(((at[:, None] - x) / h) ** 2) / 2).sum(axis=1) / (len(x) * h * math.sqrt(2 * math.pi)), h


def test_density_curve(spark):
    rng = random.Random(3)
    sets = {
        "normal": [rng.gauss(5, 2) for _ in range(3000)],
        "two": [1.0, 2.0],
        "ties": [0.0] * 50 + [1.0] * 50 + [100.0],
        "far": [rng.gauss(0, 1) for _ in range(500)] + [400.0],
    }
    rows = [(k, v) for k, values in sets.items() for v in values]
    rows += [("normal", None), ("normal", math.nan), ("same", 4.0), ("same", 4.0), ("one", 1.0), ("none", None), (None, 1.0), (None, None)]
    df = spark.createDataFrame(rows, "name string, v double")
    got = profile.density_curve(df, "v", ("name",)).collect()
    assert {r["name"] for r in got} == set(sets)
    for name, values in sets.items():
        curve = sorted((r["point"], r["x"], r["density"]) for r in got if r["name"] == name)
        at, want, h = plain_curve(values)
        assert [p for p, _, _ in curve] == list(range(200))
        assert np.allclose([x for _, x, _ in curve], at, atol=1e-9)
        assert np.abs(np.array([d for _, _, d in curve]) - want).max() * h < 1e-9
    mass = sum(r["density"] for r in got if r["name"] == "normal") * (plain_curve(sets["normal"])[0][1] - plain_curve(sets["normal"])[0][0])
    assert abs(mass - 1) < 1e-3


def test_density_curve_without_keys_and_empty(spark):
    rng = random.Random(5)
    values = [rng.random() for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "`v` double")
    got = profile.density_curve(df, "v", points=50).orderBy("point").collect()
    at, want, h = plain_curve(values, 50)
    assert np.abs(np.array([r["density"] for r in got]) - want).max() * h < 1e-9
    assert profile.density_curve(df.limit(0), "v").collect() == []


def plain_kl(p, q, e=1e-10):
    p, q = np.array(p, float) + e, np.array(q, float) + e
    p, q = p / p.sum() + e, q / q.sum() + e
    p, q = p / p.sum(), q / q.sum()
    return float((p * np.log(p / q)).sum())


def usage(spark, hists):
    rows = [(m, run, c, t, n) for (m, run, c), h in hists.items() for t, n in enumerate(h) if n]
    return spark.createDataFrame(rows, "model string, run int, code string, token int, n long")


def test_drift_from_first(spark):
    rng = random.Random(7)
    hists = {("m", run, c): [rng.choice((0, 0, 1, 7, 900)) for _ in range(32)] for run in (3, 4, 9) for c in ("s1", "s2")}
    hists["m", 4, "s2"] = list(hists["m", 3, "s2"])
    hists["n", 1, "s1"] = [5] + [0] * 31
    hists["n", 2, "s1"] = [0] * 31 + [5]
    got = {(r["model"], r["run"], r["code"]): r for r in tokens.drift_from_first(usage(spark, hists), 32).collect()}
    assert set(got) == set(hists)
    for (m, run, c), h in hists.items():
        first = hists[m, 3 if m == "m" else 1, c]
        assert got[m, run, c]["kl"] == pytest.approx(plain_kl(h, first), abs=1e-9)
        assert got[m, run, c]["used_pct"] == pytest.approx(100 * sum(n > 0 for n in h) / 32)


def test_drift_without_first_counts_and_bad_rows(spark):
    rows = [("m", 1, "s1", 0, 5), ("m", 2, "s2", 3, 4), ("m", 2, "s1", 1, 0), ("m", 2, "s1", None, 9), ("m", 1, "s1", 0, 5)]
    df = spark.createDataFrame(rows, "model string, run int, code string, token int, n long")
    got = {(r["run"], r["code"]): r["kl"] for r in tokens.drift_from_first(df, 8).collect()}
    assert set(got) == {(1, "s1"), (2, "s2")}
    assert got[1, "s1"] == pytest.approx(0, abs=1e-12) and got[2, "s2"] == pytest.approx(plain_kl([0, 0, 0, 4, 0, 0, 0, 0], [1] * 8), abs=1e-9)


def plain_health(runs, codes, worse=1.05, min_util=25.0, max_kl=0.5, patience=3):
    """Reasons run by run, as a loop with state; runs: (loss, s1 counts, s2 counts)."""
    first, best, stale, found = None, math.inf, 0, []
    for loss, s1, s2 in runs:
        if first is None:
            first = s1, s2
            found.append(set())
            continue
        kl = (plain_kl(s1, first[0]) + plain_kl(s2, first[1])) / 2
        best, stale = (loss, 0) if loss < best else (best, stale + 1)
        checks = {
            "loss above best": loss > best * worse,
            "low utilisation": 100 * sum(n > 0 for n in s2) / codes < min_util,
            "drift": kl > max_kl,
            "no improvement": stale >= patience,
        }
        found.append({k for k, v in checks.items() if v})
    return found


@pytest.mark.parametrize("seed", range(3))
def test_codec_health(spark, seed):
    rng = random.Random(seed)
    runs = []
    for _ in range(12):
        few = rng.random() < 0.3
        s1, s2 = ([0 if t >= 3 and few else rng.randrange(20, 40) for t in range(16)] for _ in "ab")
        runs.append((rng.choice((0.1, 0.9, 1.0, 1.04, 1.2)) if seed else 1.0 - 0.01 * len(runs), s1, s2))
    runs[0] = (0.01, *runs[0][1:])  # the first run is not a best
    losses = spark.createDataFrame([("m", k, r[0]) for k, r in enumerate(runs)], "model string, run int, loss double")
    counts = usage(spark, {("m", k, c): r[j] for k, r in enumerate(runs) for j, c in ((1, "s1"), (2, "s2"))})
    got = monitor.codec_health(losses, counts, 16).orderBy("run").collect()
    assert [set(r["reasons"]) for r in got] == plain_health(runs, 16)
    assert got[0]["best"] is None and got[0]["healthy"] and got[1]["best"] == runs[1][0]


def test_health_counts_the_first_run_by_default(spark):
    df = spark.createDataFrame([("m", 1, 1.0, 50.0, 0.9), ("m", 2, 2.0, 50.0, 0.1)], "model string, run int, loss double, s2_util double, kl double")
    reasons = [r["reasons"] for r in monitor.health(df).orderBy("run").collect()]
    assert reasons == [["drift"], ["loss above best"]]
    assert [r["reasons"] for r in monitor.health(df, first_counts=False).orderBy("run").collect()] == [[], []]


def test_answered(spark):
    stored = spark.createDataFrame(
        [("A", 126, None, 1.0), ("B", 126, None, 2.0), ("C", 60, None, 3.0), ("D", 126, 0.5, 4.0), ("GONE", 126, None, 5.0)],
        "symbol string, lookback int, heat double, pred double",
    )
    asked = spark.createDataFrame([(126, None)], "lookback int, heat double")
    seen = spark.createDataFrame([("A", 1), ("B", 1), ("C", 1), ("D", 1), ("GONE", 1)], "symbol string, stamp int")
    now = spark.createDataFrame([("A", 1), ("B", 2), ("C", 1), ("D", 1), ("NEW", 1), ("SHORT", 1)], "symbol string, stamp int")
    made = []

    def make(rest):
        made.extend(r["symbol"] for r in rest.collect())
        return rest.where("symbol <> 'SHORT'").withColumn("pred", F.lit(9.0))

    got = monitor.answered(stored, asked, ["lookback", "heat"], seen, now, make)
    assert got.columns == ["symbol", "lookback", "heat", "pred", "stored"]
    assert {r["symbol"]: (r["pred"], r["stored"]) for r in got.collect()} == {
        "A": (1.0, True), "B": (9.0, False), "C": (9.0, False), "D": (9.0, False), "NEW": (9.0, False)
    }
    assert sorted(made) == ["B", "C", "D", "NEW", "SHORT"]
    assert {(r["lookback"], r["heat"]) for r in got.collect()} == {(126, None)}


def test_per_date_of_ties_and_small_dates(spark):
    rng = random.Random(11)
    rows = [(d, f"S{k}", rng.choice((-0.1, 0.0, 0.1, 0.2)), rng.choice((-0.2, 0.0, 0.1))) for d, n in ((1, 1), (2, 2), (3, 9), (4, 12)) for k in range(n)]
    rows += [(5, f"S{k}", 0.1, float(k)) for k in range(4)]
    df = spark.createDataFrame(rows, "t_date int, symbol string, pred_return double, actual_return double")
    got = {r["t_date"]: r for r in quality.per_date(df, 3, 2).collect()}
    assert set(got) == {2, 3, 4, 5}
    ic = {r["t_date"]: r["rank_ic"] for r in quality.rank_ic(df).collect()}
    won = {r["t_date"]: r["hit_rate"] for r in quality.hit_rate(df, 3).collect()}
    for d, r in got.items():
        mine = sorted((x for x in rows if x[0] == d), key=lambda x: (-x[2], x[1]))
        assert r["long_symbols"] == [x[1] for x in mine[:3]]
        assert r["da"] == pytest.approx(100 * sum((x[2] > 0) == (x[3] > 0) for x in mine) / len(mine))
        assert r["hit_rate"] == pytest.approx(won[d]) == pytest.approx(100 * sum(x[3] > 0 for x in mine[:3]) / len(mine[:3]))
        assert r["rank_ic"] == (pytest.approx(ic[d]) if d in ic else None)
    assert got[2]["rank_ic"] is None and got[5]["rank_ic"] == 0.0


def test_per_date_moves_rows_by_date_once(spark):
    df = spark.createDataFrame([], "t_date int, symbol string, pred_return double, actual_return double")
    assert quality.per_date(df, 3, 2)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
