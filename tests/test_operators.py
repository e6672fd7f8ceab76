"""Cleaning, slices, tokens, quality, portfolios and monitoring on literal rows."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from wickflow.functions import scalars
from wickflow.operators import clean, monitor, portfolio, profile, quality, risk, score, slices, tokens

DAY = dt.date(2024, 1, 1)


def closes(spark, series, start=DAY):
    rows = [(s, start + dt.timedelta(days=i), float(c)) for s, cs in series.items() for i, c in enumerate(cs)]
    bars = spark.createDataFrame(rows, "symbol string, ts date, close double")
    return bars.withColumns({"open": F.col("close"), "high": F.col("close"), "low": F.col("close"), "volume": F.lit(1.0), "amount": F.col("close")})


def test_schema_repair(spark):
    df = spark.createDataFrame(
        [("A", "2024-01-02", "1", "4", "1", "2", "10"), ("A", "2024-01-03", "x", "4", "1", "2", "10"), ("A", "2024-01-04", "NaN", "4", "1", "2", "1")],
        "symbol string, date string, open string, high string, low string, close string, volume string",
    )
    rows = clean.normalize_schema(df).collect()
    assert len(rows) == 1 and rows[0]["amount"] == 20.0 and rows[0]["ts"] == dt.datetime(2024, 1, 2)
    bare = spark.createDataFrame([("A", 1, 1.0, 1.0, 1.0, 1.0), ("A", 2, 2.0, 2.0, 2.0, 2.0)], "symbol string, line int, open double, high double, low double, close double")
    rows = clean.normalize_schema(bare, order="line").orderBy("ts").collect()
    assert [r["ts"].day for r in rows] == [1, 2] and {r["volume"] for r in rows} == {0.0} == {r["amount"] for r in rows}
    with pytest.raises(ValueError):
        clean.normalize_schema(bare.drop("open"), order="line")


def test_column_order(spark):
    heads = spark.createDataFrame(
        [("a", "timestamps,open,high,low,close,volume,amount"), ("b", "timestamps,open,close,high,low,volume,amount"), ("c", "date,open")], "file string, header string"
    )
    got = {r["file"]: (r["same_columns"], r["same_order"]) for r in clean.column_order(heads).collect()}
    assert got == {"a": (True, True), "b": (True, False), "c": (False, False)}


def test_reject_nulls(spark):
    bars = closes(spark, {"A": [1, 2]})
    assert clean.reject_nulls(bars).count() == 2
    with pytest.raises(Exception, match="NULL"):
        clean.reject_nulls(bars.withColumn("volume", F.lit(None).cast("double"))).collect()


def test_context_holdout_and_short_symbols(spark):
    bars = closes(spark, {"A": range(20), "B": range(8)})
    got = slices.context_slice(bars, 10, 5).collect()
    a = {p: [r["close"] for r in got if r["symbol"] == "A" and r["part"] == p] for p in ("context", "actual")}
    assert sorted(a["context"]) == list(range(3, 13)) and sorted(a["actual"]) == list(range(13, 18))
    assert all(r["part"] == "context" for r in got if r["symbol"] == "B")
    with pytest.raises(ValueError):
        slices.context_slice(bars, 10, 8)


def test_future_stamps(spark):
    got = slices.future_index(closes(spark, {"A": [1, 2], "B": [1]}), 2).orderBy("symbol", "step").collect()
    assert [r["ts"].day for r in got] == [3, 4, 2, 3]


def test_flat_runs(spark):
    got = profile.flat_runs(closes(spark, {"A": [1, 1, 1, 2, 2], "B": [1, 2]}), 1).orderBy("symbol").collect()
    assert [(r["longest"], r["flagged"]) for r in got] == [(2, True), (0, False)]


def test_correlation_of_a_constant_is_zero(spark):
    rows = spark.createDataFrame([(s, i, r) for s, rs in {"A": [1.0, 2.0, 3.0], "B": [2.0, 4.0, 6.0], "C": [1.0] * 3}.items() for i, r in enumerate(rs)], "symbol string, ts int, r double")
    got = {(r[0], r[1]): r[2] for r in profile.correlation_pairs(rows).collect()}
    assert got[("A", "B")] == pytest.approx(1) and got[("A", "C")] == 0


def test_normal_quantiles(spark):
    got = spark.createDataFrame([(0.5,), (0.975,)], "p double").select(scalars.normal_quantile(F.col("p"))).collect()
    assert got[0][0] == pytest.approx(0, abs=1e-12) and got[1][0] == pytest.approx(1.959964, abs=1e-6)


def test_settlement_skips_weekends(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, d),) for d in range(1, 8)], "d date")
    got = [r[0].weekday() for r in days.select(scalars.settlement_date(F.col("d"))).collect()]
    assert max(got) <= 4


def test_bits_round_trip(spark):
    rows = spark.range(1024).select("id", tokens.index_to_bits(F.col("id").cast("int"), 10).alias("bits"))
    assert rows.where(tokens.bits_to_index(F.col("bits")) != F.col("id")).count() == 0
    low = spark.createDataFrame([([1.0, -1.0, 0.0, 1.0],)], "v array<double>").select(tokens.bits_to_index(F.col("v"))).first()[0]
    assert low == 9  # element 0 is bit 0, and 0 counts as unset


def test_nucleus_keeps_the_token_on_the_boundary(spark):
    p = [0.5, 0.3, 0.2]
    rows = spark.createDataFrame([(1, i, math.log(x)) for i, x in enumerate(p)], "k int, token int, logit double")
    assert tokens.filter_logits(rows, "k", top_p=0.6).count() == 2
    assert tokens.filter_logits(rows, "k", top_p=0.01).count() == 1
    tied = spark.createDataFrame([(1, 0, 1.0), (1, 1, 1.0), (1, 2, 0.0)], "k int, token int, logit double")
    assert tokens.filter_logits(tied, "k", top_k=1).count() == 2
    assert tokens.draw(tokens.filter_logits(rows, "k"), "k").count() == 1
    assert tokens.arg_max(tied, "k").first()["token"] == 0


def test_ranks_and_constant_dates(spark):
    rows = spark.createDataFrame(
        [("A", 1, 0.1, 1.0), ("B", 1, 0.1, 2.0), ("C", 1, 0.3, 3.0), ("A", 2, 0.0, 1.0), ("B", 2, 0.0, 2.0), ("C", 2, 0.0, 3.0)], "symbol string, t_date int, pred_return double, actual_return double"
    )
    got = {r["t_date"]: r["rank_ic"] for r in quality.rank_ic(rows).collect()}
    assert got[1] == pytest.approx(0.8660254) and got[2] == 0


def test_t_test_and_its_p_value(spark):
    schema = "t_date int, da double, rank_ic double"
    a = spark.createDataFrame([(i, float(i % 3), None if i == 4 else 0.1) for i in range(10)], schema)
    b = spark.createDataFrame([(i, float(i % 3) + 0.5 + 0.1 * (i % 2), 0.1 * i) for i in range(10)], schema)
    got = {r["metric"]: r for r in quality.paired_t(a, b).collect()}
    assert got["da"]["n"] == 10 and got["da"]["mean_diff"] == pytest.approx(0.55) and got["da"]["p"] < 1e-6 and got["rank_ic"]["n"] == 9
    # two-sided critical values of Student's t
    rows = [(0.0, 9, 1.0), (2.262157, 9, 0.05), (12.706205, 1, 0.05), (4.302653, 2, 0.05), (3.169273, 10, 0.01), (-2.262157, 9, 0.05), (1.0, 0, None)]
    table = spark.createDataFrame(rows, "t double, df int, p double")
    for r in table.withColumn("q", quality.t_p_value(F.col("t"), F.col("df"))).collect():
        assert r["q"] == (None if r["p"] is None else pytest.approx(r["p"], abs=1e-6))


def test_sparse_dates_are_drawn_as_seeded():
    import random

    for n, limit in ((455, 500), (100, 2500), (10, 50), (4000, 50)):
        step, offset, wanted = quality.sample_step(n, limit)
        assert wanted == max(1, limit // 50) and step == max(5, n // wanted)
        assert offset == random.Random(42).randint(0, max(1, step - 1))


def test_evaluation_order_and_golden_difference(spark):
    rows = spark.createDataFrame([("B", 2, 1.0), ("A", 2, 2.0), ("C", 1, 3.0), ("A", 3, 0.0)], "symbol string, t_date int, x double")
    placed = quality.evaluation_order(rows)
    assert [(r["symbol"], r["t_date"]) for r in placed.orderBy("place").collect()] == [("C", 1), ("A", 2), ("B", 2), ("A", 3)]
    assert sorted(r["place"] for r in placed.collect()) == [0, 1, 2, 3]
    near = rows.withColumn("x", F.col("x") * (1 + 2e-6))
    assert quality.golden_difference(near, rows, ["symbol", "t_date"], ("x",)).first()["within"]
    far = quality.golden_difference(rows.withColumn("x", F.col("x") * 1.1), rows, ["symbol", "t_date"], ("x",)).first()
    assert not far["within"] and far["worst"] == pytest.approx(0.1)


def test_criteria_use_the_median_for_volume(spark):
    errors = [(m, f, e, d) for f in ("close", "volume") for m, e, d in (("a", 50.0, 50.0), ("b", 40.0, 40.0), ("c", 35.0, 20.0))]
    got = {r["feature"]: tuple(r)[1:] for r in tokens.recon_criteria(spark.createDataFrame(errors, "model string, feature string, mape double, mdape double"), ("a", "b", "c")).collect()}
    assert got == {"close": (True, True, False), "volume": (True, True, True)}


def test_summary_by_run_equals_each_by_itself(spark):
    import random

    rng = random.Random(1)
    rows = [(f"S{s}", d, rng.uniform(-0.1, 0.1), rng.uniform(-0.1, 0.1), "a" if d < 30 else "b") for s in range(6) for d in range(60)]
    table = spark.createDataFrame(rows, "symbol string, t_date int, pred_return double, actual_return double, run string")
    both = {(r["run"], r["metric"]): r["value"] for r in portfolio.summary(table, 2, 3).collect()}
    assert len(both) == 46
    for run in "ab":
        alone = portfolio.summary(table.where(F.col("run") == run).drop("run"), 2, 3).collect()
        assert {r["metric"]: r["value"] for r in alone} == pytest.approx({m: v for (r, m), v in both.items() if r == run})


def test_vote_tie_is_down(spark):
    paths = spark.createDataFrame([("A", 1, 10.0, s, 1, c) for s, c in enumerate([11.0, 9.0])], "symbol string, asof_ts int, last_close double, sample_id int, step int, close double")
    actual = spark.createDataFrame([("A", 1, 9.5)], "symbol string, asof_ts int, actual_close double")
    got = quality.vote_accuracy(paths, actual).first()
    assert (got["mean_path"], got["majority"], got["single_path"]) == (100.0, 100.0, 50.0)


def evaluated(spark, days=3):
    rows = []
    for d in range(days):
        for i, s in enumerate("ABCD"):
            rows.append((s, DAY + dt.timedelta(days=d), (i - 1.5) / 100 * (1 if d % 2 else -1), (i - 1) / 50))
    return spark.createDataFrame(rows, "symbol string, t_date date, pred_return double, actual_return double")


def test_portfolio_turnover_and_weights(spark):
    got = portfolio.portfolio_returns(evaluated(spark), 1, 2, every=1).orderBy("t_date").collect()
    assert [r["long_turnover"] for r in got] == [1.0, 1.0, 1.0]  # the best symbol flips each day
    same = portfolio.portfolio_returns(evaluated(spark).withColumn("pred_return", F.lit(0.0)), 2, 2, every=1).orderBy("t_date").collect()
    assert [r["long_turnover"] for r in same] == [1.0, 0.0, 0.0]
    assert same[0]["long_mag_ret"] == same[0]["long_ret"]  # no positive prediction: equal weights
    assert same[0]["long_set"] == ["A", "B"] and same[0]["short_set"] == ["C", "D"]
    long = got[0]["long"]
    assert long == pytest.approx(math.log1p(got[0]["long_ret"]) - 0.0015)


def test_drawdown_starts_at_the_first_equity(spark):
    curves = portfolio.curves(portfolio.portfolio_returns(evaluated(spark), 1, 2, every=1))
    for r in curves.collect():
        assert 0 <= r["drawdown"] <= 1
    first = curves.groupBy("curve").agg(F.min_by("drawdown", "t_date").alias("d")).collect()
    assert {r["d"] for r in first} == {0.0}
    stats = portfolio.portfolio_stats(curves).collect()
    assert len(stats) == 5 and portfolio.summary(evaluated(spark), 1, 2, every=1).count() == 23


def test_risk_of_equal_paths_and_confidence(spark):
    paths = spark.createDataFrame([("A", 1, 10.0, s, 1, 10.5) for s in range(4)], "symbol string, asof_ts int, last_close double, sample_id int, step int, close double")
    got = risk.risk_metrics(paths).first()
    assert got["width"] == 0 and got["trend"] == "UP" and got["expected_return"] == pytest.approx(0.05)
    shares = spark.createDataFrame([(0.2, 1), (0.12, 2), (0.08, 3), (0.06, 4), (0.05, 5)], "w double, want int")
    assert shares.where(risk.confidence(F.col("w"), F.lit(1.0)) != F.col("want")).count() == 0


def test_forecaster_reports_what_it_skips(spark):
    bars = closes(spark, {"A": range(1, 30), "B": [1]})
    asof = bars.groupBy("symbol").agg(F.max("ts").alias("asof_ts"))
    got = score.score(bars.join(asof, "symbol"), score.last_value, 3, 2, least=5).collect()
    ok = [r for r in got if r["symbol"] == "A"]
    assert len(ok) == 6 and {r["close"] for r in ok} == {29.0}
    assert [r["status"] for r in got if r["symbol"] == "B"] == ["skipped"]
    asked = spark.createDataFrame([("A",), ("B",), ("Z",)], "symbol string")
    assert {r["symbol"]: r["status"] for r in score.eligible(bars, asked, 5).collect()} == {"A": "ok", "B": "short", "Z": "unknown"}


def test_resampled_paths_fan_and_realised(spark):
    bars = closes(spark, {"A": [10, 11, 12, 13, 14, 15]})
    paths = score.resampled_paths(bars, 6, 2, 3)
    assert paths.count() == 6 and paths.where("close <= last_close").count() == 0
    assert score.fan(paths).where("step = 0 and close != 15").count() == 0
    forecast = spark.createDataFrame([("A", DAY + dt.timedelta(days=2), 1, 12.5), ("A", DAY + dt.timedelta(days=2), 2, 14.5)], "symbol string, asof_ts date, step int, close double")
    got = score.realised(forecast, bars, 2).orderBy("step").collect()
    assert [r["real_close"] for r in got] == [13.0, 14.0]
    assert quality.path_mse(score.realised(forecast, bars, 2)).first()["mse"] == pytest.approx(0.25)


def test_health_counts_stale_runs(spark):
    runs = spark.createDataFrame([("m", i, x, 50.0, 0.1) for i, x in enumerate([1.0, 0.9, 0.95, 0.91, 0.96])], "model string, run int, loss double, s2_util double, kl double")
    got = monitor.health(runs).orderBy("run").collect()
    assert [r["stale"] for r in got] == [0, 0, 1, 2, 3]
    assert got[4]["reasons"] == ["loss above best", "no improvement"] and got[1]["healthy"]
    assert monitor.best_run(runs).first()["run"] == 1


def test_freshness(spark):
    seen = spark.createDataFrame([("A", 1), ("B", 1)], "symbol string, stamp int")
    now = spark.createDataFrame([("A", 1), ("B", 2), ("C", 1)], "symbol string, stamp int")
    assert {r["symbol"]: r["change"] for r in monitor.stale_symbols(seen, now).collect()} == {"B": "changed", "C": "new"}
    meta = spark.createDataFrame([("m", None)], "model string, start string")
    assert monitor.is_fresh(meta, meta, ["model", "start"], seen, seen).first()["fresh"]
    assert not monitor.is_fresh(meta, meta, ["model", "start"], seen, now).first()["fresh"]


def test_frozen_comparison(spark):
    base = spark.createDataFrame([("da", "test", 53.0), ("mw_da", "test", 49.0), ("other", "test", 1.0)], "metric string, split string, value double")
    cand = spark.createDataFrame([("da", "test", 51.0), ("mw_da", "test", 50.0)], "metric string, split string, value double")
    got = {r["metric"]: (r["better"], r["passes"]) for r in quality.compare_metrics(base, cand).collect()}
    assert got == {"da": (False, False), "mw_da": (True, None)}


def test_frozen_record(spark):
    """Both hard stops and the hashes are in the record."""
    base, cand = (spark.createDataFrame([("da", "test", a), ("mw_da", "test", b)], "metric string, split string, value double") for a, b in ((53.0, 49.0), (51.0, 50.0)))
    files = spark.createDataFrame([("b.csv", "22"), ("a.csv", "11")], "file string, sha256 string")
    record = monitor.freeze(base, cand, files).first()
    assert [r.asDict() for r in record["metrics"]] == [
        {"metric": "da", "split": "test", "base": 53.0, "candidate": 51.0, "better": False, "base_passes": True, "passes": False},
        {"metric": "mw_da", "split": "test", "base": 49.0, "candidate": 50.0, "better": True, "base_passes": None, "passes": None},
    ]
    assert [tuple(r) for r in record["artifacts"]] == [("a.csv", "11"), ("b.csv", "22")]


def test_whole_records(spark):
    """Everything that a record has, for a symbol with and one without a dimension row and tokens."""
    import json

    rows = [(s, f"2024-01-0{d}", 1.0, 3.0, 0.5, float(d), 10.0, 20.0) for s in ("A", "B") for d in (1, 2, 3)]
    bars = spark.createDataFrame(rows, "symbol string, ts string, open double, high double, low double, close double, volume double, amount double").withColumn("ts", F.to_date("ts"))
    paths = spark.createDataFrame([(s, "2024-01-03", 3.0, k, t, 3.0 + k + t) for s in ("A", "B") for k in (1, 0) for t in (2, 1)], "symbol string, asof_ts string, last_close double, sample_id int, step int, close double")
    seen = spark.createDataFrame([("A", 7, 2), ("A", 3, 5), ("A", 1, 2)], "symbol string, token int, n long")
    dim = spark.createDataFrame([("A", "Alpha", "Tech", "HNX")], "symbol string, name string, sector string, exchange string")
    found = {r["symbol"]: json.loads(r["record"]) for r in risk.whole_records(risk.risk_metrics(paths), paths, bars, seen, dim, 2).collect()}
    a, b = found["A"], found["B"]
    assert (a["name"], a["sector"], a["exchange"]) == ("Alpha", "Tech", "HNX") and (b["name"], b["exchange"]) == ("B", "HOSE")
    assert a["xai_data"] == [{"token": 3, "frequency": 5}, {"token": 1, "frequency": 2}, {"token": 7, "frequency": 2}] and b["xai_data"] == []
    assert [(c.get("date"), c["close"], c["fcst"]) for c in a["raw_candles"]] == [("2024-01-02", 2.0, False), ("2024-01-03", 3.0, False), (None, 4.5, True), (None, 5.5, True)]
    assert a["raw_candles"][0]["amount"] == 20.0 and [p["close"] for p in a["stochastic_paths"]] == [4.0, 5.0, 5.0, 6.0]
    assert a["trend"] == {"trend_class": "UP", "predicted_return": pytest.approx(2.5 / 3)} and a["risk_metrics"]["width"] == pytest.approx(0.9)


def test_candle_sparkline_and_flags(spark):
    bars = spark.createDataFrame([("A", d, 2.0, 4.0, 1.0, 3.0) for d in (1, 2)] + [("B", 1, 5.0, 5.0, 5.0, 5.0)], "symbol string, ts int, open double, high double, low double, close double")
    ahead = spark.createDataFrame([("A", 1, 3.0, 9.0, 3.0, 9.0), ("B", 1, 5.0, 5.0, 5.0, 5.0)], "symbol string, step int, open double, high double, low double, close double")
    found = {(r["symbol"], r["at"]): (r["open"], r["high"], r["low"], r["close"], r["fcst"]) for r in risk.candle_sparkline(bars, ahead, 1).collect()}
    assert found == {("A", -1): (0.125, 0.375, 0.0, 0.25, False), ("A", 1): (0.25, 1.0, 0.25, 1.0, True), ("B", -1): (0.0,) * 4 + (False,), ("B", 1): (0.0,) * 4 + (True,)}
    metrics = spark.createDataFrame([("da", "test", 52.0), ("win_rate_long", "test", 49.9), ("mdd_long", "test", 3.0)], "metric string, split string, value double")
    assert {r["metric"]: r["good"] for r in quality.status_flags(metrics).collect()} == {"da": True, "win_rate_long": False}
    named = quality.contract_metrics(metrics.union(spark.createDataFrame([("hit_rate", "test", 1.0)], metrics.schema)))
    assert {r["metric"] for r in named.collect()} == {"DA", "HitRate"}


def test_codes_of_days(spark):
    rows = [(d, (d * 7 + k) % 1024, (k * k) % 1024 if k else None) for d in range(6) for k in range(40)]
    df = spark.createDataFrame(rows, "day int, s1 int, s2 int")
    kept = tokens.code_bitmaps(df, "day").cache()
    for first, last in ((0, 5), (2, 3), (4, 4)):
        want = {r["code"]: r["used"] for r in tokens.utilisation(df.where(F.col("day").between(first, last))).collect()}
        assert {r["code"]: r["used"] for r in tokens.utilisation_between(kept, first, last).collect()} == want
