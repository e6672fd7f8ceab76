"""Registry of the candle queries and their DuckDB twins.

A query and its SQL stand together; doubles are rounded to the same number of digits on both sides, because
sums of floats depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wickflow.functions import scalars
from wickflow.operators import batch_score, blocks, clean, monitor, portfolio, profile, quality, risk, score, slices, tokens, windows
from wickflow.oracles import BARS, CODES, FORECAST, PATHS, PORTFOLIO, RANKED, RISK, T_P, _dates, _rank_ic, of_dates
from wickflow.plans import adapter
from wickflow.plans.adapter import LEAST as P
from wickflow.plans.adapter import TRAIN_END, VAL_END
from wickflow.schema import FEATURES, PRICES
from wickflow.sources import bars as sources
from wickflow.streaming.refresh import candles

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
#: As they are written, for queries that give the rows of another one in another way.
_SQL_OF: dict[str, str] = {}


def _query(sql: str | None = None, digits: int | None = 6):
    """Registers a query by its name, with SQL for the same rows. Without digits, doubles are exact on both sides."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            found = f(spark, sf_dir)
            return found.select(
                *((F.round(F.col(c), digits) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in found.dtypes)
            ) if digits is not None else found

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        _QUERIES[f.__name__] = run
        if sql is not None:
            _SQL[f.__name__], _SQL_OF[f.__name__] = _rounded(sql, digits), sql
        return run

    return register


def _rounded(sql: str, digits: int | None) -> str:
    """Columns marked ~name in the last SELECT are doubles to round."""
    import re

    def one(m):
        return f"({m[1]})::DOUBLE" if digits is None else f"round(({m[1]})::DOUBLE, {digits}) + 0.0"

    return re.sub(r"~\((.*?)\)~", one, sql, flags=re.S)


def _eval(spark, sf_dir, pred="pred_drift", lookback=P["lookback"]):
    return quality.eval_rows(score.baselines(adapter.bars(spark, sf_dir), lookback, 5), 5, pred)


def _accuracy(spark, sf_dir, pred):
    """(metric, value, split): accuracy over all rows as a long metric table."""
    return quality.direction(_eval(spark, sf_dir, pred)).unpivot([], ["da", "mw_da"], "metric", "value").withColumn("split", F.lit("all"))


def _chosen(spark, sf_dir, pred="pred_drift"):
    return quality.wide_dates(quality.every_nth_date(_eval(spark, sf_dir, pred)), P["min_symbols"])


def _dense(spark, sf_dir):
    return profile.densify(adapter.bars(spark, sf_dir))


def _paths(spark, sf_dir):
    return score.resampled_paths(adapter.bars(spark, sf_dir), P["lookback"], 5, 20)


def _ranked(spark, sf_dir):
    return risk.rankings(risk.risk_metrics(_paths(spark, sf_dir)), adapter.bars(spark, sf_dir), adapter.dimension(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str, lookback: int = P["lookback"]) -> DataFrame:
    return quality.direction(_eval(spark, sf_dir, lookback=lookback), "symbol")


@_query(f"WITH {FORECAST} SELECT symbol, count(*) AS n, ~(avg(CASE WHEN (actual_return > 0) = (pred_return > 0) THEN 1.0 ELSE 0.0 END) * 100)~ AS da, ~(sum(abs(actual_return) * CASE WHEN (actual_return > 0) = (pred_return > 0) THEN 1.0 ELSE 0.0 END) / sum(abs(actual_return)) * 100)~ AS mw_da FROM ev GROUP BY symbol")
def drift_accuracy_by_symbol(spark, sf_dir):
    return flagship(spark, sf_dir)


@_query(f'WITH {BARS} SELECT symbol, ts, ~(open)~ AS open, ~(high)~ AS high, ~(low)~ AS low, ~("close")~ AS "close", ~(volume)~ AS volume, ~(amount)~ AS amount FROM bars', None)
def bars(spark, sf_dir):
    return adapter.bars(spark, sf_dir)


@_query(f"WITH {BARS} SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_rows, ~(count(*) / 250.0)~ AS years FROM bars GROUP BY symbol")
def symbol_profile(spark, sf_dir):
    return profile.profile(adapter.bars(spark, sf_dir))


@_query(f"WITH {BARS} SELECT DISTINCT ts FROM bars")
def trading_dates(spark, sf_dir):
    return profile.trading_dates(adapter.bars(spark, sf_dir))


@_query(f'WITH {BARS} SELECT symbol, ts, "close" IS NULL AS missing FROM dense')
def missing_map(spark, sf_dir):
    return profile.missing_map(adapter.bars(spark, sf_dir))


@_query(
    f"""WITH {BARS} SELECT symbol, count(*) FILTER (high + 0.01 < low) AS high_below_low, count(*) FILTER (high + 0.01 < open) AS high_below_open,
    count(*) FILTER (high + 0.01 < "close") AS high_below_close, count(*) FILTER (low - 0.01 > open) AS low_above_open,
    count(*) FILTER (low - 0.01 > "close") AS low_above_close, count(*) FILTER (open < 0 OR high < 0 OR low < 0 OR "close" < 0) AS negative_price,
    count(*) FILTER (volume < 0) AS negative_volume, count(*) FILTER (amount < 0) AS negative_amount FROM bars GROUP BY symbol"""
)
def quality_report(spark, sf_dir):
    return clean.quality_report(adapter.bars(spark, sf_dir))


@_query(f"WITH {BARS} SELECT symbol, count(*) FILTER (isodow(ts) > 5) AS weekend_rows, bool_and(day(ts) BETWEEN 1 AND 31 AND month(ts) BETWEEN 1 AND 12) AS sound_dates FROM bars GROUP BY symbol")
def calendar_report(spark, sf_dir):
    return clean.calendar_report(adapter.bars(spark, sf_dir))


@_query(
    f"""WITH {BARS}, m AS (SELECT symbol, ts, lag("close") OVER (PARTITION BY symbol ORDER BY ts) AS prev_close, "close" FROM bars)
    SELECT symbol, ts, ~(prev_close)~ AS prev_close, ~("close")~ AS "close", ~(("close" - prev_close) / prev_close)~ AS ret FROM m
    WHERE abs(("close" - prev_close) / prev_close) > 0.15""",
    None,
)
def anomalies(spark, sf_dir):
    return clean.anomalies(adapter.bars(spark, sf_dir), 0.15)


@_query(f'WITH {BARS} SELECT symbol, ts::TIMESTAMP AS ts, ~(volume * (open + high + low + "close") / 4)~ AS amount, ~(volume)~ AS volume FROM bars', None)
def repaired_amounts(spark, sf_dir):
    """Bars without the amount column, repaired."""
    return clean.normalize_schema(adapter.bars(spark, sf_dir).drop("amount")).select("symbol", "ts", "amount", "volume")


@_query(
    f"""WITH {BARS} SELECT symbol, count(*) AS n, ~(min("close"))~ AS low_close, ~(max(volume))~ AS top_volume FROM bars
    WHERE day(ts) <> 13 GROUP BY symbol"""
)
def coerced_text_bars(spark, sf_dir):
    """Bars as text with a close on each 13th that is no number, coerced; those rows drop out."""
    bad = F.when(F.dayofmonth("ts") == 13, "n/a").otherwise(F.col("close").cast("string"))
    text = adapter.bars(spark, sf_dir).withColumn("close", bad)
    rows = clean.normalize_schema(text.withColumn("volume", F.col("volume").cast("string")))
    return rows.groupBy("symbol").agg(F.count("*").alias("n"), F.min("close").alias("low_close"), F.max("volume").alias("top_volume"))


@_query(
    f"""WITH {BARS}, f AS (
      SELECT symbol, ts, coalesce(last_value("close" IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING),
             first_value("close" IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS "close",
             coalesce(last_value(volume IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING),
             first_value(volume IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS volume FROM dense)
    SELECT symbol, ts, ~("close")~ AS "close", ~(volume)~ AS volume FROM f""",
    None,
)
def filled_series(spark, sf_dir):
    return clean.fill(_dense(spark, sf_dir), "series").select("symbol", "ts", "close", "volume")


@_query(f'WITH {BARS} SELECT symbol, ts, ~("close")~ AS "close" FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars) WHERE k <= 8', None)
def last_bars(spark, sf_dir):
    return slices.last_bars(adapter.bars(spark, sf_dir), 8).select("symbol", "ts", "close")


@_query(f"WITH {BARS} SELECT CASE WHEN ts < DATE '1999-01-01' THEN 'train' WHEN ts < DATE '2000-07-01' THEN 'val' ELSE 'test' END AS split, symbol, count(*) AS n FROM bars GROUP BY ALL")
def date_split_counts(spark, sf_dir):
    return adapter.bars(spark, sf_dir).groupBy(slices.split_by_date(F.col("ts"), TRAIN_END, VAL_END).alias("split"), "symbol").agg(F.count("*").alias("n"))


@_query(
    f"""WITH {BARS}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM num)
    SELECT symbol, ts, CASE WHEN n < 133 OR k > 7 THEN 'context' ELSE 'actual' END AS part, ~("close")~ AS "close" FROM k
    WHERE (n < 133 AND k <= 126) OR (n >= 133 AND k > 2 AND k <= 133)"""
)
def holdout_context(spark, sf_dir):
    return slices.context_slice(adapter.bars(spark, sf_dir), 126, 5).select("symbol", "ts", "part", "close")


@_query(
    f"""WITH {BARS}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k, count(*) OVER (PARTITION BY symbol) AS m FROM bars WHERE ts >= DATE '1999-01-01')
    SELECT symbol, ts, CASE WHEN k <= 60 THEN 'context' ELSE 'actual' END AS part FROM k WHERE m >= 60 AND k <= 65"""
)
def dated_context(spark, sf_dir):
    return slices.context_slice(adapter.bars(spark, sf_dir), 60, 5, "1999-01-01").select("symbol", "ts", "part")


@_query(
    f"""WITH {BARS}, l AS (SELECT symbol, max(ts) AS last, min(ts) AS prev, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars) WHERE k <= 2 GROUP BY symbol)
    SELECT symbol, step::INT AS step, last::TIMESTAMP + to_days((step * CASE WHEN n < 2 THEN 1 ELSE last - prev END)::INT) AS ts FROM l, (SELECT unnest(range(1, 6)) AS step)"""
)
def future_stamps(spark, sf_dir):
    return slices.future_index(adapter.bars(spark, sf_dir), 5).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@_query(
    f"""WITH {BARS}, v AS (SELECT symbol, ts, r, CASE WHEN count(r) OVER a = 20 THEN stddev_samp(r) OVER a * sqrt(250.0) END AS vol_20,
      CASE WHEN count(r) OVER b = 50 THEN stddev_samp(r) OVER b * sqrt(250.0) END AS vol_50 FROM ret
      WINDOW a AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), b AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
    SELECT symbol, ts, ~(r)~ AS r, ~(abs(r))~ AS abs_r, ~(vol_20)~ AS vol_20, ~(vol_50)~ AS vol_50 FROM v"""
)
def returns_and_volatility(spark, sf_dir):
    rows = profile.rolling_volatility(profile.log_returns(adapter.bars(spark, sf_dir)))
    return rows.select("symbol", "ts", "r", F.abs("r").alias("abs_r"), "vol_20", "vol_50")


@_query(
    f"""WITH {BARS}, f AS (SELECT symbol, ts, "close" IS NOT DISTINCT FROM lag("close") OVER w AS flat FROM (SELECT symbol, ts, round("close", -2) AS "close" FROM bars) WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    i AS (SELECT *, sum(CASE WHEN flat THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM f),
    u AS (SELECT symbol, island, sum(flat::INT) AS run FROM i GROUP BY ALL)
    SELECT symbol, max(run)::BIGINT AS longest, max(run) > 3 AS flagged FROM u GROUP BY symbol"""
)
def flat_runs(spark, sf_dir):
    """On closes in hundreds, so that there are runs."""
    return profile.flat_runs(adapter.bars(spark, sf_dir).withColumn("close", F.round("close", -2)), 3)


@_query(
    f"""WITH {BARS}, x AS (SELECT symbol, volume AS x, ln(volume + 1e-5) AS y FROM bars WHERE volume IS NOT NULL),
    m AS (SELECT symbol, count(*) AS n, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM x GROUP BY symbol)
    SELECT symbol, any_value(n) AS n, ~(avg(power((x - mx) / sx, 3)))~ AS skew_raw, ~(avg(power((x - mx) / sx, 4)) - 3)~ AS kurt_raw,
           ~(avg(power((y - my) / sy, 3)))~ AS skew_log, ~(avg(power((y - my) / sy, 4)) - 3)~ AS kurt_log
    FROM x JOIN m USING (symbol) WHERE n >= 10 GROUP BY symbol""",
    4,
)
def volume_shape(spark, sf_dir):
    return profile.shape(adapter.bars(spark, sf_dir), "volume")


@_query(
    f"""WITH {BARS}, s AS (SELECT symbol, stddev_pop("close") AS close_std, stddev_pop(volume) AS volume_std FROM bars GROUP BY symbol),
    l AS (UNPIVOT s ON close_std, volume_std INTO NAME feature VALUE v)
    SELECT feature, count(v) AS n, ~(avg(v))~ AS mean, ~(stddev_samp(v))~ AS std, ~(min(v))~ AS low, ~(quantile_cont(v, 0.25))~ AS q25,
           ~(quantile_cont(v, 0.5))~ AS q50, ~(quantile_cont(v, 0.75))~ AS q75, ~(max(v))~ AS high FROM l GROUP BY feature""",
    4,
)
def deviation_summary(spark, sf_dir):
    stats = adapter.bars(spark, sf_dir).groupBy("symbol").agg(F.stddev_pop("close").alias("close_std"), F.stddev_pop("volume").alias("volume_std"))
    return profile.summary(stats, ["close_std", "volume_std"])


@_query(
    f"""WITH {BARS}, x AS (SELECT CASE WHEN ts < DATE '1998-08-29' THEN 'before' ELSE 'after' END AS era, (isodow(ts) - 1)::INT AS weekday, r AS x FROM ret WHERE r IS NOT NULL),
    q AS (SELECT era, weekday, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.75) AS q75 FROM x GROUP BY ALL)
    SELECT era, weekday, ~(q25)~ AS q25, ~(q50)~ AS q50, ~(q75)~ AS q75, ~(min(x))~ AS whisker_low, ~(max(x))~ AS whisker_high, count(*) AS n_inside
    FROM x JOIN q USING (era, weekday) WHERE x BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) GROUP BY era, weekday, q25, q50, q75"""
)
def return_boxes(spark, sf_dir):
    keys = [slices.era(F.col("ts"), "1998-08-29").alias("era"), F.weekday("ts").alias("weekday")]
    return profile.box(profile.log_returns(adapter.bars(spark, sf_dir)), "r", keys)


@_query(
    f"""WITH {BARS}, s AS (SELECT min(r) AS lo, max(r) AS hi, count(r) AS total FROM ret),
    b AS (SELECT least(99, floor((r - lo) / ((hi - lo) / 100)))::INT AS bin, lo, hi, total FROM ret, s WHERE r IS NOT NULL)
    SELECT bin, count(*) AS n, ~(count(*) / (any_value(total) * ((any_value(hi) - any_value(lo)) / 100)))~ AS density FROM b GROUP BY bin"""
)
def return_histogram(spark, sf_dir):
    return profile.histogram(profile.log_returns(adapter.bars(spark, sf_dir)), "r")


@_query(
    f"""WITH {BARS}, x AS (SELECT symbol, log10(amount + 1e-5) AS x FROM bars), s AS (SELECT symbol, min(x) AS lo, max(x) AS hi, count(*) AS total FROM x GROUP BY symbol),
    b AS (SELECT symbol, least(29, floor((x - lo) / ((hi - lo) / 30)))::INT AS bin, lo, hi, total FROM x JOIN s USING (symbol))
    SELECT symbol, bin, count(*) AS n, ~(count(*) / (any_value(total) * ((any_value(hi) - any_value(lo)) / 30)))~ AS density FROM b GROUP BY symbol, bin"""
)
def amount_density(spark, sf_dir):
    rows = adapter.bars(spark, sf_dir).withColumn("x", F.log10(F.col("amount") + 1e-5))
    return profile.histogram(rows, "x", 30, ("symbol",))


@_query(
    f"""WITH {BARS}, v AS (SELECT symbol, log10(amount + 1e-5) AS v FROM bars WHERE amount IS NOT NULL),
    s AS (SELECT symbol, min(v) AS lo, max(v) AS hi, count(*) AS n, stddev_samp(v) * count(*)::DOUBLE ** -0.2 AS h FROM v GROUP BY symbol HAVING min(v) < max(v)),
    g AS (SELECT s.*, point, lo - 3 * h + point * ((hi - lo + 6 * h) / 199) AS x FROM s, range(200) t(point))
    SELECT symbol, point, ~(any_value(x))~ AS x, ~(sum(exp(-(((x - v) / h) ** 2) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())))~ AS density FROM g JOIN v USING (symbol) GROUP BY symbol, point""",
    5,
)
def amount_density_curve(spark, sf_dir):
    rows = adapter.bars(spark, sf_dir).withColumn("v", F.log10(F.col("amount") + 1e-5))
    return profile.density_curve(rows, "v", ("symbol",))


@_query(
    f"""WITH {BARS}, p AS (SELECT a.symbol AS symbol_a, b.symbol AS symbol_b, a.r AS x, b.r AS y FROM ret a JOIN ret b ON a.ts = b.ts AND a.symbol < b.symbol WHERE a.r IS NOT NULL AND b.r IS NOT NULL),
    c AS (SELECT symbol_a, symbol_b, sum(x * y) - sum(x) * sum(y) / count(*) AS cov, sum(x * x) - sum(x) * sum(x) / count(*) AS va, sum(y * y) - sum(y) * sum(y) / count(*) AS vb FROM p GROUP BY ALL)
    SELECT symbol_a, symbol_b, ~(coalesce(CASE WHEN va > 1e-12 AND vb > 1e-12 THEN cov / (sqrt(va) * sqrt(vb)) END, 0.0))~ AS corr FROM c"""
)
def return_correlations(spark, sf_dir):
    return profile.correlation_pairs(profile.log_returns(adapter.bars(spark, sf_dir)))


@_query(
    f"""WITH {BARS}, c AS (SELECT symbol, ts, "close" / first("close") OVER w AS rebased, "close" - coalesce(lag("close") OVER w, "close") AS change,
      ("close" - coalesce(lag("close") OVER w, "close")) / coalesce(lag("close") OVER w, "close") * 100 AS change_pct FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))
    SELECT symbol, ts, ~(rebased)~ AS rebased, ~(change)~ AS change, ~(change_pct)~ AS change_pct FROM c""",
    None,
)
def rebased_and_change(spark, sf_dir):
    return profile.change(profile.rebased(adapter.bars(spark, sf_dir))).select("symbol", "ts", "rebased", "change", "change_pct")


@_query(
    f"""WITH {BARS}, i AS (SELECT symbol, r, row_number() OVER (PARTITION BY symbol ORDER BY r) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM ret WHERE r IS NOT NULL),
    p AS (SELECT symbol, r, CASE WHEN i = n THEN 0.5 ** (1.0 / n) WHEN i = 1 THEN 1 - 0.5 ** (1.0 / n) ELSE (i - 0.3175) / (n + 0.365) END::DOUBLE AS p FROM i),
    t AS (SELECT symbol, r, {scalars.normal_quantile_sql("p")} AS t FROM p)
    SELECT symbol, ~(regr_slope(r, t))~ AS slope, ~(regr_intercept(r, t))~ AS intercept, ~(regr_r2(r, t))~ AS r2 FROM t GROUP BY symbol"""
)
def return_qq_fit(spark, sf_dir):
    return profile.qq_fit(profile.qq(profile.log_returns(adapter.bars(spark, sf_dir))))


_NULLS = '(open IS NULL)::INT + (high IS NULL)::INT + (low IS NULL)::INT + ("close" IS NULL)::INT + (volume IS NULL)::INT + (amount IS NULL)::INT'


@_query(
    f"""WITH {BARS}, x AS (SELECT symbol, row_number() OVER w - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n,
      sum({_NULLS}) OVER (w ROWS BETWEEN CURRENT ROW AND 130 FOLLOWING) / (131.0 * 6) AS share FROM dense WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    c AS (SELECT symbol, count(*) AS total, count(*) FILTER (share <= 0.10) AS valid FROM x WHERE rn + 131 <= n GROUP BY symbol)
    SELECT symbol, total, valid, total - valid AS discarded, ~(100.0 * (total - valid) / total)~ AS discarded_pct FROM c"""
)
def window_counts(spark, sf_dir):
    return windows.window_counts(_dense(spark, sf_dir))


def _each(form: str) -> str:
    """The form for each feature, joined as a list of columns or a union of SELECTs."""
    return (" UNION ALL " if form.startswith("SELECT") else ", ").join(form.replace("{c}", c) for c in FEATURES)


_STDS = f"""WITH {BARS}, s AS (SELECT symbol, {_each('CASE WHEN count("{c}") OVER w = 126 THEN stddev_pop("{c}") OVER w END AS "{c}"')}
    FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 125 PRECEDING AND CURRENT ROW)),
    l AS ({_each("""SELECT symbol, '{c}' AS feature, min("{c}") AS min_std FROM s GROUP BY symbol""")})"""


@_query(f"{_STDS} SELECT symbol, feature, ~(min_std)~ AS min_std FROM l", 4)
def smallest_window_std(spark, sf_dir):
    return windows.min_window_std(adapter.bars(spark, sf_dir))


@_query(f"{_STDS} SELECT feature, count(*) FILTER (min_std = 0) AS zero_symbols FROM l GROUP BY feature")
def zero_std_symbols(spark, sf_dir):
    return windows.zero_std_symbols(windows.min_window_std(adapter.bars(spark, sf_dir)))


@_query(
    f"""WITH {BARS}, s AS (SELECT symbol, rn AS start, n, {_each('avg("{c}") OVER w AS "{c}_m", stddev_pop("{c}") OVER w AS "{c}_d"')} FROM num WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND 125 FOLLOWING)),
    z AS (SELECT {_each('avg(CASE WHEN abs((b."{c}" - "{c}_m") / (CASE WHEN "{c}_d" < 1e-6 THEN 1 ELSE "{c}_d" END + 1e-5)) > 5 THEN 1.0 ELSE 0.0 END) AS "{c}"')} FROM s JOIN num b ON b.symbol = s.symbol AND b.rn BETWEEN s.start AND s.start + 125 WHERE s.start + 126 <= s.n)
    {_each("""SELECT '{c}' AS feature, ~("{c}")~ AS rate FROM z""")}"""
)
def clip_rate(spark, sf_dir):
    return windows.clip_rate(adapter.bars(spark, sf_dir))


_SPLIT = f"""WITH {FORECAST}, c AS (SELECT symbol, coalesce(min(rn) FILTER (ts >= DATE '1999-01-01'), count(*)) AS a, coalesce(min(rn) FILTER (ts >= DATE '2000-07-01'), count(*)) AS b FROM num GROUP BY symbol),
    w AS (SELECT symbol, rn AS start, n, ts AS ts_first, lead(ts, 131) OVER o AS ts_last FROM num WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
    k AS (SELECT w.symbol, start, ts_first, ts_last, CASE WHEN ts_last < DATE '1999-01-01' THEN 'train' WHEN start + 126 >= a + 5 AND ts_last < DATE '2000-07-01' THEN 'val' WHEN start + 126 >= b + 5 THEN 'test' END AS split
          FROM w JOIN c USING (symbol) WHERE start + 132 <= n)"""


@_query(f"{_SPLIT} SELECT symbol, split, count(*) AS n, min(ts_first) AS first_ts, max(ts_last) AS last_ts FROM k WHERE split IS NOT NULL GROUP BY ALL")
def window_splits(spark, sf_dir):
    rows = adapter.bars(spark, sf_dir)
    found = windows.assign_split(rows, windows.make_windows(rows, 126, 5), TRAIN_END, VAL_END, 126)
    return found.groupBy("symbol", "split").agg(F.count("*").alias("n"), F.min("ts_first").alias("first_ts"), F.max("ts_last").alias("last_ts"))


@_query(f"{_SPLIT}, d AS (SELECT *, row_number() OVER (PARTITION BY symbol, split ORDER BY md5('42:' || symbol || ':' || start), symbol, start) AS r FROM k WHERE split IS NOT NULL) SELECT symbol, split, start FROM d WHERE r <= 100")
def sampled_windows(spark, sf_dir):
    rows = adapter.bars(spark, sf_dir)
    found = windows.assign_split(rows, windows.make_windows(rows, 126, 5), TRAIN_END, VAL_END, 126)
    return windows.sample_starts(found, 100, 42, ("symbol", "split")).select("symbol", "split", "start")


_GAPS = "split_part(symbol, '#', 2)::INT % 5 = 0"
_FILLED = ", ".join(f'coalesce(last_value("{c}" IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING), first_value("{c}" IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS "{c}"' for c in FEATURES)


@_query(
    f"""WITH {BARS}, a AS (SELECT * REPLACE (CASE WHEN {_GAPS} THEN volume * ((open + high + low + "close") / 4) ELSE amount END AS amount) FROM dense WHERE ts >= DATE '{TRAIN_END}' AND ts < DATE '{VAL_END}'),
    f AS (SELECT symbol, ts, row_number() OVER w - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n, {_FILLED} FROM a WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    s AS (SELECT symbol, rn AS start, row_number() OVER (PARTITION BY symbol ORDER BY md5('42:' || symbol || ':' || rn), rn) AS draw FROM f WHERE rn + 126 <= n)
    SELECT symbol, start::INT AS start, (rn - start)::INT AS pos, ts, {_each('~("{c}")~ AS "{c}"')} FROM s JOIN f USING (symbol) WHERE draw <= 100 AND rn BETWEEN start AND start + 125""",
    None,
)
def benchmark_windows(spark, sf_dir):
    """Sampled windows of the validation split with their rows; every fifth brand has no amounts, and days without bars are filled."""
    gaps = F.substring_index("symbol", "#", -1).cast("int") % 5 == 0
    rows = _dense(spark, sf_dir).withColumn("amount", F.when(~gaps, F.col("amount")))
    return windows.benchmark_windows(rows, "val", TRAIN_END, VAL_END)


@_query(
    f"""{_SPLIT}, d AS (SELECT *, row_number() OVER (PARTITION BY symbol, split ORDER BY md5('42:' || symbol || ':' || start), symbol, start) AS r FROM k WHERE split = 'val'),
    e AS (SELECT ev.* FROM d JOIN num ON num.symbol = d.symbol AND num.rn = d.start + 125 JOIN ev ON ev.symbol = d.symbol AND ev.t_date = num.ts WHERE r <= 20)
    SELECT symbol, count(*) AS n, ~(avg(CASE WHEN (actual_return > 0 AND pred_return > 0) OR (actual_return <= 0 AND pred_return <= 0) THEN 1.0 ELSE 0.0 END) * 100)~ AS da,
           ~(sum(abs(actual_return) * CASE WHEN (actual_return > 0) = (pred_return > 0) THEN 1.0 ELSE 0.0 END) / sum(abs(actual_return)) * 100)~ AS mw_da FROM e GROUP BY symbol"""
)
def sampled_window_accuracy(spark, sf_dir):
    """Direction over 20 drawn validation windows of each symbol; up is above 0, all else down."""
    rows = adapter.bars(spark, sf_dir)
    found = windows.assign_split(rows, windows.make_windows(rows, 126, 5), TRAIN_END, VAL_END, 126).where("split = 'val'")
    drawn = windows.sample_starts(found, 20).select("symbol", F.col("asof_ts").alias("t_date"))
    return quality.direction(_eval(spark, sf_dir).join(drawn, ["symbol", "t_date"]), "symbol")


@_query(f"WITH {FORECAST} SELECT symbol, t_date, row_number() OVER (ORDER BY t_date, symbol) - 1 AS place FROM ev")
def evaluation_order(spark, sf_dir):
    return quality.evaluation_order(_eval(spark, sf_dir)).select("symbol", "t_date", "place")


@_query(
    f"""WITH {BARS}, x AS (SELECT symbol, ts, "close", volume, row_number() OVER w - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM dense WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    u AS (SELECT s.symbol, s.rn AS start, b.rn - s.rn AS pos, b."close", b.volume FROM x s JOIN x b ON b.symbol = s.symbol AND b.rn BETWEEN s.rn AND s.rn + 15 WHERE s.rn + 16 <= s.n),
    f AS (SELECT symbol, start, pos, coalesce(last_value("close" IGNORE NULLS) OVER o, 0) AS c, coalesce(last_value(volume IGNORE NULLS) OVER o, 0) AS v FROM u WINDOW o AS (PARTITION BY symbol, start ORDER BY pos ROWS UNBOUNDED PRECEDING)),
    m AS (SELECT symbol, start, avg(c) FILTER (pos < 10) AS mc, stddev_pop(c) FILTER (pos < 10) AS sc, avg(v) FILTER (pos < 10) AS mv, stddev_pop(v) FILTER (pos < 10) AS sv FROM f GROUP BY ALL),
    z AS (SELECT symbol, pos, greatest(least((c - mc) / (CASE WHEN sc < 1e-6 THEN 1 ELSE sc END + 1e-5), 5), -5) AS zc, greatest(least((v - mv) / (CASE WHEN sv < 1e-6 THEN 1 ELSE sv END + 1e-5), 5), -5) AS zv FROM f JOIN m USING (symbol, start))
    SELECT symbol, pos::INT AS pos, count(*) AS n, ~(avg(zc))~ AS mean_z_close, ~(avg(zv))~ AS mean_z_volume, ~(max(abs(zc)))~ AS top_z_close FROM z GROUP BY symbol, pos""",
    5,
)
def normalized_windows(spark, sf_dir):
    rows = _dense(spark, sf_dir)
    found = windows.normalize_windows(rows, None, 10, 5)
    return found.groupBy("symbol", "pos").agg(
        F.count("*").alias("n"), F.avg("z_close").alias("mean_z_close"), F.avg("z_volume").alias("mean_z_volume"), F.max(F.abs("z_close")).alias("top_z_close")
    )


@_query(
    f"""WITH {BARS}, s AS (SELECT symbol, rn, n, "close" AS x, avg("close") OVER a AS m1, stddev_pop("close") OVER a AS s1, avg("close") OVER b AS m2, stddev_pop("close") OVER b AS s2, avg("close") OVER c AS m3 FROM num
      WINDOW a AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND 125 FOLLOWING), b AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND 130 FOLLOWING), c AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 126 FOLLOWING AND 130 FOLLOWING)),
    d AS (SELECT symbol, rn, m1, m3, abs((x - m1) / (CASE WHEN s1 < 1e-6 THEN 1 ELSE s1 END + 1e-5) - (x - m2) / (CASE WHEN s2 < 1e-6 THEN 1 ELSE s2 END + 1e-5)) AS diff FROM s WHERE rn + 131 <= n)
    SELECT symbol, ~(avg(diff))~ AS mean_diff, ~(max(diff))~ AS max_diff, -(max(row(abs(m3 - m1), -rn))[2]) AS most_shifted_start FROM d GROUP BY symbol"""
)
def leak_report(spark, sf_dir):
    return windows.leak_report(adapter.bars(spark, sf_dir))


@_query("SELECT event_type AS symbol, minute(ts)::INT AS minute, hour(ts)::INT AS hour, (isodow(ts) - 1)::INT AS weekday, day(ts)::INT AS day, month(ts)::INT AS month, count(*) AS n FROM events GROUP BY ALL")
def time_features(spark, sf_dir):
    rows = adapter.read(spark, sf_dir, "events")
    stamps = scalars.time_features(F.col("ts"))
    return rows.groupBy(F.col("event_type").alias("symbol"), *(c.alias(n) for n, c in stamps.items())).agg(F.count("*").alias("n"))


@_query(
    """WITH b AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS "close", count(*)::DOUBLE AS volume, sum(value) AS amount FROM events GROUP BY 1, 2)
    SELECT symbol, ts, ~(open)~ AS open, ~(high)~ AS high, ~(low)~ AS low, ~("close")~ AS "close", ~(volume)~ AS volume, ~(amount)~ AS amount FROM b"""
)
def hourly_candles(spark, sf_dir):
    return candles(adapter.read(spark, sf_dir, "events"), "event_type", "value").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@_query(
    f"""WITH {BARS}, l AS (SELECT symbol, ts, "close", lag("close") OVER (PARTITION BY symbol ORDER BY ts) AS ref FROM bars),
    p AS (SELECT *, round(ref * 1.07 / 100) * 100 AS ceiling, round(ref * 0.93 / 100) * 100 AS floor FROM l WHERE ref IS NOT NULL)
    SELECT symbol, ts, ~(ceiling)~ AS ceiling, ~(floor)~ AS floor, CASE WHEN "close" >= ceiling - 50 THEN 'ceiling' WHEN "close" <= floor + 50 THEN 'floor' ELSE 'between' END AS side FROM p""",
    None,
)
def price_limits(spark, sf_dir):
    rows = adapter.bars(spark, sf_dir).withColumn("ref", F.lag("close").over(clean.by_symbol())).where("ref is not null")
    top, bottom, side = scalars.price_limits(F.col("ref"), F.col("close"))
    return rows.select("symbol", "ts", top.alias("ceiling"), bottom.alias("floor"), side.alias("side"))


@_query(
    f"""WITH {BARS}, l AS (SELECT symbol, ts, exchange, lag("close") OVER (PARTITION BY symbol ORDER BY ts) AS ref FROM bars JOIN dim USING (symbol))
    SELECT symbol, ts, ~(round(ref * (1 + CASE exchange WHEN 'HNX' THEN 0.1 ELSE 0.07 END) / 100) * 100)~ AS ceiling, ~(round(ref * (1 - CASE exchange WHEN 'HNX' THEN 0.1 ELSE 0.07 END) / 100) * 100)~ AS floor FROM l WHERE ref IS NOT NULL""",
    0,
)
def price_limits_by_exchange(spark, sf_dir):
    rows = adapter.bars(spark, sf_dir).withColumn("ref", F.lag("close").over(clean.by_symbol())).where("ref is not null")
    rows = rows.join(adapter.dimension(spark, sf_dir).select("symbol", "exchange"), "symbol")
    top, bottom, _ = scalars.price_limits(F.col("ref"), F.col("close"), scalars.exchange_limit(F.col("exchange")))
    return rows.select("symbol", "ts", top.alias("ceiling"), bottom.alias("floor"))


@_query(
    f"""WITH {BARS}, v AS (SELECT symbol, sum(volume) AS x FROM bars GROUP BY symbol UNION ALL SELECT symbol, min(volume) FROM bars GROUP BY symbol UNION ALL SELECT symbol, sum(amount) FROM bars GROUP BY symbol)
    SELECT symbol, CASE WHEN x >= 1e9 THEN format('{{:.1f}}B', x / 1e9) WHEN x >= 1e6 THEN format('{{:.1f}}M', x / 1e6) WHEN x >= 1e3 THEN format('{{:.1f}}K', x / 1e3) ELSE format('{{:.1f}}', x) END AS text FROM v"""
)
def size_texts(spark, sf_dir):
    rows = adapter.bars(spark, sf_dir).groupBy("symbol").agg(F.sum("volume").alias("a"), F.min("volume").alias("b"), F.sum("amount").alias("c"))
    return rows.unpivot("symbol", ["a", "b", "c"], "of", "x").select("symbol", scalars.short_number(F.col("x")).alias("text"))


@_query(f"WITH {BARS} SELECT DISTINCT ts, CASE isodow(ts + 3) WHEN 6 THEN ts + 5 WHEN 7 THEN ts + 4 ELSE ts + 3 END AS due, strftime(ts, '%Y%m%d') AS tag FROM bars")
def settlement_dates(spark, sf_dir):
    days = profile.trading_dates(adapter.bars(spark, sf_dir))
    return days.select("ts", scalars.settlement_date(F.col("ts")).alias("due"), scalars.date_tag(F.col("ts")).alias("tag"))


@_query(f"WITH {CODES} SELECT vec_id, label, s1, s2, s1 + (s2 << 10) AS composite, (s1 + (s2 << 10)) & 1023 AS low, ((s1 + (s2 << 10)) >> 10) & 1023 AS high FROM codes")
def sign_codes(spark, sf_dir):
    rows = adapter.codes(spark, sf_dir).withColumn("composite", tokens.join_token(F.col("s1"), F.col("s2")))
    low, high = tokens.split_token(F.col("composite"))
    return rows.select("vec_id", "label", "s1", "s2", "composite", low.alias("low"), high.alias("high"))


@_query(
    f"""WITH {CODES}, u AS (SELECT vec_id, unnest(range(len(embedding)))::INT AS element, unnest(embedding)::DOUBLE AS x, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)
    SELECT vec_id, element, ~(x / n)~ AS unit, ~(CASE WHEN x > 0 THEN 0.125 ELSE -0.125 END)~ AS sign FROM u"""
)
def unit_and_sign_vectors(spark, sf_dir):
    """Each element of each vector, at length 1 and as its sign."""
    rows = adapter.read(spark, sf_dir, "embeddings")
    both = F.arrays_zip(tokens.l2_normalize(F.col("embedding")).alias("unit"), tokens.sign_quantize(F.col("embedding")).alias("sign"))
    found = rows.select("vec_id", F.posexplode(both).alias("element", "x"))
    return found.select("vec_id", "element", F.col("x.unit").cast("double").alias("unit"), F.col("x.sign").cast("double").alias("sign"))


@_query(f"WITH {CODES}, c AS (SELECT s1 AS token, count(*) AS n FROM codes GROUP BY s1) SELECT token, n, ~(n / (SELECT max(n) FROM c)::DOUBLE)~ AS share FROM c")
def token_frequency(spark, sf_dir):
    return tokens.token_frequency(adapter.codes(spark, sf_dir), "s1")


@_query(
    f"""WITH {CODES}, l AS (SELECT label, s1 FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS back FROM codes) WHERE back <= 15),
    c AS (SELECT label, s1 AS token, count(*) AS n FROM l GROUP BY ALL), p AS (SELECT *, n / max(n) OVER (PARTITION BY label)::DOUBLE AS share, row_number() OVER (PARTITION BY label ORDER BY n DESC, token) AS place FROM c)
    SELECT label, token, n, ~(share)~ AS share FROM p WHERE place <= 10"""
)
def recent_token_frequency(spark, sf_dir):
    """The ten most frequent codes among the last 15 of each label."""
    latest = tokens.last_rows(adapter.codes(spark, sf_dir), ("label",), "vec_id", 15)
    return tokens.token_frequency(latest, "s1", 10, ("label",))


@_query(f"WITH {CODES} SELECT b.token::BIGINT AS token, count(c.s1) AS n FROM (SELECT unnest(range(1024)) AS token) b LEFT JOIN codes c ON c.s1 = b.token GROUP BY b.token")
def token_histogram(spark, sf_dir):
    return tokens.token_histogram(adapter.codes(spark, sf_dir), "s1")


@_query(f"WITH {CODES} SELECT 's1' AS code, count(DISTINCT s1) AS used, ~(count(DISTINCT s1) * 100.0 / 1024)~ AS used_pct FROM codes UNION ALL SELECT 's2', count(DISTINCT s2), ~(count(DISTINCT s2) * 100.0 / 1024)~ FROM codes")
def codebook_utilisation(spark, sf_dir):
    return tokens.utilisation(adapter.codes(spark, sf_dir))


@_query(
    f"""WITH {CODES}, r AS (SELECT unnest([0, 3, 10]) AS first, unnest([0, 9, 29]) AS last), d AS (SELECT c.*, vec_id % 30 AS day FROM codes c)
    SELECT first::INT AS first, last::INT AS last, code, used, ~(used * 100.0 / 1024)~ AS used_pct FROM (
      SELECT first, last, 's1' AS code, count(DISTINCT s1) AS used FROM r JOIN d ON day BETWEEN first AND last GROUP BY first, last UNION ALL
      SELECT first, last, 's2', count(DISTINCT s2) FROM r JOIN d ON day BETWEEN first AND last GROUP BY first, last)"""
)
def codebook_use_by_days(spark, sf_dir):
    """Use of the codebooks over ranges of days, merged from one bitmap a day."""
    days = tokens.code_bitmaps(adapter.codes(spark, sf_dir).withColumn("day", F.col("vec_id") % 30), "day")
    found = [tokens.utilisation_between(days, a, b).select(F.lit(a).alias("first"), F.lit(b).alias("last"), "*") for a, b in ((0, 0), (3, 9), (10, 29))]
    return found[0].unionAll(found[1]).unionAll(found[2])


_DRIFT = """h_{c} AS (SELECT token, (SELECT count(*) FROM codes c WHERE c.{c} = token AND label < 5) + 1e-10 AS a, (SELECT count(*) FROM codes c WHERE c.{c} = token AND label >= 5) + 1e-10 AS b FROM (SELECT unnest(range(1024)) AS token)),
    k_{c} AS (SELECT sum(a / sa * ln((a / sa) / (b / sb))) AS kl FROM h_{c}, (SELECT sum(a) AS sa, sum(b) AS sb FROM h_{c}))"""


@_query(f"WITH {CODES}, {_DRIFT.replace('{c}', 's1')}, {_DRIFT.replace('{c}', 's2')} SELECT ~((x.kl + y.kl) / 2)~ AS kl, ~(x.kl)~ AS kl_s1, ~(y.kl)~ AS kl_s2 FROM k_s1 x, k_s2 y")
def token_drift(spark, sf_dir):
    """KL divergence of the codes of one half of the labels from the other's, for both codes and their mean."""
    rows = adapter.codes(spark, sf_dir)
    part = None
    for c in ("s1", "s2"):
        kl = tokens.kl_drift(tokens.token_histogram(rows.where("label < 5"), c), tokens.token_histogram(rows.where("label >= 5"), c)).withColumn("code", F.lit(c))
        part = kl if part is None else part.unionByName(kl)
    of = {c: F.max(F.when(F.col("code") == c, F.col("kl"))) for c in ("s1", "s2")}
    return part.agg(F.avg("kl").alias("kl"), *(v.alias(f"kl_{c}") for c, v in of.items()))


@_query(f"WITH {CODES} SELECT vec_id, token, ~(p)~ AS p FROM nuc")
def nucleus_filter(spark, sf_dir):
    return tokens.filter_logits(adapter.logits(spark, sf_dir), "vec_id", temperature=0.7, top_p=0.9).select("vec_id", "token", "p")


@_query(f"WITH {CODES}, k AS (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY logit DESC) AS r FROM sm) SELECT vec_id, token, ~(p / sum(p) OVER (PARTITION BY vec_id))~ AS p FROM k WHERE r <= 5")
def top_k_filter(spark, sf_dir):
    return tokens.filter_logits(adapter.logits(spark, sf_dir), "vec_id", temperature=0.7, top_k=5).select("vec_id", "token", "p")


@_query(
    f"""WITH {CODES}, u AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, token ROWS UNBOUNDED PRECEDING) AS upto, ('0x' || substr(md5('42:' || vec_id), 1, 8))::UBIGINT / 4294967296.0 AS u FROM nuc)
    SELECT vec_id, coalesce(min_by(token, row(-p, token)) FILTER (upto > u), max_by(token, row(-p, token))) AS token FROM u GROUP BY vec_id"""
)
def drawn_tokens(spark, sf_dir):
    return tokens.draw(tokens.filter_logits(adapter.logits(spark, sf_dir), "vec_id", temperature=0.7, top_p=0.9), "vec_id")


@_query(f"WITH {CODES} SELECT vec_id, ~(-sum(p * ln(p + 1e-8)))~ AS entropy, min_by(token, row(-logit, token)) AS best FROM sm GROUP BY vec_id")
def entropy_and_arg_max(spark, sf_dir):
    rows = adapter.logits(spark, sf_dir)
    best = tokens.arg_max(rows, "vec_id").withColumnRenamed("token", "best")
    return tokens.entropy(tokens.softmax(rows, "vec_id", temperature=0.7), "vec_id").join(best, "vec_id")


_RECON = f"""WITH {FORECAST}, p AS (SELECT 'last' AS model, symbol AS feature, c5 AS x, pred_last AS y FROM led WHERE c5 IS NOT NULL AND pred_last IS NOT NULL
    UNION ALL SELECT 'mean', symbol, c5, pred_mean FROM led WHERE c5 IS NOT NULL AND pred_mean IS NOT NULL
    UNION ALL SELECT 'drift', symbol, c5, pred_drift FROM led WHERE c5 IS NOT NULL AND pred_drift IS NOT NULL)"""


@_query(f"{_RECON} SELECT model, feature, ~(avg(abs(x - y) / greatest(abs(x), 1e-5) * 100))~ AS mape, ~(quantile_cont(abs(x - y) / greatest(abs(x), 1e-5) * 100, 0.5))~ AS mdape, ~(avg(abs(x - y)))~ AS mae FROM p GROUP BY model, feature")
def reconstruction_errors(spark, sf_dir):
    return _recon(spark, sf_dir)


def _recon(spark, sf_dir):
    rows = score.baselines(adapter.bars(spark, sf_dir), P["lookback"], 5).withColumn("x", F.lead("close", 5).over(clean.by_symbol()))
    long = rows.select("symbol", "x", F.expr("stack(3, 'last', pred_last, 'mean', pred_mean, 'drift', pred_drift) as (model, y)"))
    return tokens.recon_error(long.where("x is not null and y is not null").withColumnRenamed("symbol", "feature"))


@_query(f"WITH {FORECAST} SELECT symbol, t_date, t5_date, ~(actual_close_t)~ AS actual_close_t, ~(actual_close_t5)~ AS actual_close_t5, ~(pred_close_t5)~ AS pred_close_t5, ~(actual_return)~ AS actual_return, ~(pred_return)~ AS pred_return FROM ev", None)
def evaluation_rows(spark, sf_dir):
    return _eval(spark, sf_dir)


_HIT = "CASE WHEN (actual_return > 0) = (pred_return > 0) THEN 1.0 ELSE 0.0 END"
_PER_DATE = f"WITH {FORECAST}{_dates('ev', 'ev')}{RANKED}"


@_query(
    f"""{_PER_DATE} SELECT s.t_date, ~(avg({_HIT}) * 100)~ AS da, ~(any_value(ic.rank_ic))~ AS rank_ic, ~(avg(CASE WHEN actual_return > 0 THEN 1.0 ELSE 0.0 END) FILTER (is_long) * 100)~ AS hit_rate,
    array_to_string(list(symbol ORDER BY pred_return DESC, symbol) FILTER (is_long), ',') AS long_symbols FROM ev_s s LEFT JOIN ic ON ic.t_date = s.t_date GROUP BY s.t_date"""
)
def per_date_metrics(spark, sf_dir):
    rows = quality.every_nth_date(_eval(spark, sf_dir))
    return quality.per_date(rows, P["top_k"], P["min_symbols"]).withColumn("long_symbols", F.array_join("long_symbols", ","))


def _both_per_date(spark, sf_dir):
    return (
        quality.per_date(quality.every_nth_date(_eval(spark, sf_dir, m)), P["top_k"], P["min_symbols"]) for m in ("pred_drift", "pred_mean")
    )


_TWO = f"""{_PER_DATE}{_dates('evm', 'evm')},
    a AS (SELECT t_date, avg({_HIT}) * 100 AS da, list(symbol) FILTER (is_long) AS l FROM ev_s GROUP BY t_date), b AS (SELECT t_date, avg({_HIT}) * 100 AS da, list(symbol) FILTER (is_long) AS l FROM evm_s GROUP BY t_date)"""


@_query(
    f"""{_TWO}{_rank_ic("evm", "icm")}, d AS (SELECT 'da' AS metric, b.da - a.da AS d FROM a JOIN b USING (t_date) UNION ALL SELECT 'rank_ic', icm.rank_ic - ic.rank_ic FROM ic JOIN icm USING (t_date)),
    s AS (SELECT metric, count(d) AS n, avg(d) AS mean_diff, avg(d) / (stddev_samp(d) / sqrt(count(d))) AS t FROM d GROUP BY metric)
    SELECT metric, n, ~(mean_diff)~ AS mean_diff, ~(t)~ AS t, ~({T_P})~ AS p FROM s"""
)
def paired_t_test(spark, sf_dir):
    return quality.paired_t(*_both_per_date(spark, sf_dir))


@_query(f"{_TWO} SELECT ~(avg(len(list_intersect(a.l, b.l)) / len(a.l)::DOUBLE))~ AS overlap, count(*) AS dates FROM a JOIN b USING (t_date)")
def long_list_overlap(spark, sf_dir):
    return quality.mean_overlap(*_both_per_date(spark, sf_dir))


@_query(
    f"""{_TWO}, x AS (SELECT year(t_date) AS year, avg(da) AS da FROM a GROUP BY 1), y AS (SELECT year(t_date) AS year, avg(da) AS da FROM b GROUP BY 1)
    SELECT year::INT AS year, ~(round_even(coalesce(x.da, 50.0), 1))~ AS base_da, ~(round_even(coalesce(y.da, 50.0), 1))~ AS candidate_da FROM x FULL JOIN y USING (year)"""
)
def yearly_comparison(spark, sf_dir):
    return quality.compare_years(*_both_per_date(spark, sf_dir))


@_query(f"{_PER_DATE} SELECT CASE WHEN da >= 55 THEN 'good' WHEN da >= 52 THEN 'ok' ELSE 'bad' END AS grade, count(*) AS n FROM (SELECT avg({_HIT}) * 100 AS da FROM ev_s GROUP BY t_date) GROUP BY 1")
def daily_grades(spark, sf_dir):
    days = quality.direction(_chosen(spark, sf_dir), "t_date")
    return days.groupBy(quality.grade(F.col("da")).alias("grade")).agg(F.count("*").alias("n"))


@_query(
    f"""WITH {FORECAST}, m AS (SELECT 'drift' AS model, * FROM (SELECT symbol, t_date, actual_return, pred_return FROM ev) UNION ALL SELECT 'mean', symbol, t_date, actual_return, pred_return FROM evm)
    SELECT model, CASE WHEN t_date < DATE '1999-01-01' THEN 'train' WHEN t_date < DATE '2000-07-01' THEN 'val' ELSE 'test' END AS split, count(*) AS n, ~(avg({_HIT}) * 100)~ AS da, ~(sum(abs(actual_return) * {_HIT}) / sum(abs(actual_return)) * 100)~ AS mw_da FROM m GROUP BY 1, 2"""
)
def direction_by_model(spark, sf_dir):
    rows = None
    for name in ("drift", "mean"):
        part = _eval(spark, sf_dir, f"pred_{name}").withColumn("model", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    return quality.direction(rows.withColumn("split", slices.split_by_date(F.col("t_date"), TRAIN_END, VAL_END)), "model", "split")


@_query(
    f"""WITH {PORTFOLIO} SELECT t_date, ~(long_ret)~ AS long_ret, ~(short_ret)~ AS short_ret, ~(bench_ret)~ AS bench_ret, ~(long_mag_ret)~ AS long_mag_ret, ~(short_mag_ret)~ AS short_mag_ret,
    ~(long_turnover)~ AS long_turnover, ~(short_turnover)~ AS short_turnover, ~(long_mag_turnover)~ AS long_mag_turnover, ~(short_mag_turnover)~ AS short_mag_turnover,
    ~(long)~ AS long, ~(ls)~ AS ls, ~(bench)~ AS bench, ~(long_mag)~ AS long_mag, ~(ls_mag)~ AS ls_mag FROM net"""
)
def portfolio_returns(spark, sf_dir):
    found = portfolio.portfolio_returns(_eval(spark, sf_dir), P["top_k"], P["min_symbols"])
    kept = [f"{n}_ret" for n in ("long", "short", "bench", "long_mag", "short_mag")] + [f"{n}_turnover" for n in ("long", "short", "long_mag", "short_mag")]
    return found.select("t_date", *kept, *portfolio.CURVES)


def _curves(spark, sf_dir):
    return portfolio.curves(portfolio.portfolio_returns(_eval(spark, sf_dir), P["top_k"], P["min_symbols"]))


@_query(f"WITH {PORTFOLIO} SELECT curve, t_date, ~(net)~ AS net, ~(cum)~ AS cum, ~(drawdown)~ AS drawdown FROM crv")
def portfolio_curves(spark, sf_dir):
    return _curves(spark, sf_dir).drop("equity")  # exp(cum), whose digits grow with its size


@_query(f"WITH {PORTFOLIO} SELECT curve, periods, ~(ann_return)~ AS ann_return, ~(sharpe)~ AS sharpe, ~(mdd)~ AS mdd, ~(calmar)~ AS calmar, ~(win_rate)~ AS win_rate FROM st")
def portfolio_statistics(spark, sf_dir):
    return portfolio.portfolio_stats(_curves(spark, sf_dir))


@_query(
    f"""WITH {PORTFOLIO}, k AS (UNPIVOT st ON ann_return, sharpe, mdd, calmar, win_rate INTO NAME stat VALUE value)
    SELECT stat || '_' || curve AS metric, ~(value)~ AS value FROM k WHERE stat IN ('ann_return', 'sharpe', 'mdd') OR curve IN ('long', 'ls')
    UNION ALL SELECT 'da', ~(avg({_HIT}) * 100)~ FROM ev UNION ALL SELECT 'mw_da', ~(sum(abs(actual_return) * {_HIT}) / sum(abs(actual_return)) * 100)~ FROM ev
    UNION ALL SELECT 'rank_ic', ~(avg(rank_ic))~ FROM ic
    UNION ALL SELECT 'hit_rate', ~(avg(h))~ FROM (SELECT avg(CASE WHEN actual_return > 0 THEN 1.0 ELSE 0.0 END) FILTER (is_long) * 100 AS h FROM ev_s GROUP BY t_date)"""
)
def backtest_summary(spark, sf_dir):
    return portfolio.summary(_eval(spark, sf_dir), P["top_k"], P["min_symbols"])


@_query(
    f"""WITH {PORTFOLIO} SELECT 'da' AS metric, 'all' AS split, ~(da)~ AS value, da >= 52 AS good FROM (SELECT avg({_HIT}) * 100 AS da FROM ev)
    UNION ALL SELECT 'win_rate_long', 'all', ~(win_rate)~, win_rate >= 50 FROM st WHERE curve = 'long'"""
)
def dashboard_flags(spark, sf_dir):
    """Which of the figures that have a bar on the dashboard reach it."""
    return quality.status_flags(backtest_summary(spark, sf_dir).withColumn("split", F.lit("all"))).select("metric", "split", "value", "good")


def _summary_sql(first: str | None, last: str | None) -> str:
    return of_dates(
        f"""WITH {PORTFOLIO}, k AS (UNPIVOT st ON ann_return, sharpe, mdd, calmar, win_rate INTO NAME stat VALUE value)
    SELECT stat || '_' || curve AS metric, value FROM k WHERE stat IN ('ann_return', 'sharpe', 'mdd') OR curve IN ('long', 'ls')
    UNION ALL SELECT 'da', avg({_HIT}) * 100 FROM ev UNION ALL SELECT 'mw_da', sum(abs(actual_return) * {_HIT}) / sum(abs(actual_return)) * 100 FROM ev
    UNION ALL SELECT 'rank_ic', avg(rank_ic) FROM ic
    UNION ALL SELECT 'hit_rate', avg(h) FROM (SELECT avg(CASE WHEN actual_return > 0 THEN 1.0 ELSE 0.0 END) FILTER (is_long) * 100 AS h FROM ev_s GROUP BY t_date)""",
        first,
        last,
    )


@_query(f"SELECT metric, ~(v.value)~ AS validation, ~(t.value)~ AS test FROM ({_summary_sql(TRAIN_END, VAL_END)}) v JOIN ({_summary_sql(VAL_END, None)}) t USING (metric)")
def backtest_by_split(spark, sf_dir):
    """The figures of the validation and the test dates side by side."""
    rows = _eval(spark, sf_dir).withColumn("run", slices.split_by_date(F.col("t_date"), TRAIN_END, VAL_END)).where("run <> 'train'")
    found = portfolio.summary(rows, P["top_k"], P["min_symbols"])
    of = {n: F.max(F.when(F.col("run") == s, F.col("value"))) for n, s in (("validation", "val"), ("test", "test"))}
    return found.groupBy("metric").agg(*(v.alias(n) for n, v in of.items()))


@_query(f'WITH {PATHS} SELECT symbol, sample_id::INT AS sample_id, step::INT AS step, ~("close")~ AS "close" FROM paths')
def resampled_paths(spark, sf_dir):
    return _paths(spark, sf_dir).select("symbol", "sample_id", "step", "close")


@_query(
    f"""WITH {PATHS} SELECT symbol, sample_id::INT AS sample_id, step::INT AS step, ~("close")~ AS "close" FROM paths UNION ALL SELECT symbol, -1, step::INT, ~(avg("close"))~ FROM paths GROUP BY symbol, step
    UNION ALL SELECT symbol, sample_id::INT, 0, ~(last_close)~ FROM paths WHERE step = 1 UNION ALL SELECT DISTINCT symbol, -1, 0, ~(last_close)~ FROM paths"""
)
def path_fan(spark, sf_dir):
    return score.fan(_paths(spark, sf_dir))


@_query(f"WITH {RISK} SELECT symbol, asof_ts, ~(last_close)~ AS last_close, ~(pred_close)~ AS pred_close, ~(volatility)~ AS volatility, ~(p5)~ AS p5, ~(p95)~ AS p95, ~(width)~ AS width, ~(expected_return)~ AS expected_return, trend FROM rsk")
def risk_metrics(spark, sf_dir):
    return risk.risk_metrics(_paths(spark, sf_dir))


@_query(f"WITH {RISK} SELECT symbol, name, sector, exchange, trend, risk_score, confidence, place::INT AS place, ~(volatility_pct)~ AS volatility_pct, ~(change_pct)~ AS change_pct, ~(expected_return)~ AS expected_return FROM rkg")
def rankings(spark, sf_dir):
    return _ranked(spark, sf_dir).select("symbol", "name", "sector", "exchange", "trend", "risk_score", "confidence", "place", "volatility_pct", "change_pct", "expected_return")


@_query(f"WITH {RISK} SELECT symbol, place::INT AS place FROM rkg WHERE sector = 'sector 1' AND trend <> 'DOWN' UNION ALL SELECT symbol, place::INT FROM rkg WHERE confidence >= 1 AND risk_score <= 99")
def screened(spark, sf_dir):
    """By sector, of what is not going down, and by confidence and risk."""
    ranked = _ranked(spark, sf_dir)
    by_sector = risk.screen(ranked.where("trend <> 'DOWN'"), sector="sector 1")
    return by_sector.unionByName(risk.screen(ranked, min_confidence=1, max_risk=99)).select("symbol", "place")


@_query(
    f"""WITH {RISK}, u AS (SELECT symbol, -back AS pos, "close" FROM tail WHERE back <= 3 UNION ALL SELECT symbol, step, avg("close") FROM paths GROUP BY symbol, step)
    SELECT symbol, place::INT AS place, pos::INT AS pos, ~("close")~ AS "close", CASE WHEN confidence >= 4 THEN 'high' WHEN confidence = 3 THEN 'medium' ELSE 'low' END AS confidence_level FROM u JOIN rkg USING (symbol)"""
)
def ranking_sparklines(spark, sf_dir):
    """The ranking table with its candles, a row for each."""
    paths = _paths(spark, sf_dir)
    ranked = risk.rankings(risk.risk_metrics(paths), adapter.bars(spark, sf_dir), adapter.dimension(spark, sf_dir), score.mean_path(paths))
    return ranked.select("symbol", "place", "confidence_text", F.explode("sparkline_candles").alias("c")).select(
        "symbol", "place", F.col("c.at").alias("pos"), F.col("c.close").alias("close"), F.col("confidence_text").alias("confidence_level")
    )


@_query(f"WITH {RISK} SELECT symbol, risk_score FROM rkg WHERE risk_score >= 70 AND symbol IN (SELECT symbol FROM dim WHERE exchange = 'HOSE')")
def watchlist_alerts(spark, sf_dir):
    watch = adapter.dimension(spark, sf_dir).where("exchange = 'HOSE'").select("symbol")
    return risk.risk_alerts(risk.watched(_ranked(spark, sf_dir), watch)).select("symbol", "risk_score")


@_query(f"WITH {BARS} SELECT sector, count(*) AS n FROM dim GROUP BY ROLLUP (sector)")
def sector_counts(spark, sf_dir):
    return risk.sector_counts(adapter.dimension(spark, sf_dir))


@_query(
    f"""WITH {RISK}, t AS (SELECT unnest(['UP', 'DOWN', 'SIDEWAY']) AS trend), c AS (SELECT trend, count(*) AS n, avg(expected_return) AS m FROM rkg GROUP BY trend)
    SELECT trend, coalesce(n, 0) AS n, ~(coalesce(n, 0) * 100.0 / (SELECT sum(n) FROM c))~ AS share_pct, ~(coalesce(m, 0) * 100)~ AS mean_return_pct FROM t LEFT JOIN c USING (trend)"""
)
def trend_overview(spark, sf_dir):
    return risk.trend_overview(_ranked(spark, sf_dir))


@_query(f"WITH {RISK} SELECT CASE WHEN risk_score >= 60 THEN 'high' WHEN risk_score >= 40 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM rkg GROUP BY 1")
def risk_bands(spark, sf_dir):
    return risk.risk_bands(_ranked(spark, sf_dir))


@_query(
    f"""WITH {RISK}, w AS (SELECT * FROM rkg WHERE symbol LIKE '%1' OR symbol LIKE '%4'), t AS (SELECT unnest(['UP', 'DOWN', 'SIDEWAY']) AS trend), c AS (SELECT trend, count(*) AS n, avg(expected_return) AS m FROM w GROUP BY trend)
    SELECT trend, coalesce(n, 0) AS n, ~(coalesce(n, 0) * 100.0 / (SELECT sum(n) FROM c))~ AS share_pct, ~(coalesce(m, 0) * 100)~ AS mean_return_pct FROM t LEFT JOIN c USING (trend)"""
)
def watchlist_trends(spark, sf_dir):
    """Shares of the trends on a watchlist of ten brands."""
    ranked = _ranked(spark, sf_dir)
    watched = adapter.dimension(spark, sf_dir).where("symbol like '%1' or symbol like '%4'").select("symbol")
    return risk.trend_overview(ranked.join(watched, "symbol", "left_semi"))


@_query(
    f"""WITH {BARS}, l AS (SELECT symbol, max(ts) AS ts, arg_max("close", ts) AS "close" FROM bars GROUP BY symbol)
    SELECT (row_number() OVER (ORDER BY symbol))::INT AS place, symbol, strftime(ts, '%d/%m') AS day_month, strftime(ts, '%d-%m-%Y') AS file_date, strftime(ts, '%Y%m%d') AS tag FROM l"""
)
def symbols_in_order(spark, sf_dir):
    """Symbols by name with their last day in the forms that screens and files use."""
    last = adapter.bars(spark, sf_dir).groupBy("symbol").agg(F.max("ts").alias("ts"))
    place = F.row_number().over(Window.orderBy("symbol"))  # one row a symbol
    forms = {"day_month": scalars.day_month, "file_date": scalars.file_date, "tag": scalars.date_tag}
    return last.select(place.alias("place"), "symbol", *(f(F.col("ts")).alias(n) for n, f in forms.items()))


@_query(f"WITH {BARS} SELECT symbol, count(r) AS n, ~(kurtosis_pop(r))~ AS kurt, ~(avg(abs(r)))~ AS mean_abs FROM ret WHERE r IS NOT NULL GROUP BY symbol HAVING count(r) >= 10")
def return_kurtosis(spark, sf_dir):
    """Excess kurtosis of log returns and their mean size."""
    found = profile.log_returns(adapter.bars(spark, sf_dir)).where("r is not null").groupBy("symbol")
    return found.agg(F.count("r").alias("n"), F.kurtosis("r").alias("kurt"), F.avg(F.abs("r")).alias("mean_abs")).where("n >= 10")


@_query(
    f"""WITH {FORECAST}, m AS (SELECT avg({_HIT}) * 100 AS da, sum(abs(actual_return) * {_HIT}) / sum(abs(actual_return)) * 100 AS mw FROM ev)
    SELECT 'DA' AS metric, 'all' AS split, ~(da)~ AS value FROM m UNION ALL SELECT 'MW-DA', 'all', ~(mw)~ FROM m"""
)
def contract_metrics(spark, sf_dir):
    """Accuracy under the names that a frozen record's readers expect."""
    return quality.contract_metrics(_accuracy(spark, sf_dir, "pred_drift"))


@_query(
    f"""WITH {RISK}, s AS (SELECT *, least(100, greatest(0, round(width / pred_close * 100 * 4 + abs(expected_return) * 100 * 4)))::INT AS score, greatest(least(0.33 + 2.5 * expected_return, 0.85), 0.05) AS up, greatest(least(0.33 - 2 * expected_return, 0.85), 0.05) AS down FROM rsk)
    SELECT symbol, score, CASE WHEN score < 20 THEN 'very low' WHEN score < 40 THEN 'low' WHEN score < 60 THEN 'medium' WHEN score < 80 THEN 'high' ELSE 'very high' END AS label, ~(up)~ AS up, ~(down)~ AS down, ~(1 - up - down)~ AS side, ~(2 * pred_close - p5)~ AS display_upper FROM s"""
)
def detail_view(spark, sf_dir):
    rows = risk.risk_metrics(_paths(spark, sf_dir))
    points = risk.detail_score(F.col("width") / F.col("pred_close") * 100, F.col("expected_return") * 100)
    up, down, side = risk.direction_odds(F.col("expected_return"))
    upper = risk.display_upper(F.col("pred_close"), F.col("p5"))
    return rows.select("symbol", points.alias("score"), risk.detail_label(points).alias("label"), up.alias("up"), down.alias("down"), side.alias("side"), upper.alias("display_upper"))


@_query(
    f"""WITH {BARS}, p AS (SELECT *, coalesce(lag("close") OVER w, "close") AS prev, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))
    SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_rows, ~(arg_max("close", ts))~ AS last_close, ~(arg_max(prev, ts))~ AS prev_close, ~(sum("close") FILTER (k <= 8))~ AS tail_sum FROM p GROUP BY symbol"""
)
def history_cards(spark, sf_dir):
    cards = risk.history_card(adapter.bars(spark, sf_dir))
    total = F.aggregate("closes", F.lit(0.0), lambda a, x: a + x)
    return cards.select("symbol", "first_ts", "last_ts", "n_rows", "last_close", "prev_close", total.alias("tail_sum"))


def _runs(spark, sf_dir):
    """A run for each quarter: the mean absolute return as its loss, for each exchange as a model."""
    rows = profile.log_returns(adapter.bars(spark, sf_dir)).join(adapter.dimension(spark, sf_dir).select("symbol", "exchange"), "symbol")
    run = F.year("ts") * 4 + F.quarter("ts")
    return rows.groupBy(F.col("exchange").alias("model"), run.alias("run")).agg(
        F.round(F.avg(F.abs("r")), 9).alias("loss"), (F.countDistinct("symbol") * 2.0).alias("s2_util"), F.round(F.stddev_pop("r"), 9).alias("kl")
    )


_RUNS = f"""WITH {BARS}, runs AS (SELECT exchange AS model, (year(ts) * 4 + quarter(ts))::INT AS run, round(avg(abs(r)), 9) AS loss, count(DISTINCT symbol) * 2.0 AS s2_util, round(stddev_pop(r), 9) AS kl FROM ret JOIN dim USING (symbol) GROUP BY 1, 2),
    p AS (SELECT *, min(loss) OVER (w ROWS UNBOUNDED PRECEDING) AS best, min(loss) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM runs WINDOW w AS (PARTITION BY model ORDER BY run)),
    i AS (SELECT *, prior IS NULL OR loss < prior AS improved, sum((prior IS NULL OR loss < prior)::INT) OVER (PARTITION BY model ORDER BY run ROWS UNBOUNDED PRECEDING) AS island FROM p),
    h AS (SELECT *, row_number() OVER (PARTITION BY model, island ORDER BY run) - 1 AS stale FROM i)"""


@_query(
    f"""{_RUNS} SELECT model, run, ~(loss)~ AS loss, ~(best)~ AS best, stale::INT AS stale,
    concat_ws(', ', CASE WHEN loss > best * 1.05 THEN 'loss above best' END, CASE WHEN s2_util < 25 THEN 'low utilisation' END, CASE WHEN kl > 0.5 THEN 'drift' END, CASE WHEN stale >= 3 THEN 'no improvement' END) AS reasons FROM h"""
)
def run_health(spark, sf_dir):
    return monitor.health(_runs(spark, sf_dir)).select("model", "run", "loss", "best", "stale", F.array_join("reasons", ", ").alias("reasons"))


@_query(f"{_RUNS}, s AS (SELECT *, min(run) FILTER (stale >= 3) OVER (PARTITION BY model) AS stop FROM h) SELECT model, arg_min(run, row(loss, run)) AS run, ~(min(loss))~ AS value FROM s WHERE stop IS NULL OR run <= stop GROUP BY model")
def best_runs(spark, sf_dir):
    return monitor.best_run(_runs(spark, sf_dir), patience=3)


@_query(
    f"""WITH {CODES}, l AS (SELECT CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END AS model, (vec_id // 100)::BIGINT AS run, s1, s2 FROM codes),
    u AS (SELECT model, run, 's1' AS code, s1 AS token FROM l UNION ALL SELECT model, run, 's2', s2 FROM l),
    g AS (SELECT d.model, d.run, d.code, t.token, count(u.token) AS n FROM (SELECT DISTINCT model, run, code FROM u) d CROSS JOIN (SELECT unnest(range(1024)) AS token) t
      LEFT JOIN u ON u.model = d.model AND u.run = d.run AND u.code = d.code AND u.token = t.token GROUP BY ALL),
    q AS (SELECT *, (n + 1e-10) / (sum(n) OVER (PARTITION BY model, run, code) + 1024e-10) + 1e-10 AS p, min(run) OVER (PARTITION BY model) AS first FROM g),
    k AS (SELECT b.model, b.run, b.code, sum(b.p * ln(b.p / a.p)) / (1 + 1024e-10) AS kl, count(*) FILTER (b.n > 0) * 100.0 / 1024 AS used
      FROM q b JOIN q a ON a.model = b.model AND a.code = b.code AND a.token = b.token AND a.run = b.first GROUP BY ALL),
    r AS (SELECT l.model, l.run, any_value(loss) AS loss, avg(kl) AS kl, max(used) FILTER (code = 's2') AS s2_util, l.run > min(l.run) OVER (PARTITION BY l.model) AS later
      FROM (SELECT model, run, round(avg(abs(s1 - 512)), 9) AS loss FROM l GROUP BY ALL) l JOIN k USING (model, run) GROUP BY l.model, l.run),
    o AS (SELECT *, min(loss) FILTER (later) OVER (w ROWS UNBOUNDED PRECEDING) AS best, min(loss) FILTER (later) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM r WINDOW w AS (PARTITION BY model ORDER BY run)),
    i AS (SELECT *, sum((prior IS NULL OR loss < prior)::INT) OVER (PARTITION BY model ORDER BY run ROWS UNBOUNDED PRECEDING) AS island FROM o),
    h AS (SELECT *, row_number() OVER (PARTITION BY model, island ORDER BY run) - 1 AS stale FROM i)
    SELECT model, run, ~(loss)~ AS loss, ~(kl)~ AS kl, ~(s2_util)~ AS s2_util, ~(best)~ AS best, stale::INT AS stale, concat_ws(', ', CASE WHEN later AND loss > best * 1.05 THEN 'loss above best' END,
      CASE WHEN later AND s2_util < 6 THEN 'low utilisation' END, CASE WHEN later AND kl > 0.5 THEN 'drift' END, CASE WHEN later AND stale >= 2 THEN 'no improvement' END) AS reasons FROM h"""
)
def codec_health(spark, sf_dir):
    """Health of code usage, a run for each hundred vectors: divergence from the first run, utilisation, losses and patience."""
    rows = adapter.codes(spark, sf_dir).select(
        F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("model"), F.floor(F.col("vec_id") / 100).alias("run"), "s1", "s2"
    )
    losses = rows.groupBy("model", "run").agg(F.round(F.avg(F.abs(F.col("s1") - 512)), 9).alias("loss"))
    counts = rows.unpivot(["model", "run"], ["s1", "s2"], "code", "token").groupBy("model", "run", "code", "token").agg(F.count("*").alias("n"))
    found = monitor.codec_health(losses, counts, min_util=6.0, patience=2)
    return found.select("model", "run", "loss", "kl", "s2_util", "best", "stale", F.array_join("reasons", ", ").alias("reasons"))


@_query(f"{_RUNS} SELECT model, ~(sum(loss * s2_util) / sum(s2_util))~ AS loss FROM runs GROUP BY model")
def weighted_losses(spark, sf_dir):
    return quality.weighted_loss(_runs(spark, sf_dir).withColumnRenamed("s2_util", "n"), "model")


@_query(
    f"""WITH {PATHS}, a AS (SELECT symbol, asof_ts, sign(avg("close") - last_close) AS m, sum(CASE WHEN "close" > last_close THEN 1 ELSE -1 END) AS v, avg(CASE WHEN "close" > last_close THEN 1.0 ELSE 0.0 END) AS up, any_value(last_close) AS last_close FROM paths WHERE step = 5 GROUP BY symbol, asof_ts, last_close),
    t AS (SELECT a.*, CASE WHEN b."close" > a.last_close THEN 1 ELSE -1 END AS truth FROM a JOIN (SELECT symbol, first("close" ORDER BY ts) AS "close" FROM bars GROUP BY symbol) b USING (symbol))
    SELECT count(*) AS n, ~(avg(CASE WHEN (m > 0) = (truth > 0) THEN 1.0 ELSE 0.0 END) * 100)~ AS mean_path, ~(avg(CASE WHEN (v > 0) = (truth > 0) THEN 1.0 ELSE 0.0 END) * 100)~ AS majority,
           ~(avg(CASE WHEN truth > 0 THEN up ELSE 1 - up END) * 100)~ AS single_path FROM t"""
)
def vote_accuracy(spark, sf_dir):
    """Held against each symbol's first close, as an outcome that is there."""
    paths = _paths(spark, sf_dir)
    first = adapter.bars(spark, sf_dir).groupBy("symbol").agg(F.min_by("close", "ts").alias("actual_close"))
    actual = paths.select("symbol", "asof_ts").distinct().join(first, "symbol")
    return quality.vote_accuracy(paths, actual)


@_query(
    f"""WITH {BARS}, l AS (SELECT symbol, arg_max("close", ts) AS "close", least(count(*), 126) AS n FROM bars GROUP BY symbol), p AS (SELECT unnest(range(2)) AS sample_id), k AS (SELECT unnest(range(1, 6)) AS step)
    SELECT symbol, sample_id::INT AS sample_id, step::INT AS step, ~("close")~ AS "close", 'ok' AS status FROM l, p, k WHERE n >= 20 UNION ALL SELECT symbol, NULL, NULL, NULL, 'skipped' FROM l WHERE n < 20"""
)
def scored_last_values(spark, sf_dir):
    """The pluggable forecaster over all symbols, in batches of series of one length."""
    rows = slices.last_bars(adapter.bars(spark, sf_dir), P["lookback"])
    asof = rows.groupBy("symbol").agg(F.max("ts").alias("asof_ts"))
    found = batch_score.score_batches(rows.join(asof, "symbol"), batch_score.last_values, 5, 2, least=20)
    return found.select("symbol", "sample_id", "step", "close", "status")


def _last_value_paths(spark, sf_dir):
    """Paths of all prices: each step repeats a symbol's last bar."""
    rows = slices.last_bars(adapter.bars(spark, sf_dir), P["lookback"])
    asof = rows.groupBy("symbol").agg(F.max("ts").alias("asof_ts"))
    return batch_score.score_batches(rows.join(asof, "symbol"), batch_score.last_values, 5, 2)


_LAST = f'WITH {BARS}, l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM bars), k AS (SELECT unnest(range(1, 6)) AS step)'


@_query(f'{_LAST} SELECT symbol, step::INT AS step, ~(open)~ AS open, ~(high)~ AS high, ~(low)~ AS low, ~("close")~ AS "close" FROM l, k WHERE back = 1', None)
def mean_price_paths(spark, sf_dir):
    """The mean path of every price."""
    return score.mean_path(_last_value_paths(spark, sf_dir), PRICES).select("symbol", "step", *PRICES)


@_query(
    f"""{_LAST}, u AS (SELECT symbol, -back AS pos, open, high, low, "close", false AS fcst FROM l WHERE back <= 3 UNION ALL SELECT symbol, step, open, high, low, "close", true FROM l, k WHERE back = 1),
    s AS (SELECT *, min(low) OVER w AS lo, coalesce(nullif(max(high) OVER w - min(low) OVER w, 0), 1) AS span FROM u WINDOW w AS (PARTITION BY symbol))
    SELECT symbol, pos::INT AS pos, ~((open - lo) / span)~ AS open, ~((high - lo) / span)~ AS high, ~((low - lo) / span)~ AS low, ~(("close" - lo) / span)~ AS "close", fcst FROM s"""
)
def candle_sparklines(spark, sf_dir):
    mean = score.mean_path(_last_value_paths(spark, sf_dir), PRICES)
    return risk.candle_sparkline(adapter.bars(spark, sf_dir), mean).withColumnRenamed("at", "pos")


@_query(
    f"""WITH {PATHS}, u AS (SELECT symbol, -back AS pos, "close", false AS fcst FROM tail WHERE back <= 126 UNION ALL SELECT symbol, step, avg("close"), true FROM paths GROUP BY symbol, step)
    SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY pos)::INT - 1 AS pos, ~("close")~ AS "close", fcst FROM u"""
)
def record_candles(spark, sf_dir):
    """The candles of whole prediction records, read back from their JSON."""
    paths, rows = _paths(spark, sf_dir), adapter.bars(spark, sf_dir)
    none = rows.where("false").select("symbol", F.lit(0).alias("token"), F.lit(0).cast("long").alias("n"))
    records = risk.whole_records(risk.risk_metrics(paths), paths, rows, none, adapter.dimension(spark, sf_dir))
    back = F.from_json("record", "raw_candles array<struct<close: double, fcst: boolean>>")
    return records.select("symbol", F.posexplode(back["raw_candles"]).alias("pos", "c")).select("symbol", "pos", "c.close", "c.fcst")


@_query()
def source_hashes(spark, sf_dir):
    """Files are not tables, so there is no SQL; tested against hashlib."""
    return sources.hash_artifacts(spark, sf_dir)


@_query(f'WITH {PATHS} SELECT symbol, asof_ts, step::INT AS step, ~(avg("close"))~ AS "close" FROM paths GROUP BY symbol, asof_ts, step')
def mean_paths(spark, sf_dir):
    return score.mean_path(_paths(spark, sf_dir))


@_query(
    f"""WITH {PATHS}, m AS (SELECT symbol, step, last_close, avg("close") AS c FROM paths GROUP BY ALL), g AS (SELECT *, coalesce(lag(c) OVER (PARTITION BY symbol ORDER BY step), last_close) AS prev FROM m)
    SELECT symbol, step::INT AS step, ~(c - prev)~ AS change, ~((c - prev) / prev * 100)~ AS change_pct FROM g"""
)
def forecast_step_changes(spark, sf_dir):
    mean = _paths(spark, sf_dir).groupBy("symbol", "step", "last_close").agg(F.avg("close").alias("close"))
    return score.step_changes(mean).select("symbol", "step", "change", "change_pct")


@_query(
    f"""WITH {PATHS}, u AS (SELECT symbol, -back AS pos, "close", false AS fcst FROM tail WHERE back <= 3 UNION ALL SELECT symbol, step, avg("close"), true FROM paths GROUP BY symbol, step),
    s AS (SELECT *, min("close") OVER w AS lo, max("close") OVER w AS hi FROM u WINDOW w AS (PARTITION BY symbol))
    SELECT symbol, pos::INT AS pos, ~("close")~ AS "close", ~(("close" - lo) / coalesce(nullif(hi - lo, 0), 1))~ AS scaled, fcst FROM s"""
)
def sparklines(spark, sf_dir):
    mean = score.mean_path(_paths(spark, sf_dir))
    rows = risk.sparkline(adapter.bars(spark, sf_dir), mean).select("symbol", F.explode("candles").alias("c"))
    return rows.select("symbol", F.col("c.at").alias("pos"), F.col("c.close").alias("close"), F.col("c.scaled").alias("scaled"), F.col("c.fcst").alias("fcst"))


@_query(f"WITH {RISK} SELECT symbol, trend, 5::BIGINT AS steps, 100::BIGINT AS points, ~(expected_return)~ AS expected_return FROM rsk")
def prediction_records(spark, sf_dir):
    """JSON records, read back."""
    paths = _paths(spark, sf_dir)
    rows = risk.prediction_records(risk.risk_metrics(paths), paths)
    schema = "trend string, risk_metrics struct<expected_return: double>, mean_path array<struct<step: int>>, paths array<struct<step: int>>"
    back = rows.select("symbol", F.from_json("record", schema).alias("r"))
    return back.select(
        "symbol", "r.trend", F.size("r.mean_path").cast("long").alias("steps"), F.size("r.paths").cast("long").alias("points"), F.col("r.risk_metrics.expected_return").alias("expected_return")
    )


@_query(
    f"""WITH {BARS} SELECT symbol, count(*) FILTER (n < 133 AND k <= 126 OR n >= 133 AND k > 7 AND k <= 133)::BIGINT AS history_rows, (CASE WHEN any_value(n) < 133 THEN 0 ELSE 5 END)::BIGINT AS future_rows,
    any_value(n) >= 133 AS fits FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM num) GROUP BY symbol"""
)
def batch_shapes(spark, sf_dir):
    rows = slices.context_slice(adapter.bars(spark, sf_dir), 126, 5)
    return slices.check_batch(rows.where("part = 'context'"), rows.where("part = 'actual'"), 126, 5).select("symbol", "history_rows", "future_rows", "fits")


@_query(f"WITH {BARS} SELECT symbol, count(*) AS n_bars, CASE WHEN count(*) < 1500 THEN 'short' ELSE 'ok' END AS status FROM bars GROUP BY symbol")
def eligible_symbols(spark, sf_dir):
    return score.eligible(adapter.bars(spark, sf_dir), adapter.dimension(spark, sf_dir).select("symbol"), 1500)


@_query(f"WITH {BARS} SELECT symbol, count(*) AS n FROM bars WHERE symbol = 'Brand#1' GROUP BY symbol")
def symbol_lookup(spark, sf_dir):
    rows = adapter.bars(spark, sf_dir).withColumn("symbol", F.upper("symbol"))
    found = slices.find_symbol(rows, " brand#1 ").groupBy("symbol").agg(F.count("*").alias("n"))
    return found.select(F.initcap("symbol").alias("symbol"), "n")


@_query(f"WITH {RISK} SELECT symbol, place::INT AS place FROM rkg ORDER BY place LIMIT 10 OFFSET 5")
def ranking_page(spark, sf_dir):
    return slices.page(_ranked(spark, sf_dir).select("symbol", "place"), ["place"], 5, 10)


@_query(
    f"""WITH {BARS}, j AS (SELECT f.symbol, f.ts AS asof_ts, (power(f.open - r.open, 2) + power(f.high - r.high, 2) + power(f.low - r.low, 2) + power(f."close" - r."close", 2)) / 4 AS square
      FROM num f, (SELECT unnest(range(1, 4)) AS step) k, num r WHERE r.symbol = f.symbol AND r.rn = f.rn + k.step),
    m AS (SELECT symbol, asof_ts, avg(square) AS mse FROM j GROUP BY ALL) SELECT ~(avg(mse) / 1000)~ AS mse_thousands, count(*) AS series FROM m""",
    4,
)
def last_value_path_error(spark, sf_dir):
    """Mean squared error of the last prices over three steps, from every bar on."""
    rows = adapter.bars(spark, sf_dir)
    forecast = rows.select("symbol", F.col("ts").alias("asof_ts"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("step"), *PRICES)
    found = quality.path_mse(score.realised(forecast, rows, 3, PRICES), columns=PRICES)
    return found.select((F.col("mse") / 1000).alias("mse_thousands"), "series")


@_query(
    f"""WITH {FORECAST}, g AS (SELECT abs(a.pred_close_t5 - floor(a.pred_close_t5 * 10) / 10) / nullif(abs(floor(a.pred_close_t5 * 10) / 10), 0) AS d FROM ev a)
    SELECT count(*) AS n, max(d) <= 1e-5 AS within, ~(max(d) * 1e6)~ AS worst_millionths FROM g""",
    4,
)
def golden_difference(spark, sf_dir):
    """Forecasts against themselves as they would be kept, with one digit."""
    rows = _eval(spark, sf_dir).select("symbol", "t_date", "pred_close_t5")
    golden = rows.withColumn("pred_close_t5", F.floor(F.col("pred_close_t5") * 10) / 10)
    found = quality.golden_difference(rows, golden, ["symbol", "t_date"], ("pred_close_t5",))
    return found.select("n", "within", (F.col("worst") * 1e6).alias("worst_millionths"))


_FEATURE_PAIRS = " UNION ALL ".join(
    f"""SELECT '{m}' AS model, '{c}' AS feature, "{c}" AS x, {expression} AS y FROM (SELECT "{c}", lag("{c}") OVER w AS p1, lag("{c}", 5) OVER w AS p5, avg("{c}") OVER (w ROWS BETWEEN 126 PRECEDING AND 1 PRECEDING) AS m, count(*) OVER (w ROWS BETWEEN 126 PRECEDING AND 1 PRECEDING) AS k FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)) WHERE k = 126"""
    for c in FEATURES
    for m, expression in (("five_back", "p5"), ("last", "p1"), ("mean", "m"))
)


@_query(
    f"""WITH {BARS}, p AS ({_FEATURE_PAIRS}), e AS (SELECT model, feature, avg(abs(x - y) / greatest(abs(x), 1e-5) * 100) AS mape, quantile_cont(abs(x - y) / greatest(abs(x), 1e-5) * 100, 0.5) AS mdape FROM p GROUP BY model, feature),
    w AS (SELECT feature, max(mape) FILTER (model = 'five_back') AS a, max(mape) FILTER (model = 'last') AS b, max(mape) FILTER (model = 'mean') AS c, max(mdape) FILTER (model = 'mean') AS d FROM e GROUP BY feature)
    SELECT feature, c < b AS beats_second, b < a AS second_beats_first, CASE WHEN feature IN ('volume', 'amount') THEN d < 30 ELSE c < 2 END AS within_limit FROM w"""
)
def reconstruction_criteria(spark, sf_dir):
    """Each feature of a bar from the one five back, the last and the mean of 126: the criteria for tokenizers on simple models."""
    back = clean.by_symbol().rowsBetween(-126, -1)
    rows = adapter.bars(spark, sf_dir).withColumn("k", F.count("*").over(back))
    guesses = {"five_back": lambda c: F.lag(c, 5).over(clean.by_symbol()), "last": lambda c: F.lag(c).over(clean.by_symbol()), "mean": lambda c: F.avg(c).over(back)}
    pairs = F.array(*(F.struct(F.lit(m).alias("model"), F.lit(c).alias("feature"), F.col(c).alias("x"), g(c).alias("y")) for c in FEATURES for m, g in guesses.items()))
    long = rows.select("k", pairs.alias("pairs")).where("k = 126").select(F.explode("pairs").alias("p")).select("p.*")
    return tokens.recon_criteria(tokens.recon_error(long), ("five_back", "last", "mean"))


@_query(
    f"""WITH {FORECAST}, m AS (SELECT avg({_HIT}) * 100 AS da, sum(abs(actual_return) * {_HIT}) / sum(abs(actual_return)) * 100 AS mw FROM ev), n AS (SELECT avg({_HIT}) * 100 AS da, sum(abs(actual_return) * {_HIT}) / sum(abs(actual_return)) * 100 AS mw FROM evm)
    SELECT 'da' AS metric, 'all' AS split, ~(m.da)~ AS base, ~(n.da)~ AS candidate, n.da > m.da AS better, m.da >= 52 AS base_passes, n.da >= 52 AS passes FROM m, n UNION ALL SELECT 'mw_da', 'all', ~(m.mw)~, ~(n.mw)~, n.mw > m.mw, NULL, NULL FROM m, n"""
)
def frozen_metric_comparison(spark, sf_dir):
    """The metrics of a frozen record, with a hard stop for each of the two models."""
    return frozen_record(spark, sf_dir).select(F.explode("metrics").alias("m")).select("m.*")


@_query()
def frozen_record(spark, sf_dir):
    """The whole record as its manifest has it: compared metrics, with both hard stops, beside the hashes of the tables."""
    base, candidate = (_accuracy(spark, sf_dir, m) for m in ("pred_drift", "pred_mean"))
    return monitor.freeze(base, candidate, sources.hash_artifacts(spark, f"{sf_dir}/part.parquet"))


@_query(
    f"""WITH {BARS}, a AS (SELECT symbol, max(ts) AS stamp, arg_max("close", ts) AS pred FROM bars WHERE ts < DATE '2001-11-04' GROUP BY symbol), b AS (SELECT symbol, max(ts) AS stamp, arg_max("close", ts) AS pred FROM bars GROUP BY symbol)
    SELECT symbol, 126 AS lookback, ~(CASE WHEN ok THEN a ELSE b END)~ AS pred, ok AS stored FROM (SELECT symbol, coalesce(a.stamp = b.stamp AND split_part(symbol, '#', 2)::INT % 3 <> 0, false) AS ok, a.pred AS a, b.pred AS b FROM b LEFT JOIN a USING (symbol))"""
)
def answered_requests(spark, sf_dir):
    """Last-value predictions from a stored set, made again only for symbols with new bars or another lookback."""
    rows = adapter.bars(spark, sf_dir)

    def last(b):
        return b.groupBy("symbol").agg(F.max("ts").alias("stamp"), F.max_by("close", "ts").alias("pred"))

    old, now = last(rows.where("ts < '2001-11-04'")), last(rows).select("symbol", "stamp")
    lookback = F.when(F.split("symbol", "#")[1].cast("int") % 3 == 0, 60).otherwise(126)
    stored = old.select("symbol", lookback.alias("lookback"), "pred")
    asked = spark.range(1).select(F.lit(126).alias("lookback"))
    return monitor.answered(stored, asked, ["lookback"], old, now, lambda rest: last(rows.join(rest, "symbol", "left_semi")).drop("stamp"))


@_query(
    f"""WITH {BARS}, a AS (SELECT symbol, max(ts) AS stamp FROM bars WHERE ts < DATE '2001-11-01' GROUP BY symbol), b AS (SELECT symbol, max(ts) AS stamp FROM bars GROUP BY symbol)
    SELECT symbol, CASE WHEN a.stamp IS NULL THEN 'new' WHEN b.stamp IS NULL THEN 'gone' ELSE 'changed' END AS change FROM a FULL JOIN b USING (symbol) WHERE a.stamp IS DISTINCT FROM b.stamp"""
)
def stale_symbols(spark, sf_dir):
    """Symbols that have bars after a cut: their predictions have to be made again."""
    rows = adapter.bars(spark, sf_dir)
    seen, now = (x.groupBy("symbol").agg(F.max("ts").alias("stamp")) for x in (rows.where("ts < '2001-11-01'"), rows))
    return monitor.stale_symbols(seen, now)


@_query(
    f"""WITH {BARS}, e AS (SELECT symbol, rn AS start, null_share FROM (SELECT symbol, ts, row_number() OVER w - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n, sum({_NULLS}) OVER (w ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) / (16.0 * 6) AS null_share FROM dense WINDOW w AS (PARTITION BY symbol ORDER BY ts)) WHERE rn + 16 <= n)
    SELECT symbol, count(*) AS n, min(start) AS first_start FROM e WHERE null_share <= 0.10 GROUP BY symbol"""
)
def dense_windows(spark, sf_dir):
    rows = _dense(spark, sf_dir)
    kept = windows.drop_sparse(windows.make_windows(rows, 10, 5))
    return kept.groupBy("symbol").agg(F.count("*").alias("n"), F.min("start").cast("long").alias("first_start"))


_Z = f"""WITH {BARS}, u AS (SELECT s.symbol, s.rn AS start, (b.rn - s.rn)::INT AS pos, b.ts, {_each('b."{c}"')} FROM num s JOIN num b ON b.symbol = s.symbol AND b.rn BETWEEN s.rn AND s.rn + 15 WHERE s.rn + 16 <= s.n),
    m AS (SELECT symbol, start, {_each('avg("{c}") FILTER (pos < 10) AS "{c}_m", stddev_pop("{c}") FILTER (pos < 10) AS "{c}_d"')} FROM u GROUP BY ALL),
    z AS (SELECT symbol, start, pos, ts, {_each('greatest(least(("{c}" - "{c}_m") / (CASE WHEN "{c}_d" < 1e-6 THEN 1 ELSE "{c}_d" END + 1e-5), 5), -5) AS "{c}"')} FROM u JOIN m USING (symbol, start))"""


def _arrays(spark, sf_dir):
    return windows.window_arrays(adapter.bars(spark, sf_dir), None, 10, 5)


@_query(f"{_Z} SELECT symbol, start, count(*) AS n_rows, ~(sum((\"close\"::FLOAT)::DOUBLE * (pos + 1)))~ AS closes, ~(sum((open::FLOAT)::DOUBLE + 2 * (high::FLOAT)::DOUBLE + 3 * (low::FLOAT)::DOUBLE + 4 * (volume::FLOAT)::DOUBLE + 5 * (amount::FLOAT)::DOUBLE))~ AS others, sum(day(ts) * (pos + 1))::DOUBLE AS days FROM z GROUP BY symbol, start", 3)
def exported_windows(spark, sf_dir):
    """Windows as arrays of floats with their stamps; sums over them, weighted by place, as a check of values and order."""
    out = windows.export_windows(_arrays(spark, sf_dir), {"day": F.dayofmonth})
    at = {c: k for k, c in enumerate(FEATURES)}

    def total(of):
        return F.aggregate(F.transform("x", of), F.lit(0.0), lambda a, v: a + v)

    def of(c):
        return lambda x: F.get(x, F.lit(at[c])).cast("double")

    weights = {"open": 1, "high": 2, "low": 3, "volume": 4, "amount": 5}
    others = total(lambda x: sum((of(c)(x) * w for c, w in weights.items()), F.lit(0.0)))
    days = F.aggregate(F.transform("stamp", lambda s, i: F.get(s, F.lit(0)).cast("double") * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return out.select(
        "symbol",
        F.col("start").cast("long").alias("start"),
        F.size("x").cast("long").alias("n_rows"),
        total(lambda x, i: of("close")(x) * (i + 1)).alias("closes"),
        others.alias("others"),
        days.alias("days"),
    )


@_query(
    f"{_Z} SELECT symbol, start, pos, (open > 0)::INT + 2 * (high > 0)::INT + 4 * (low > 0)::INT + 8 * (\"close\" > 0)::INT AS s1, (volume > 0)::INT + 2 * (amount > 0)::INT AS s2 FROM z"
)
def pretokenized_windows(spark, sf_dir):
    """Windows as codes, a row for each of their rows."""
    found = tokens.pretokenize(_arrays(spark, sf_dir))
    rows = found.select("symbol", F.col("start").cast("long").alias("start"), F.posexplode(F.arrays_zip("s1", "s2")).alias("pos", "t"))
    return rows.select("symbol", "start", "pos", "t.s1", "t.s2")


#: The seeded offset for each step up to 200, as the operator draws it.
_OFFSETS = [quality.sample_step(step, 1, 1)[1] for step in range(1, 201)]


@_query(
    f"""WITH {FORECAST}, d AS (SELECT t_date, row_number() OVER (ORDER BY t_date) - 1 AS nth, count(*) OVER () AS m FROM (SELECT DISTINCT t_date FROM ev)),
    s AS (SELECT t_date, nth, greatest(5, m // 20) AS step FROM d), o AS (SELECT *, ({_OFFSETS})[step] AS off FROM s)
    SELECT symbol, t_date FROM ev WHERE t_date IN (SELECT t_date FROM o WHERE nth >= off AND (nth - off) % step = 0 AND (nth - off) // step < 20)"""
)
def sparse_evaluation_dates(spark, sf_dir):
    """About 500 forecasts of 25 symbols on dates a drawn offset and a step apart."""
    rows = _eval(spark, sf_dir)
    step, offset, wanted = quality.sample_step(rows.select("t_date").distinct().count(), 500, 25)
    return quality.every_nth_date(rows, step, offset=offset, most=wanted).select("symbol", "t_date")


@_query("SELECT event_type AS symbol, 0 AS minute, 9 AS hour, (isodow(ts) - 1)::INT AS weekday, day(ts)::INT AS day, month(ts)::INT AS month, count(*) AS n FROM events GROUP BY ALL")
def daily_stamp_features(spark, sf_dir):
    """The training variant of the time features: minute 0 and hour 9, whatever the stamp."""
    rows = adapter.read(spark, sf_dir, "events")
    stamps = scalars.time_features(F.col("ts"), daily=True)
    return rows.groupBy(F.col("event_type").alias("symbol"), *(c.alias(n) for n, c in stamps.items())).agg(F.count("*").alias("n"))


@_query(f"WITH {CODES} SELECT DISTINCT s1 AS token, ~(CASE WHEN s1 & 1 = 1 THEN 1 ELSE -1 END / sqrt(10.0))~ AS first_bit, ~(CASE WHEN s1 & 512 = 512 THEN 1 ELSE -1 END / sqrt(10.0))~ AS last_bit FROM codes")
def codes_to_bits(spark, sf_dir):
    bits = tokens.index_to_bits(F.col("s1"), 10)
    return adapter.codes(spark, sf_dir).select(F.col("s1").alias("token"), F.element_at(bits, 1).alias("first_bit"), F.element_at(bits, 10).alias("last_bit")).distinct()


@_query(_SQL_OF["returns_and_volatility"])
def returns_and_volatility_in_blocks(spark, sf_dir):
    """The same figures with each symbol cut into blocks of 500 bars."""

    def figures(b):
        return profile.rolling_volatility(profile.log_returns(b))

    found = blocks.in_blocks(adapter.bars(spark, sf_dir), figures, back=50, block=500)
    return found.select("symbol", "ts", "r", F.abs("r").alias("abs_r"), "vol_20", "vol_50")


@_query(_SQL_OF["window_splits"])
def window_splits_in_blocks(spark, sf_dir):
    """The same windows made in blocks of 500 bars with a halo."""
    rows = adapter.bars(spark, sf_dir)
    made = blocks.windows_in_blocks(rows, lambda b: windows.make_windows(b, 126, 5), 132, 500)
    found = windows.assign_split(rows, made, TRAIN_END, VAL_END, 126)
    return found.groupBy("symbol", "split").agg(F.count("*").alias("n"), F.min("ts_first").alias("first_ts"), F.max("ts_last").alias("last_ts"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
