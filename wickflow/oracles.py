"""DuckDB's SQL for the candle queries, on views of the test tables. Parameters are those of plans.adapter.LEAST."""

from __future__ import annotations

BARS = """
px AS (
  SELECT p_brand AS symbol, l_shipdate::DATE AS ts, l_extendedprice / l_quantity AS price, l_quantity AS q,
         round(l_extendedprice * 100)::BIGINT AS cents,
         row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS o
  FROM lineitem JOIN part ON l_partkey = p_partkey),
bars AS (
  SELECT symbol, ts, arg_min(price, o) AS open, max(price) AS high, min(price) AS low, arg_max(price, o) AS "close",
         sum(q) AS volume, sum(cents)::DOUBLE / 100 AS amount
  FROM px GROUP BY symbol, ts),
num AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
ret AS (SELECT *, CASE WHEN lag("close") OVER w > 0 AND "close" > 0 THEN ln("close" / lag("close") OVER w) END AS r
        FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
grid AS (SELECT d.ts, s.symbol FROM (SELECT DISTINCT ts FROM bars) d CROSS JOIN (SELECT DISTINCT symbol FROM bars) s),
dense AS (SELECT g.symbol, g.ts, open, high, low, "close", volume, amount
          FROM grid g LEFT JOIN bars b ON g.symbol = b.symbol AND g.ts = b.ts),
dim AS (
  SELECT DISTINCT p_brand AS symbol, 'Brand ' || split_part(p_brand, '#', 2) AS name,
         'sector ' || (split_part(p_brand, '#', 2)::INT % 5) AS sector,
         CASE WHEN split_part(p_brand, '#', 2)::INT % 2 = 0 THEN 'HOSE' ELSE 'HNX' END AS exchange
  FROM part)"""

FORECAST = BARS + """,
base AS (
  SELECT symbol, ts, "close",
         CASE WHEN count("close") OVER b = 126 THEN "close" END AS pred_last,
         CASE WHEN count("close") OVER b = 126 THEN avg("close") OVER b END AS pred_mean,
         CASE WHEN count("close") OVER b = 126 THEN "close" + 5 * ("close" - first("close") OVER b) / 125 END AS pred_drift
  FROM bars WINDOW b AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 125 PRECEDING AND CURRENT ROW)),
led AS (SELECT *, lead(ts, 5) OVER w AS t5_date, lead("close", 5) OVER w AS c5 FROM base WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
ev AS (
  SELECT symbol, ts AS t_date, t5_date, "close" AS actual_close_t, c5 AS actual_close_t5, pred_drift AS pred_close_t5,
         (c5 - "close") / "close" AS actual_return,
         greatest(least((pred_drift - "close") / "close", 0.5), -0.5) AS pred_return
  FROM led WHERE pred_drift IS NOT NULL AND c5 IS NOT NULL),
evm AS (
  SELECT symbol, ts AS t_date, (c5 - "close") / "close" AS actual_return,
         greatest(least((pred_mean - "close") / "close", 0.5), -0.5) AS pred_return
  FROM led WHERE pred_mean IS NOT NULL AND c5 IS NOT NULL)"""


def _dates(source: str, name: str) -> str:
    return f""",
{name}_d AS (SELECT t_date FROM (SELECT t_date, row_number() OVER (ORDER BY t_date) - 1 AS nth FROM (SELECT DISTINCT t_date FROM {source})) WHERE nth % 5 = 0),
{name}_w AS (SELECT * FROM (SELECT e.*, count(*) OVER (PARTITION BY t_date) AS n FROM {source} e WHERE t_date IN (SELECT t_date FROM {name}_d)) WHERE n >= 10),
{name}_s AS (
  SELECT *, row_number() OVER (PARTITION BY t_date ORDER BY pred_return DESC, symbol) <= 3 AS is_long,
         row_number() OVER (PARTITION BY t_date ORDER BY pred_return, symbol DESC) <= 3 AS is_short
  FROM {name}_w)"""


def _rank_ic(name: str, ic: str) -> str:
    return f""",
{ic}_rk AS (
  SELECT *, rank() OVER (PARTITION BY t_date ORDER BY pred_return) + (count(*) OVER (PARTITION BY t_date, pred_return) - 1) / 2.0 AS rp,
         rank() OVER (PARTITION BY t_date ORDER BY actual_return) + (count(*) OVER (PARTITION BY t_date, actual_return) - 1) / 2.0 AS ra
  FROM {name}_w),
{ic} AS (
  SELECT t_date, coalesce(CASE WHEN va > 1e-12 AND vb > 1e-12 THEN cov / (sqrt(va) * sqrt(vb)) END, 0.0) AS rank_ic
  FROM (SELECT t_date, count(*) AS n, sum(rp * ra) - sum(rp) * sum(ra) / count(*) AS cov,
               sum(rp * rp) - sum(rp) * sum(rp) / count(*) AS va, sum(ra * ra) - sum(ra) * sum(ra) / count(*) AS vb
        FROM {ic}_rk GROUP BY t_date) WHERE n >= 3)"""


RANKED = _rank_ic("ev", "ic")

PORTFOLIO = FORECAST + _dates("ev", "ev") + RANKED + """,
day AS (
  SELECT t_date,
         avg(actual_return) FILTER (is_long) AS long_ret, avg(actual_return) FILTER (is_short) AS short_ret, avg(actual_return) AS bench_ret,
         list(symbol ORDER BY symbol) FILTER (is_long) AS long_set, list(symbol ORDER BY symbol) FILTER (is_short) AS short_set,
         coalesce(sum(pred_return * actual_return) FILTER (is_long AND pred_return > 0) / sum(pred_return) FILTER (is_long AND pred_return > 0),
                  avg(actual_return) FILTER (is_long)) AS long_mag_ret,
         coalesce(list(symbol ORDER BY symbol) FILTER (is_long AND pred_return > 0), list(symbol ORDER BY symbol) FILTER (is_long)) AS long_mag_set,
         CASE WHEN count(*) FILTER (is_long AND pred_return > 0) > 0 THEN count(*) FILTER (is_long AND pred_return > 0) ELSE 3 END AS long_mag_div,
         coalesce(sum(-pred_return * actual_return) FILTER (is_short AND pred_return < 0) / sum(-pred_return) FILTER (is_short AND pred_return < 0),
                  avg(actual_return) FILTER (is_short)) AS short_mag_ret,
         coalesce(list(symbol ORDER BY symbol) FILTER (is_short AND pred_return < 0), list(symbol ORDER BY symbol) FILTER (is_short)) AS short_mag_set,
         CASE WHEN count(*) FILTER (is_short AND pred_return < 0) > 0 THEN count(*) FILTER (is_short AND pred_return < 0) ELSE 3 END AS short_mag_div
  FROM ev_s GROUP BY t_date),
tov AS (
  SELECT *,
         coalesce(1.0 - len(list_intersect(long_set, lag(long_set) OVER w)) / 3.0, 1.0) AS long_turnover,
         coalesce(1.0 - len(list_intersect(short_set, lag(short_set) OVER w)) / 3.0, 1.0) AS short_turnover,
         coalesce(1.0 - len(list_intersect(long_mag_set, lag(long_mag_set) OVER w)) / long_mag_div::DOUBLE, 1.0) AS long_mag_turnover,
         coalesce(1.0 - len(list_intersect(short_mag_set, lag(short_mag_set) OVER w)) / short_mag_div::DOUBLE, 1.0) AS short_mag_turnover
  FROM day WINDOW w AS (ORDER BY t_date)),
net AS (
  SELECT *, ln(1 + long_ret) - long_turnover * 0.0015 AS long,
         ln(1 + long_ret) - ln(1 + short_ret) - long_turnover * 0.0015 - short_turnover * 0.0015 AS ls,
         ln(1 + bench_ret) AS bench, ln(1 + long_mag_ret) - long_mag_turnover * 0.0015 AS long_mag,
         ln(1 + long_mag_ret) - ln(1 + short_mag_ret) - long_mag_turnover * 0.0015 - short_mag_turnover * 0.0015 AS ls_mag
  FROM tov),
lng AS (UNPIVOT (SELECT t_date, long, ls, bench, long_mag, ls_mag FROM net) ON long, ls, bench, long_mag, ls_mag INTO NAME curve VALUE net),
cum AS (SELECT *, sum(net) OVER (PARTITION BY curve ORDER BY t_date ROWS UNBOUNDED PRECEDING) AS cum FROM lng),
crv AS (SELECT *, (max(exp(cum)) OVER (PARTITION BY curve ORDER BY t_date ROWS UNBOUNDED PRECEDING) - exp(cum))
                  / max(exp(cum)) OVER (PARTITION BY curve ORDER BY t_date ROWS UNBOUNDED PRECEDING) AS drawdown FROM cum),
st AS (
  SELECT curve, count(net) AS periods, avg(net) * 50.4 * 100 AS ann_return,
         CASE WHEN stddev_pop(net) < 1e-6 THEN 0 ELSE (avg(net) - 0.04 / 50.4) / stddev_pop(net) * sqrt(50.4) END AS sharpe,
         max(drawdown) * 100 AS mdd,
         CASE WHEN max(drawdown) * 100 > 1e-4 THEN avg(net) * 50.4 * 100 / (max(drawdown) * 100) ELSE 0 END AS calmar,
         avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) * 100 AS win_rate
  FROM crv GROUP BY curve)"""

PATHS = BARS + """,
tail AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM bars) WHERE back <= 126),
rat AS (SELECT *, "close" / lag("close") OVER (PARTITION BY symbol ORDER BY ts) AS ratio FROM tail),
lst AS (SELECT symbol, max(ts) AS asof_ts, arg_max("close", ts) AS last_close, count(ratio) AS n FROM rat GROUP BY symbol),
pool AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx, ratio FROM rat WHERE ratio IS NOT NULL),
drw AS (
  SELECT l.*, s.sample_id, k.step,
         floor(('0x' || substr(md5('42:' || symbol || ':' || sample_id || ':' || step), 1, 8))::UBIGINT / 4294967296.0 * n)::INT AS idx
  FROM lst l, (SELECT unnest(range(20)) AS sample_id) s, (SELECT unnest(range(1, 6)) AS step) k WHERE n > 0),
paths AS (
  SELECT symbol, asof_ts, last_close, sample_id, step,
         last_close * exp(sum(ln(ratio)) OVER (PARTITION BY symbol, sample_id ORDER BY step ROWS UNBOUNDED PRECEDING)) AS "close"
  FROM drw JOIN pool USING (symbol, idx))"""

RISK = PATHS + """,
rsk AS (
  SELECT symbol, asof_ts, last_close, avg("close") AS pred_close, stddev_pop("close") / avg("close") AS volatility,
         quantile_cont("close", 0.05) AS p5, quantile_cont("close", 0.95) AS p95,
         quantile_cont("close", 0.95) - quantile_cont("close", 0.05) AS width,
         (avg("close") - last_close) / last_close AS expected_return,
         CASE WHEN (avg("close") - last_close) / last_close > 0.03 THEN 'UP'
              WHEN (avg("close") - last_close) / last_close < -0.03 THEN 'DOWN' ELSE 'SIDEWAY' END AS trend
  FROM paths WHERE step = 5 GROUP BY symbol, asof_ts, last_close),
two AS (SELECT symbol, arg_max("close", ts) AS last_bar, arg_min("close", ts) AS prev_bar FROM tail WHERE back <= 2 GROUP BY symbol),
rkg AS (
  SELECT rsk.*, dim.name, dim.sector, dim.exchange, last_bar, prev_bar,
         least(100, greatest(0, trunc(width / pred_close * 600 + abs(expected_return) * 100)::INT)) AS risk_score,
         CASE WHEN width / pred_close > 0.15 THEN 1 WHEN width / pred_close > 0.10 THEN 2 WHEN width / pred_close > 0.07 THEN 3
              WHEN width / pred_close > 0.05 THEN 4 ELSE 5 END AS confidence,
         volatility * 100 AS volatility_pct, (last_bar - prev_bar) / prev_bar * 100 AS change_pct,
         row_number() OVER (ORDER BY expected_return DESC, symbol) AS place
  FROM rsk JOIN two USING (symbol) LEFT JOIN dim USING (symbol))"""

CODES = """
codes AS (
  SELECT vec_id, label,
         list_sum(list_transform(range(10), lambda i: CASE WHEN embedding[i + 1] > 0 THEN 1 << i ELSE 0 END))::INT AS s1,
         list_sum(list_transform(range(10), lambda i: CASE WHEN embedding[i + 11] > 0 THEN 1 << i ELSE 0 END))::INT AS s2
  FROM embeddings),
logits AS (SELECT vec_id, unnest(range(len(embedding)))::INT AS token, unnest(embedding) AS logit FROM embeddings),
sm AS (SELECT vec_id, token, logit, e / sum(e) OVER (PARTITION BY vec_id) AS p
       FROM (SELECT *, exp(logit::DOUBLE / 0.7 - max(logit::DOUBLE / 0.7) OVER (PARTITION BY vec_id)) AS e FROM logits)),
nuc AS (SELECT vec_id, token, logit, p / sum(p) OVER (PARTITION BY vec_id) AS p
        FROM (SELECT *, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY logit DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sm)
        WHERE before <= 0.9)"""


def of_dates(sql: str, first: str | None, last: str | None) -> str:
    """The same with only the forecasts made from `first` on and before `last`."""
    when = "".join(f" AND ts {sign} DATE '{day}'" for sign, day in ((">=", first), ("<", last)) if day)
    return sql.replace("WHERE pred_drift IS NOT NULL AND c5 IS NOT NULL", "WHERE pred_drift IS NOT NULL AND c5 IS NOT NULL" + when)


#: Two-sided p of Student's t for columns t and n, by the gamma function.
T_P = """1 - CASE WHEN (n - 1) % 2 = 1 THEN 2 / pi() * (atan(abs(t) / sqrt(n - 1)) + sin(atan(abs(t) / sqrt(n - 1))) * coalesce(list_sum(list_transform(range(0, (n - 2) // 2),
    lambda k: exp(lgamma(k + 1.0) + ln(sqrt(pi()) / 2) - lgamma(k + 1.5)) * power(cos(atan(abs(t) / sqrt(n - 1))), 2 * k + 1))), 0))
  ELSE sin(atan(abs(t) / sqrt(n - 1))) * list_sum(list_transform(range(0, (n - 1) // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1.0)) / sqrt(pi()) * power(cos(atan(abs(t) / sqrt(n - 1))), 2 * k))) END"""
