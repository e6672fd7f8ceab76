"""Batched scoring, and the refresh stream that feeds it: calls and loads are counted in files, as they happen in workers."""

import os
import uuid
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from wickflow.operators import batch_score, score
from wickflow.operators.batch_score import drawn_returns, last_values, normalized, score_batches
from wickflow.streaming.refresh import candles, merged, refresh_stream

SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, volume double, amount double"


@pytest.fixture(scope="module", autouse=True)
def models_in_workers(spark):
    """Workers import the models of this file."""
    spark.sparkContext.addPyFile(__file__)


def bar(symbol, day, close):
    return symbol, f"2024-01-{day:02d} 00:00:00", close - 1, close + 2, close - 2, close, 10.0, 10 * close


def frame(spark, rows):
    texts = SCHEMA.replace("ts timestamp", "ts string")
    return spark.createDataFrame(rows, texts).withColumn("ts", F.to_timestamp("ts"))


def contexts(spark, lengths):
    rows = frame(spark, [bar(f"S{k:02d}", d + 1, 100.0 + k + d) for k, n in enumerate(lengths) for d in range(n)])
    return rows.join(rows.groupBy("symbol").agg(F.max("ts").alias("asof_ts")), "symbol")


def mark(folder, kind):
    open(os.path.join(folder, f"{kind}-{os.getpid()}-{uuid.uuid4().hex}"), "w").close()


def counted(folder, most):
    """A model of last values that leaves a file for each load and call; no call has more series than `most`, all of one length."""
    mark(folder, "load")
    model = last_values()

    def run(x, at, horizon, samples, seeds):
        mark(folder, "call")
        assert x.ndim == 3 and 0 < len(x) <= most and at.shape == x.shape[:2] and len(seeds) == len(x)
        return model(x, at, horizon, samples, seeds)

    return run


def choosy():
    """Refuses series whose first close is odd."""
    model = last_values()

    def run(x, at, horizon, samples, seeds):
        if (x[:, 0, 3] % 2 == 1).any():
            raise ValueError("odd")
        return model(x, at, horizon, samples, seeds)

    return run


def test_one_load_a_worker_and_full_batches(spark, tmp_path):
    series = batch_score.stacked(contexts(spark, [5] * 23 + [3] * 9)).coalesce(1).cache()
    assert series.count() == 32
    for _ in range(2):  # the second job finds the model
        found = batch_score.score_stacked(series, partial(counted, str(tmp_path), 4), 2, 3, batch=4)
        assert found.count() == 32 * 6
    names = os.listdir(tmp_path)
    loads = [n for n in names if n.startswith("load")]
    workers = {n.split("-")[1] for n in names}
    assert len(loads) == len(workers)
    assert len(names) - len(loads) == 2 * (6 + 3)  # ceil(23 / 4) + ceil(9 / 4) calls a job


def test_equal_to_single_calls_and_skips(spark):
    rows = contexts(spark, [6, 6, 2, 6, 5])
    by_one = score.score(rows, score.last_value, 2, 2, least=4)
    batched = score_batches(rows, last_values, 2, 2, least=4, batch=2)
    assert sorted(map(str, by_one.collect())) == sorted(map(str, batched.collect()))
    assert batched.schema.simpleString() == by_one.schema.simpleString()
    found = {r["symbol"]: (r["status"], r["error"]) for r in score_batches(rows, choosy, 1, 1, batch=8).collect()}
    assert found == {f"S{k:02d}": ("skipped", "odd") if k % 2 else ("ok", None) for k in range(5)}


def test_paths_do_not_depend_on_the_stacking(spark):
    rows = contexts(spark, [6] * 7)
    one, many = (sorted(map(tuple, score_batches(rows.repartition(p), drawn_returns, 3, 4, batch=b).collect())) for p, b in ((1, 7), (3, 2)))
    assert one == many and len(one) == 7 * 12
    assert len({r[7] for r in one}) > 20
    other = score_batches(rows, drawn_returns, 3, 4, seed=1).collect()
    assert sorted(map(tuple, other)) != one


def test_normalized_model():
    x = np.random.default_rng(0).normal(50, 4, (3, 20, 6))
    x[1, 3, 2] = np.nan
    run = normalized(last_values, clip=1.0)
    got = run(x, np.zeros((3, 20)), 2, 1, np.zeros(3))
    mean, std = np.nanmean(x, axis=1)[:, :4], np.nanstd(x, axis=1)[:, :4] + 1e-5
    assert got == pytest.approx(np.broadcast_to(np.clip(x[:, -1, :4], mean - std, mean + std)[:, None, None], got.shape), rel=1e-4)


def test_merged_rows():
    assert merged([1, 3], ["a", "b"], [2, 3, 9], ["c", "d", "e"], 3) == ([2, 3, 9], ["c", "d", "e"])
    assert merged([], [], [5, 4], ["x", "y"], 9) == ([4, 5], ["y", "x"])


def stream(spark, tmp_path, factory=last_values, **options):
    query = refresh_stream(spark, f"{tmp_path}/in/*", SCHEMA, f"{tmp_path}/out", f"{tmp_path}/cp", factory, 3, 2, **options)
    assert query.awaitTermination(180)
    assert query.exception() is None
    return sum(p["numInputRows"] for p in query.recentProgress)


def test_refresh_reads_new_files_only_and_restarts(spark, tmp_path):
    """Three batches, each by a query that starts from the checkpoint of the one before."""
    rows = [
        [bar("A", d, 10.0 + d) for d in (1, 2, 3)] + [bar("B", d, 20.0 + d) for d in (1, 2)] + [bar("D", 3, 5.0)],
        [bar("B", 3, 23.0), bar("A", 4, 14.0), bar("A", 4, 14.0)],
        [bar("C", d, 30.0 + d) for d in (1, 2, 3, 4)] + [bar("B", 2, 99.0), bar("D", 2, 4.0), bar("D", 1, 3.0)],
    ]
    read = []
    for k, batch in enumerate(rows):
        frame(spark, batch).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        read.append(stream(spark, tmp_path, drawn_returns))
    assert read == [len(b) for b in rows]
    assert stream(spark, tmp_path, drawn_returns) == 0
    got = spark.read.parquet(f"{tmp_path}/out").where("status = 'ok'").drop("asof_date")
    # what scoring each symbol's last bars at once gives, for the last date of each
    final = {(s, d): (s, d, c) for s, d, c in (("A", 4, 14.0), ("B", 3, 23.0), ("C", 4, 34.0), ("D", 3, 5.0))}
    bars = frame(spark, [bar("A", d, 10.0 + d) for d in (2, 3, 4)] + [bar("B", 1, 21.0), bar("B", 2, 99.0), bar("B", 3, 23.0)] + [bar("C", d, 30.0 + d) for d in (2, 3, 4)] + [bar("D", d, 2.0 + d) for d in (1, 2, 3)])
    want = score_batches(bars.join(bars.groupBy("symbol").agg(F.max("ts").alias("asof_ts")), "symbol"), drawn_returns, 2, 1, least=3)
    late = got.groupBy("symbol").agg(F.max("asof_ts").alias("asof_ts"))
    assert sorted(map(tuple, got.select(*want.columns).join(late, ["symbol", "asof_ts"], "left_semi").collect())) == sorted(map(tuple, want.collect()))
    assert {r["symbol"] for r in want.collect()} == {k[0] for k in final}
    # a date keeps the symbols that a later batch did not bring
    day = spark.read.parquet(f"{tmp_path}/out").where("asof_date = '2024-01-04' and status = 'ok'")
    assert {r["symbol"] for r in day.collect()} == {"A", "C"}


def test_state_expires(spark, tmp_path):
    """A symbol whose last bar is more than five days behind begins anew."""
    batches = [[bar("A", d, 10.0 + d) for d in (1, 2, 3)], [bar("B", 20, 1.0)], [bar("A", 21, 16.0), bar("B", 19, 2.0), bar("B", 18, 2.0)]]
    for k, rows in enumerate(batches):
        frame(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream(spark, tmp_path, expire="5 days")
    found = {(r["symbol"], r["asof_ts"].day): r["status"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert found == {("A", 3): "ok", ("A", 21): "skipped", ("B", 20): "ok"}


def test_late_events_are_dropped_by_the_watermark(spark, tmp_path):
    """Candles come out once their hour is over for the watermark; a row that is later than that changes none."""
    schema = "event_id long, ts timestamp, event_type string, value double"
    batches = [[(1, "2024-01-01 10:05:00", 5.0), (2, "2024-01-01 10:50:00", 7.0)], [(3, "2024-01-01 14:00:00", 1.0)], [(4, "2024-01-01 10:55:00", 99.0), (5, "2024-01-01 19:00:00", 2.0)], [(6, "2024-01-01 23:59:00", 3.0)]]
    for k, rows in enumerate(batches):
        cells = [(i, t, "a", v) for i, t, v in rows]
        events = spark.createDataFrame(cells, schema.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts"))
        events.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        query = candles(source, "event_type", "value").writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out")
        assert query.awaitTermination(120)
    found = {r["ts"].hour: (r["open"], r["high"], r["close"], r["volume"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert found == {10: (5.0, 7.0, 7.0, 2.0), 14: (1.0, 1.0, 1.0, 1.0), 19: (2.0, 2.0, 2.0, 1.0)}
