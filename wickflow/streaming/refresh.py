"""Refresh predictions as new bar files arrive, and candles from an event stream."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wickflow.operators.batch_score import BATCH, Factory, score_stacked
from wickflow.schema import FEATURES
from wickflow.sources.sinks import write_predictions

CONTEXT_SCHEMA = "symbol string, at array<long>, x array<array<double>>"
STATE_SCHEMA = "at array<long>, x array<array<double>>"


def merged(at: list[int], x: list, new_at: list[int], new_x: list, lookback: int) -> tuple[list[int], list]:
    """The last `lookback` rows of both in time order; of two rows of one time the newer arrival stays."""
    rows = dict(zip(at, x)) | dict(zip(new_at, new_x))
    kept = sorted(rows)[-lookback:]
    return kept, [rows[t] for t in kept]


def context_stream(bars: DataFrame, lookback: int, features: tuple[str, ...] = FEATURES, expire: str | None = None) -> DataFrame:
    """A stream of (symbol, at, x): for each symbol that a batch brings bars of, its last `lookback` bars so far.

    bars: a stream of symbol, ts and the features. A symbol's last bars are its state, of bounded size; nothing older is read again.
    Rows may come late or again: they go to their place in time, and a newer version replaces an older one. With expire, an interval
    such as "30 days", the state of a symbol goes once its last bar is so far behind the newest bar of all, and the symbol then
    begins anew; rows that are later than that are dropped.
    """

    def update(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        at, x = (list(v) for v in state.get) if state.exists else ([], [])
        for frame in frames:
            at, x = merged(at, x, frame["at"].tolist(), [list(v) for v in frame["x"]], lookback)
        x = [list(map(float, row)) for row in x]
        state.update((at, x))
        if expire is not None:
            state.setTimeoutTimestamp(at[-1] // 1000 + 1)
        yield pd.DataFrame({"symbol": [key[0]], "at": [at], "x": [x]})

    row = F.array(*(F.col(c).cast("double") for c in features)).alias("x")
    bars = bars.where("symbol is not null and ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    if expire is not None:
        bars = bars.withWatermark("ts", expire)
    rows = bars.select("symbol", "ts", F.unix_micros("ts").alias("at"), row)
    timeout = GroupStateTimeout.NoTimeout if expire is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy("symbol").applyInPandasWithState(update, CONTEXT_SCHEMA, STATE_SCHEMA, "append", timeout)


def merge_predictions(found: DataFrame, out: str) -> None:
    """Writes the predictions of some symbols into the partitions of their dates, beside those of other symbols that are there."""
    session = found.sparkSession
    found = found.persist()
    try:
        there = session.read.parquet(out)
        changed = found.select("symbol", "asof_date").distinct()
        dates = there.join(F.broadcast(changed.select("asof_date").distinct()), "asof_date", "left_semi")
        others = dates.join(changed, ["symbol", "asof_date"], "left_anti")
        rows = found.unionByName(others.select(*found.columns))
    except AnalysisException:  # nothing was written yet
        rows = found
    write_predictions(rows, out)
    found.unpersist()


def refresh_stream(
    spark: SparkSession,
    path: str,
    schema: str,
    out: str,
    checkpoint: str,
    factory: Factory,
    lookback: int,
    horizon: int,
    samples: int = 1,
    features: tuple[str, ...] = FEATURES,
    seed: int = 42,
    batch: int = BATCH,
    expire: str | None = None,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Scores the symbols of each batch of new Parquet bar files from their last bars, which are kept as state, and puts the paths
    into the partitions of their dates. Each file is read once; after a restart the checkpoint has the state.

    A symbol with fewer than `lookback` bars so far gives a row with status skipped. A batch that is run again gives the same rows.
    """

    def refresh(contexts: DataFrame, _: int) -> None:
        series = contexts.withColumn("asof_ts", F.timestamp_micros(F.element_at("at", -1)))
        found = score_stacked(series, factory, horizon, samples, seed, lookback, batch)
        merge_predictions(found.withColumn("asof_date", F.to_date("asof_ts")), out)

    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    contexts = context_stream(reader.parquet(path), lookback, features, expire)
    return contexts.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def candles(events: DataFrame, key: str, value: str, ts: str = "ts", order: str = "event_id", span: str = "1 hour", late: str | None = "1 hour") -> DataFrame:
    """Candles of a value by key and span; events may be a stream, whose rows later than `late` are then dropped."""
    if late and events.isStreaming:
        events = events.withWatermark(ts, late)
    at = F.struct(ts, order)
    bars = events.groupBy(F.window(ts, span).alias("w"), F.col(key).alias("symbol")).agg(
        F.min_by(value, at).alias("open"),
        F.max(value).alias("high"),
        F.min(value).alias("low"),
        F.max_by(value, at).alias("close"),
        F.count("*").alias("volume"),
        F.sum(value).alias("amount"),
    )
    return bars.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", F.col("volume").cast("double").alias("volume"), "amount")
