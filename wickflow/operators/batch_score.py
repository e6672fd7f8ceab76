"""Scoring in batches: a model is loaded once for each Python worker and gets series of equal length stacked as one array.

A factory opens the model. It has to be a function of an importable module or a partial of one with plain arguments, as the
model that a worker holds is known by the factory's name and arguments.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable
from functools import partial
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickflow.operators.score import PATH_SCHEMA
from wickflow.schema import CLIP, FEATURES, PRICES, STD_EPSILON, STD_GUARD

#: (x: series by rows by features, at: microseconds by series by row, horizon, samples, seeds: one for each series) to prices:
#: series by samples by steps by open, high, low, close. A ValueError skips a series.
BatchForecaster = Callable[[np.ndarray, np.ndarray, int, int, np.ndarray], np.ndarray]
Factory = Callable[[], BatchForecaster]
BATCH = 64

_MODELS: dict[Any, BatchForecaster] = {}


def _name(factory: Factory):
    if isinstance(factory, partial):
        return _name(factory.func), factory.args, tuple(sorted(factory.keywords.items()))
    return factory.__module__, factory.__qualname__


def opened(factory: Factory) -> BatchForecaster:
    """The factory's model; a worker opens it once and keeps it over tasks."""
    name = _name(factory)
    if name not in _MODELS:
        _MODELS[name] = factory()
    return _MODELS[name]


def stacked(contexts: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """(symbol, asof_ts, at, x): one row for each series, its rows in time order as microseconds and features."""
    row = F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.array(*(F.col(c).cast("double") for c in features)).alias("x"))
    rows = contexts.groupBy("symbol", F.col("asof_ts").cast("timestamp").alias("asof_ts")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return rows.select("symbol", "asof_ts", F.col("rows.at").alias("at"), F.col("rows.x").alias("x"))


def _arrays(series: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.array([[[np.nan if v is None else v for v in row] for row in s[3]] for s in series], dtype=np.float64)
    return x, np.array([s[2] for s in series], dtype=np.int64), np.array([s[4] for s in series], dtype=np.int64)


def score_stacked(
    series: DataFrame, factory: Factory, horizon: int, samples: int, seed: int = 42, least: int = 1, batch: int = BATCH
) -> DataFrame:
    """Paths (PATH_SCHEMA) of series as stacked() gives them, in calls of at most `batch` series of one length.

    A series that has fewer than `least` rows gives one row with status skipped and the reason; so does one for which the model
    raises ValueError, which is found by asking for the series of a failed call one by one. Each series has a seed of its own,
    so paths do not depend on what it is stacked with. NULL cells are NaN. A task holds at most `batch` series of each length.
    """
    fields = [f.split()[0] for f in PATH_SCHEMA.split(", ")]
    kinds = [pa.string(), pa.timestamp("us", tz="UTC"), pa.int32(), pa.int32(), *[pa.float64()] * 4, pa.string(), pa.string()]

    def run(batches: Iterable[pa.RecordBatch]):
        model = opened(factory)
        waiting: dict[int, list[tuple]] = defaultdict(list)

        def table(columns):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], fields)

        def skipped(one, why):
            return table([[one[0]], [one[1]], *[[None]] * 6, ["skipped"], [str(why)]])

        def asked(group):
            x, at, seeds = _arrays(group)
            found = np.asarray(model(x, at, horizon, samples, seeds), dtype=np.float64)
            if found.shape != (len(group), samples, horizon, len(PRICES)):
                raise RuntimeError(f"the forecaster returned shape {found.shape}")
            n = samples * horizon
            ids = [np.repeat([s[k] for s in group], n) for k in (0, 1)]
            sample, step = np.repeat(np.arange(samples), horizon), np.tile(np.arange(1, horizon + 1), samples)
            flat = found.reshape(-1, len(PRICES))
            rows = len(group) * n
            return table([ids[0].tolist(), ids[1].tolist(), np.tile(sample, len(group)), np.tile(step, len(group)), *flat.T, ["ok"] * rows, [None] * rows])

        def flush(group):
            try:
                yield asked(group)
            except ValueError:
                for one in group:
                    try:
                        yield asked([one])
                    except ValueError as why:
                        yield skipped(one, why)

        for part in batches:
            stamps = part.column(1).cast(pa.int64()).to_pylist()
            for symbol, asof, at, x in zip(part.column(0).to_pylist(), stamps, part.column(2).to_pylist(), part.column(3).to_pylist()):
                one = (symbol, asof, at, x, zlib.crc32(f"{seed}:{symbol}:{asof}".encode()))
                if len(x) < least:
                    yield skipped(one, f"{len(x)} bars, {least} needed")
                    continue
                group = waiting[len(x)]
                group.append(one)
                if len(group) == batch:
                    yield from flush(waiting.pop(len(x)))
        for group in waiting.values():
            yield from flush(group)

    return series.select("symbol", "asof_ts", "at", "x").mapInArrow(run, PATH_SCHEMA)


def score_batches(
    contexts: DataFrame,
    factory: Factory,
    horizon: int,
    samples: int,
    seed: int = 42,
    least: int = 1,
    batch: int = BATCH,
    features: tuple[str, ...] = FEATURES,
) -> DataFrame:
    """score_stacked of bars with a column asof_ts; a series is one symbol and asof_ts, whose length the caller bounds."""
    return score_stacked(stacked(contexts, features), factory, horizon, samples, seed, least, batch)


def normalized(factory: Factory, clip: float = CLIP) -> BatchForecaster:
    """The factory's model between z-scores: each series is scaled by its own rows and clipped, and what comes back is scaled up again."""
    model = opened(factory)

    def run(x, at, horizon, samples, seeds):
        mean, std = np.nanmean(x, axis=1, keepdims=True), np.nanstd(x, axis=1, keepdims=True)
        std = np.where(std < STD_GUARD, 1.0, std) + STD_EPSILON
        found = model(np.clip((x - mean) / std, -clip, clip), at, horizon, samples, seeds)
        return found * std[:, :, None, : len(PRICES)] + mean[:, :, None, : len(PRICES)]

    return run


def last_values() -> BatchForecaster:
    """Every step of every sample repeats the last row's prices."""

    def run(x, at, horizon, samples, seeds):
        return np.broadcast_to(x[:, None, -1:, : len(PRICES)], (len(x), samples, horizon, len(PRICES)))

    return run


def drawn_returns() -> BatchForecaster:
    """Each path goes on with the series' own ratios of closes, drawn again by the series' seed; all four prices move alike."""

    def run(x, at, horizon, samples, seeds):
        out = np.empty((len(x), samples, horizon, len(PRICES)))
        for k, seed in enumerate(seeds):
            closes = x[k, :, 3]
            ratios = closes[1:] / closes[:-1]
            if not len(ratios) or not np.isfinite(ratios).all():
                raise ValueError("no ratios of closes")
            moves = np.random.default_rng(seed).choice(ratios, (samples, horizon)).cumprod(axis=1)
            out[k] = moves[:, :, None] * x[k, -1, : len(PRICES)]
        return out

    return run
