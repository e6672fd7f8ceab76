"""Health of training runs, choice of the best, freshness of predictions and frozen metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickflow.operators.quality import compare_metrics
from wickflow.operators.tokens import CODES, drift_from_first


def progress(runs: DataFrame, metric: str = "loss", mode: str = "min", order: str = "run") -> DataFrame:
    """best up to each run, whether it improved, and for how many runs in a row nothing did."""
    w = Window.partitionBy("model").orderBy(order)
    pick = F.min if mode == "min" else F.max
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    rows = runs.withColumn("best", pick(metric).over(upto)).withColumn("prior", pick(metric).over(before))
    better = F.col(metric) < F.col("prior") if mode == "min" else F.col(metric) > F.col("prior")
    rows = rows.withColumn("improved", F.col("prior").isNull() | better).drop("prior")
    rows = rows.withColumn("island", F.sum(F.col("improved").cast("int")).over(upto))
    streak = F.row_number().over(Window.partitionBy("model", "island").orderBy(order)) - 1
    return rows.withColumn("stale", streak).drop("island")


def health(
    runs: DataFrame, worse: float = 1.05, min_util: float = 25.0, max_kl: float = 0.5, patience: int = 3, first_counts: bool = True
) -> DataFrame:
    """runs: model, run, loss, s2_util, kl. reasons: what speaks against each run; the best counts the run itself.

    Without first_counts a model's first run is only what later ones are held against: it has no best, and no reasons.
    """
    later = F.lit(True) if first_counts else F.col("run") > F.min("run").over(Window.partitionBy("model"))
    rows = progress(runs.withColumn("later", later).withColumn("counted", F.when(F.col("later"), F.col("loss"))), "counted")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("later") & (F.col("loss") > F.col("best") * worse), "loss above best"),
            F.when(F.col("later") & (F.col("s2_util") < min_util), "low utilisation"),
            F.when(F.col("later") & (F.col("kl") > max_kl), "drift"),
            F.when(F.col("later") & (F.col("stale") >= patience), "no improvement"),
        )
    )
    return rows.withColumn("reasons", reasons).withColumn("healthy", F.size("reasons") == 0).drop("later", "counted")


def codec_health(losses: DataFrame, counts: DataFrame, codes: int = CODES, **limits) -> DataFrame:
    """Health of a codec's runs by their code counts. losses: model, run, loss; counts: model, run, code (s1 or s2), token, n.

    kl is the mean over s1 and s2 of the divergence of a run's codes from those of the model's first run, which only sets the measure.
    A run without counts has no kl and no utilisation, and is judged by its loss alone. limits: as for health.
    """
    by_code = drift_from_first(counts, codes).groupBy("model", "run").agg(
        F.avg("kl").alias("kl"), F.max(F.when(F.col("code") == "s2", F.col("used_pct"))).alias("s2_util")
    )
    return health(losses.join(by_code, ["model", "run"], "left"), first_counts=False, **limits)


def best_run(runs: DataFrame, metric: str = "loss", mode: str = "min", patience: int | None = None) -> DataFrame:
    """(model, run, value) of the best run, of those before patience ran out."""
    rows = progress(runs, metric, mode)
    if patience is not None:
        stop = F.min(F.when(F.col("stale") >= patience, F.col("run"))).over(Window.partitionBy("model"))
        rows = rows.withColumn("stop", stop).where("stop is null or run <= stop")
    sign = F.col(metric) if mode == "min" else -F.col(metric)
    return rows.groupBy("model").agg(F.min(F.struct(sign.alias("s"), "run", F.col(metric).alias("value"))).alias("b")).select("model", "b.run", "b.value")


def stale_symbols(seen: DataFrame, now: DataFrame) -> DataFrame:
    """(symbol, change) of sources that are new, changed or gone since; both sides have symbol and stamp."""
    both = seen.withColumnRenamed("stamp", "old").join(now.withColumnRenamed("stamp", "new"), "symbol", "full")
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "gone").when(F.col("old") != F.col("new"), "changed")
    return both.select("symbol", change.alias("change")).where("change is not null")


def is_fresh(meta: DataFrame, asked: DataFrame, parameters: list[str], seen: DataFrame, now: DataFrame) -> DataFrame:
    """One row: whether stored predictions have the asked parameters (NULL equals NULL) and no source changed."""
    same = meta
    for name in parameters:
        same = same.withColumnRenamed(name, f"{name}_kept")
    condition = F.lit(True)
    for name in parameters:
        condition &= F.col(f"{name}_kept").eqNullSafe(F.col(name))
    matches = same.join(asked.select(*parameters), condition).agg((F.count("*") > 0).alias("parameters_match"))
    changes = stale_symbols(seen, now).agg(F.count("*").alias("changed"))
    return matches.join(F.broadcast(changes)).withColumn("fresh", F.col("parameters_match") & (F.col("changed") == 0))


def answered(
    stored: DataFrame, asked: DataFrame, parameters: list[str], seen: DataFrame, now: DataFrame, make: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Predictions of every symbol that has a source now: the stored ones where they hold, new ones for the rest; `stored` says which.

    A stored prediction holds if it was made with the asked parameters (NULL equals NULL; asked has one row) and its source has the
    stamp that was seen then. make gets the symbols of the rest, as (symbol), and returns their predictions with the same columns
    but for the parameters; it is the only part that reads bars. A symbol that make leaves out has no row.
    """
    wanted = asked.select(*(F.col(name).alias(f"{name}_asked") for name in parameters))
    same = F.lit(True)
    for name in parameters:
        same &= F.col(name).eqNullSafe(F.col(f"{name}_asked"))
    unchanged = seen.select("symbol", "stamp").join(now.select("symbol", "stamp"), ["symbol", "stamp"], "left_semi").select("symbol")
    good = stored.join(F.broadcast(wanted), same, "left_semi").join(unchanged, "symbol", "left_semi")
    rest = now.select("symbol").distinct().join(good.select("symbol"), "symbol", "left_anti")
    made = make(rest).join(F.broadcast(asked.select(*parameters)))
    return good.withColumn("stored", F.lit(True)).unionByName(made.select(*stored.columns).withColumn("stored", F.lit(False)))


def freeze(base: DataFrame, candidate: DataFrame, artifacts: DataFrame) -> DataFrame:
    """One row: compared metrics and artifact hashes, to be written as a manifest."""
    rows = compare_metrics(base, candidate)
    columns = ["metric", "split", *(c for c in rows.columns if c not in ("metric", "split"))]
    metrics = rows.agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("metrics"))
    hashes = artifacts.agg(F.array_sort(F.collect_list(F.struct("file", "sha256"))).alias("artifacts"))
    return metrics.join(F.broadcast(hashes))
