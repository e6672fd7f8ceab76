"""Writers of metric tables, predictions and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_metrics(metrics: DataFrame, path: str) -> None:
    """(metric, split, value) as CSV with a column for each split."""
    wide = metrics.groupBy("metric").pivot("split", ["validation", "test"]).agg(F.first("value"))
    wide.toDF("Metric", "Validation", "Test").orderBy("Metric").write.mode("overwrite").option("header", True).csv(path)


def write_per_date(per_date: DataFrame, path: str) -> None:
    rows = per_date.withColumn("long_symbols", F.array_join("long_symbols", ","))
    rows.select("date", "da", "rank_ic", "long_symbols").write.mode("overwrite").option("header", True).csv(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Overwrites only the partitions of the dates that are given."""
    writer = predictions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("asof_date").parquet(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.coalesce(1).write.mode("overwrite").json(path)


def write_recon(errors: DataFrame, path: str, value: str) -> None:
    """(model, feature, ...) as CSV with a column for each model."""
    errors.groupBy("feature").pivot("model").agg(F.first(value)).write.mode("overwrite").option("header", True).csv(path)
