"""Spark-first analytics over price candles: bars in, windows, forecasts, rankings and backtests out."""
