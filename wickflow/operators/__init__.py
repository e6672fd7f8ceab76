"""DataFrame operators on bars, windows, tokens, forecasts and portfolios."""
