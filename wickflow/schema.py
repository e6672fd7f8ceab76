"""Column lists, schemas and default parameters."""

from pyspark.sql import types as T

PRICES = ("open", "high", "low", "close")
FEATURES = (*PRICES, "volume", "amount")
BAR_COLUMNS = ("timestamps", *FEATURES)
BAR_SCHEMA = T.StructType(
    [T.StructField("timestamps", T.TimestampNTZType()), *(T.StructField(c, T.DoubleType()) for c in FEATURES)]
)

# The defaults of the analyses.
LOOKBACK, HORIZON, GAP = 126, 5, 5
MAX_NULL, CLIP = 0.10, 5.0
STD_GUARD, STD_EPSILON = 1e-6, 1e-5
TOP_K, MIN_SYMBOLS = 10, 45
FEE, PERIODS_A_YEAR, RISK_FREE = 0.0015, 50.4, 0.04
RETURN_BOUND = 0.5
