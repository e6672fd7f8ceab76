"""The inverse normal in column expressions and in SQL, and Q-Q pairs, against the standard library."""

import math
from statistics import NormalDist

import duckdb
import pytest
from pyspark.sql import functions as F

from wickflow.functions import scalars
from wickflow.operators import profile

P = [1e-300, 1e-30, 1e-11, 1e-5, 0.01, 0.075, 0.0749999, 0.3, 0.5, 0.500001, 0.924, 0.925, 0.9251, 0.99, 1 - 1e-9]


def test_quantiles(spark):
    rows = spark.createDataFrame([(p,) for p in [*P, 0.0, 1.0, -1.0, 2.0, None]], "`p` double")
    found = {r["p"]: r["z"] for r in rows.withColumn("z", scalars.normal_quantile(F.col("p"))).collect()}
    for p in P:
        want = NormalDist().inv_cdf(p)
        assert found[p] == pytest.approx(want, rel=1e-13, abs=1e-13)
        assert duckdb.sql(f"SELECT {scalars.normal_quantile_sql('p')} FROM (SELECT {p!r}::DOUBLE AS p)").fetchall()[0][0] == pytest.approx(want, rel=1e-13, abs=1e-13)
    assert all(math.isnan(found[p]) for p in (0.0, 1.0, -1.0, 2.0)) and found[None] is None


def test_pairs_and_fit(spark):
    values = [3.0, -1.0, 2.0, 2.0, None, 7.0, 0.5]
    rows = spark.createDataFrame([("A", v) for v in values] + [("B", 1.0)], "symbol string, r double")
    found = sorted((r["ordered"], r["theoretical"]) for r in profile.qq(rows).where("symbol = 'A'").collect())
    n, ordered = 6, sorted(v for v in values if v is not None)
    places = [1 - 0.5 ** (1 / n), *((i - 0.3175) / (n + 0.365) for i in range(2, n)), 0.5 ** (1 / n)]
    assert [x for x, _ in found] == ordered
    assert [z for _, z in found] == pytest.approx([NormalDist().inv_cdf(p) for p in places], abs=1e-12)
    line = spark.range(2000).select(F.lit("L").alias("symbol"), ((F.col("id") + 0.5) / 2000).alias("p"))
    fit = profile.qq_fit(profile.qq(line.withColumn("r", 3 + 2 * scalars.normal_quantile(F.col("p"))))).first()
    assert (fit["slope"], fit["intercept"]) == (pytest.approx(2, abs=0.01), pytest.approx(3, abs=1e-9)) and fit["r2"] > 0.9999


def test_dates(spark):
    row = spark.sql("SELECT date'2024-03-09' d").select(scalars.day_month(F.col("d")), scalars.file_date(F.col("d")), scalars.date_tag(F.col("d"))).first()
    assert tuple(row) == ("09/03", "09-03-2024", "20240309")
