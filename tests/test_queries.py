"""Candle queries on the smallest tables, and against DuckDB where their parameters do not depend on the size."""

import math
import os
import re

import duckdb
import pytest

from wickflow import catalog

SF, NEXT = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")

#: Queries that are empty on the smallest tables, whose series are short: those are held against SQL on the next ones.
WIDE = [
    "per_date_metrics",
    "backtest_summary",
    "backtest_by_split",
    "paired_t_test",
    "long_list_overlap",
    "yearly_comparison",
    "daily_grades",
    "portfolio_returns",
    "portfolio_curves",
    "portfolio_statistics",
    "dashboard_flags",
]
SAME = sorted(set(catalog.oracle_sql()) - set(WIDE))


def connected(sf):
    con = duckdb.connect()
    for name in ("lineitem", "part", "events", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def db():
    return {sf: connected(sf) for sf in (SF, NEXT)}


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.11g}") + 0.0
    return v


#: Kinds of columns that count as equal on both sides.
KINDS = {
    "integer": r"tinyint|smallint|int|integer|bigint|hugeint",
    "double": r"double|float",
    "text": r"string|varchar",
    "boolean": r"boolean",
    "date": r"date",
    "time": r"timestamp.*",
    "array": r"array.*|.*\[\]",
    "struct": r"struct.*",
}


def kind(name):
    return next((k for k, pattern in KINDS.items() if re.fullmatch(pattern, name.lower())), name)


@pytest.mark.parametrize("name", [*SAME, *WIDE])
def test_against_sql(spark, db, name):
    """The SQL as it is: the same names and kinds of columns, then the same rows."""
    sf = NEXT if name in WIDE else SF
    rows, want = catalog.queries()[name](spark, sf), db[sf].sql(catalog.oracle_sql()[name])
    columns = sorted(rows.columns)
    assert columns == sorted(want.columns)
    kinds = {c: kind(str(t)) for c, t in zip(want.columns, want.types)}
    assert {c: kind(t) for c, t in rows.dtypes} == kinds
    at = [want.columns.index(c) for c in columns]
    got = sorted(repr([shown(r[c]) for c in columns]) for r in rows.collect())
    wanted = sorted(repr([shown(r[k]) for k in at]) for r in want.fetchall())
    assert got == wanted and (got or name not in WIDE)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
