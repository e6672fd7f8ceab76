"""Column functions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def pearson(a: str, b: str) -> Column:
    """Correlation as an aggregate; NULL where a side is constant, up to rounding."""
    n = F.count("*")
    sa, sb = F.sum(a), F.sum(b)
    cov = F.sum(F.col(a) * F.col(b)) - sa * sb / n
    va, vb = F.sum(F.col(a) * F.col(a)) - sa * sa / n, F.sum(F.col(b) * F.col(b)) - sb * sb / n
    return F.when((va > 1e-12) & (vb > 1e-12), F.try_divide(cov, F.sqrt(va) * F.sqrt(vb)))


def time_features(ts: Column, daily: bool = False) -> dict[str, Column]:
    """minute, hour, weekday (Monday 0), day and month; daily bars are stamped 9:00."""
    clock = {"minute": F.lit(0), "hour": F.lit(9)} if daily else {"minute": F.minute(ts), "hour": F.hour(ts)}
    return clock | {"weekday": F.weekday(ts), "day": F.dayofmonth(ts), "month": F.month(ts)}


def keyed_uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on its key alone."""
    key = F.concat_ws(":", *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def exchange_limit(exchange: Column) -> Column:
    """Largest move of a day as a share of the reference, by exchange."""
    return F.when(exchange == "HNX", 0.10).otherwise(0.07)


def price_limits(reference: Column, close: Column, limit: float | Column = 0.07, near: float = 50.0) -> tuple[Column, Column, Column]:
    """Ceiling and floor in steps of 100 around a reference, and the side that the close is at; limit by row or for all."""
    ceiling, floor = F.round(reference * (1 + limit) / 100) * 100, F.round(reference * (1 - limit) / 100) * 100
    side = F.when(close >= ceiling - near, "ceiling").when(close <= floor + near, "floor").otherwise("between")
    return ceiling, floor, side


def settlement_date(day: Column, days: int = 3) -> Column:
    """So many days on, then past a weekend."""
    due = F.date_add(day, days)
    return F.when(F.weekday(due) == 5, F.date_add(due, 2)).when(F.weekday(due) == 6, F.date_add(due, 1)).otherwise(due)


def short_number(x: Column) -> Column:
    """With K, M or B."""
    return (
        F.when(F.abs(x) >= 1e9, F.concat(F.format_number(x / 1e9, 1), F.lit("B")))
        .when(F.abs(x) >= 1e6, F.concat(F.format_number(x / 1e6, 1), F.lit("M")))
        .when(F.abs(x) >= 1e3, F.concat(F.format_number(x / 1e3, 1), F.lit("K")))
        .otherwise(F.format_number(x, 1))
    )


def date_tag(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd")


def day_month(day: Column) -> Column:
    """dd/mm, as charts label days."""
    return F.date_format(day, "dd/MM")


def file_date(day: Column) -> Column:
    """dd-mm-yyyy, as stored prediction sets are named."""
    return F.date_format(day, "dd-MM-yyyy")


# Wichura's rational approximations of the inverse normal (algorithm AS 241), highest power first, as
# numerator and denominator: in q^2 around the middle, and in the root of -ln p near the ends and far out.
MIDDLE = (
    (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080),
    (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0),
)
NEAR = (
    (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258, 3.64784832476320460504, 5.76949722146069140550, 4.63033784615654529590, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940, 2.05319162663775882187, 1.0),
)
FAR = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580, 5.46378491116411436990, 6.65790464350110377720),
    (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0),
)


def normal_quantile_sql(p: str) -> str:
    """The inverse of the standard normal distribution as an SQL expression of p that Spark and DuckDB both read; NULL outside (0, 1).

    p is repeated in it, so it should be a column.
    """

    def polynomial(factors, r):
        text = f"{factors[0]!r}e0" if "e" not in repr(factors[0]) else repr(factors[0])
        for f in factors[1:]:
            text = f"({text} * {r} + {f!r}{'' if 'e' in repr(f) else 'e0'})"
        return text

    def ratio(table, r):
        return f"{polynomial(table[0], r)} / {polynomial(table[1], r)}"

    middle = f"(0.180625e0 - ({p} - 0.5e0) * ({p} - 0.5e0))"
    root = f"sqrt(-ln(CASE WHEN {p} < 0.5e0 THEN {p} ELSE 1e0 - {p} END))"
    return f"""CASE WHEN {p} <= 0e0 OR {p} >= 1e0 THEN NULL
        WHEN abs({p} - 0.5e0) <= 0.425e0 THEN ({p} - 0.5e0) * {ratio(MIDDLE, middle)}
        ELSE (CASE WHEN {p} < 0.5e0 THEN -1e0 ELSE 1e0 END) * (CASE WHEN {root} <= 5e0 THEN {ratio(NEAR, f"({root} - 1.6e0)")}
        ELSE {ratio(FAR, f"({root} - 5e0)")} END) END"""


def normal_quantile(p: Column) -> Column:
    """normal_quantile_sql of a column of doubles, NaN outside (0, 1)."""

    def ratio(table, r: Column) -> Column:
        top, bottom = (reduce(lambda sum_, factor: sum_ * r + factor, factors[1:], F.lit(factors[0])) for factors in table)
        return top / bottom

    q = p - 0.5
    root = F.sqrt(-F.log(F.when(q < 0, p).otherwise(1 - p)))
    tail = F.when(root <= 5, ratio(NEAR, root - 1.6)).otherwise(ratio(FAR, root - 5))
    inside = F.when(F.abs(q) <= 0.425, q * ratio(MIDDLE, 0.180625 - q * q)).otherwise(F.when(q < 0, -tail).otherwise(tail))
    return F.when((p > 0) & (p < 1), inside).when(p.isNotNull(), F.lit(float("nan")))
