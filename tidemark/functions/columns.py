"""Column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Added before rounding, so that exact halves don't depend on their binary form.
TIE = 1e-9


def clamp(col: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def steps(col: Column, limits: list[tuple[float, str]], other: str) -> Column:
    """The label of the first limit that col doesn't exceed."""
    out = None
    for limit, label in limits:
        out = F.when(col <= limit, label) if out is None else out.when(col <= limit, label)
    return out.otherwise(other)


def safe_corr(x: str, y: str) -> Column:
    """Pearson r as an aggregate; 0 if either side is constant."""
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def first_reason(*gates: tuple[Column, str]) -> Column:
    """The name of the first gate whose condition holds, else NULL: a gate marks rows, it never drops them."""
    out = None
    for bad, name in gates:
        out = F.when(bad, name) if out is None else out.when(bad, name)
    return out


def ieee_ratio(over: str, under: str) -> Column:
    """over / under as doubles divide: infinite over 0, NaN if both are 0."""
    return F.when(F.col(under) == 0, F.col(over) * F.pow(F.col(under), F.lit(-1.0))).otherwise(F.try_divide(over, under))


def rounded_double(col: Column | str, places: int) -> Column:
    """Rounded as doubles are in SQL: scaled, rounded to a whole number, scaled back. Spark's own round reads a double's decimal text, so that
    1.0059375, whose double lies a little under it, would be rounded up."""
    scale = F.lit(10.0**places)
    return F.round((F.col(col) if isinstance(col, str) else col) * scale) / scale


def trade_stats(outcome: str = "outcome", times: str = "times") -> list[Column]:
    """n, win_rate, mean, median, total_losses of a group of rows (outcome, times): each outcome counts `times` times. Rows are
    counted by outcome first, which shrinks before the shuffle; the exact median then reads counts of distinct outcomes."""
    o, c = F.col(outcome), F.col(times)
    n = F.sum(c)
    return [
        n.alias("n"),
        F.round(F.sum(F.when(o > 0, c).otherwise(0)) / n + TIE, 6).alias("win_rate"),
        F.round(F.sum(o * c) / n + TIE, 6).alias("mean"),
        F.round(F.percentile(o, 0.5, c) + TIE, 6).alias("median"),
        F.sum(F.when(o <= -0.99, c).otherwise(0)).alias("total_losses"),
    ]
