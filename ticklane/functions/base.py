"""Small helpers that every panel operator uses: windows, null-safe arithmetic, frames with a least number of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EPS = 1e-12

def w():
    """A code's rows in order of date."""
    return W.partitionBy("code").orderBy("date")


def wd():
    """A date's codes."""
    return W.partitionBy("date")


def upto():
    """All rows of a code so far, this one included."""
    return w().rowsBetween(W.unboundedPreceding, 0)


def wr(n: int):
    """The last n rows of a code, this one included."""
    return w().rowsBetween(-(n - 1), 0)


def ahead(n: int):
    """The next n rows of a code."""
    return w().rowsBetween(1, n)


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def full(x, n: int, made: Column) -> Column:
    """made where the last n rows of x have no null, else null."""
    return F.when(F.count(c(x)).over(wr(n)) == n, made)


def b(p: Column) -> Column:
    """A predicate in which null counts as false."""
    return F.coalesce(p, F.lit(False))


def div(x, y) -> Column:
    """x / y, null where y is 0 or null."""
    return c(x) / F.nullif(c(y), F.lit(0.0))


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """x within bounds; null stays null."""
    out = x
    if low is not None:
        out = F.when(out < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(high)).otherwise(out)
    return out


def finite(x) -> Column:
    """NaN and infinities to null."""
    x = c(x)
    return F.when(~(F.isnan(x) | (F.abs(x) == F.lit(float("inf")))), x)


def near(x, places: int = 9) -> Column:
    """x to so many places, in plain double arithmetic (round() goes through decimals): float noise makes no ranks."""
    return F.rint(c(x) * 10.0**places) / 10.0**places


def sma(x, n: int) -> Column:
    return full(x, n, F.avg(c(x)).over(wr(n)))


def rolling_max(x, n: int) -> Column:
    return full(x, n, F.max(c(x)).over(wr(n)))


def rolling_min(x, n: int) -> Column:
    return full(x, n, F.min(c(x)).over(wr(n)))


def rolling_sum(x, n: int) -> Column:
    return full(x, n, F.sum(c(x)).over(wr(n)))


def rolling_std(x, n: int) -> Column:
    return full(x, n, F.stddev_samp(c(x)).over(wr(n)))


def lag(x, n: int = 1) -> Column:
    return F.lag(c(x), n).over(w())


def lead(x, n: int = 1) -> Column:
    return F.lead(c(x), n).over(w())
