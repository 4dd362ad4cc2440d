"""Rolling measures with a full window: a value only where the frame holds as many non-null rows as it asks for.

Sessions are rows of one ticker in date order. ``over(lo, hi)`` frames them by row, so two measures of one frame share a
window operator.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sessions(by: str = "ticker", on: str = "date") -> WindowSpec:
    return W.partitionBy(by).orderBy(on)


def over(lo: int, hi: int, by: str = "ticker", on: str = "date") -> WindowSpec:
    return sessions(by, on).rowsBetween(lo, hi)


def full(value: Column, x: Column, frame: WindowSpec, n: int) -> Column:
    """``value`` where the frame holds n rows in which x isn't null."""
    return F.when(F.count(x).over(frame) == n, value)


def mean(x: Column, frame: WindowSpec, n: int) -> Column:
    return full(F.avg(x).over(frame), x, frame, n)


def total(x: Column, frame: WindowSpec, n: int) -> Column:
    return full(F.sum(x).over(frame), x, frame, n)


def deviation(x: Column, frame: WindowSpec, n: int) -> Column:
    """Sample standard deviation."""
    return full(F.stddev_samp(x).over(frame), x, frame, n)


def log(x: Column) -> Column:
    """ln of what is above zero, or else null."""
    return F.when(x > 0, F.ln(x))


def positive(x: Column) -> Column:
    """x where it is above zero, or else null: for denominators."""
    return F.when(x > 0, x)


def nonzero(x: Column) -> Column:
    return F.when(x != 0, x)


def trailing_zscore(x: Column, n: int) -> Column:
    """How far x is from the mean of the n rows strictly before it, in their standard deviations."""
    frame = over(-n, -1)
    return (x - mean(x, frame, n)) / nonzero(deviation(x, frame, n))


def trailing_sigmas(x: Column, n: int) -> Column:
    """x over the root mean square of the n rows before it; the mean isn't removed."""
    return x / nonzero(F.sqrt(mean(x * x, over(-n, -1), n)))


def log_return(close: Column) -> Column:
    """Difference of ln(close) on a ticker's own rows."""
    return log(close) - F.lag(log(close)).over(sessions())
