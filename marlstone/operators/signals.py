"""Single-series detectors over bars (date, ticker, open, high, low, close, volume), all tickers in one job.

Each returns (ticker, observed_on, kind, z_score, direction, ...). No result at a date depends on later rows. All windows have
the same partitioning and order, so there is one shuffle by ticker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions.rolling import mean, nonzero, over, positive, sessions, total, trailing_sigmas, trailing_zscore, deviation, log

def typical_price():
    """(high + low + close) / 3."""
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def prepared(bars: DataFrame, order: str | None = None) -> DataFrame:
    """One row for each ticker and date, the last by ``order`` (F4). Without ``order``, rows must be unique already."""
    if order is None:
        return bars
    w = W.partitionBy("ticker", "date").orderBy(F.col(order).desc())
    return bars.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def rolling_vwap(n: int = 20):
    """Sum of price times volume over sum of volume, this row included."""
    frame = over(-(n - 1), 0)
    return total(typical_price() * F.col("volume"), frame, n) / positive(total(F.col("volume"), frame, n))


def rolling_twap(n: int):
    """Mean typical price."""
    return mean(typical_price(), over(-(n - 1), 0), n)


def moving_average(n: int, column: str = "close"):
    """Mean close."""
    return mean(F.col(column), over(-(n - 1), 0), n)


def detect_volume_spikes(bars: DataFrame, *, window: int = 20, threshold: float = 3.0) -> DataFrame:
    """Sessions whose ln(volume) is more than ``threshold`` deviations above the window before it."""
    df = bars.withColumn("log_volume", log(F.col("volume")))
    df = df.withColumns({"z_score": trailing_zscore(F.col("log_volume"), window), "average": mean(F.col("volume"), over(-window, -1), window)})
    df = df.filter(F.col("z_score") > threshold)
    up = F.col("close") / F.col("open") - 1 >= 0
    return df.select("ticker", F.col("date").alias("observed_on"), F.lit("volume_spike").alias("kind"), "z_score", F.when(up, "up").otherwise("down").alias("direction"), (F.col("volume") / F.col("average")).alias("measure"))


def detect_vwap_deviations(bars: DataFrame, *, window: int = 20, baseline: int = 60, threshold: float = 2.5) -> DataFrame:
    """Closes unusually far from the rolling VWAP (W9); ``measure`` is the deviation."""
    df = bars.withColumn("measure", F.col("close") / nonzero(rolling_vwap(window)) - 1)
    df = df.withColumn("z_score", trailing_sigmas(F.col("measure"), baseline)).filter(F.abs("z_score") > threshold)
    return df.select("ticker", F.col("date").alias("observed_on"), F.lit("vwap_deviation").alias("kind"), "z_score", F.when(F.col("measure") > 0, "above").otherwise("below").alias("direction"), "measure")


def detect_twap_deviations(bars: DataFrame, *, horizon: int = 5, baseline: int = 60, threshold: float = 2.5) -> DataFrame:
    """A TWAP over ``horizon`` sessions unusually far from the close on arrival (W10); ``measure`` is the shortfall."""
    arrival = F.lag("close", horizon).over(sessions())
    df = bars.withColumn("measure", rolling_twap(horizon) / nonzero(arrival) - 1)
    df = df.withColumn("z_score", trailing_sigmas(F.col("measure"), baseline)).filter(F.abs("z_score") > threshold)
    return df.select("ticker", F.col("date").alias("observed_on"), F.lit("twap_deviation").alias("kind"), "z_score", F.when(F.col("measure") > 0, "above").otherwise("below").alias("direction"), "measure")


def detect_trend_breaks(bars: DataFrame, *, fast: int = 7, slow: int = 25, whipsaw: int = 5) -> DataFrame:
    """Sign changes of the gap of two moving averages.

    A change to zero is no cross, one from zero is. A ticker's first sign is dropped. A cross at most ``whipsaw`` sessions after the last one is a
    whipsaw. The strength is the gap's step over the deviation of the ``slow`` steps before it, or 0 without one.
    """
    df = bars.withColumns({"fast_ma": moving_average(fast), "slow_ma": moving_average(slow)})
    df = df.filter(F.col("slow_ma").isNotNull()).withColumn("gap", F.col("fast_ma") - F.col("slow_ma"))
    w = sessions()
    df = df.withColumns({"side": F.signum("gap"), "step": F.col("gap") - F.lag("gap").over(w), "at": F.row_number().over(w)})
    df = df.withColumns({"was": F.lag("side").over(w), "spread": deviation(F.col("step"), over(-slow, -1), slow)})
    crosses = df.filter((F.col("side") != 0) & (F.col("was").isNull() | (F.col("was") != F.col("side"))))
    crosses = crosses.withColumns({"nth": F.row_number().over(w), "last": F.lag("at").over(w)}).filter("nth > 1")
    since = F.when(F.col("nth") > 2, F.col("at") - F.col("last"))
    kind = F.when(since <= whipsaw, "trend_whipsaw").otherwise("trend_cross")
    strength = F.when(F.col("spread") > 0, F.col("step") / F.col("spread")).otherwise(F.lit(0.0))
    direction = F.when(F.col("side") > 0, "bullish").otherwise("bearish")
    return crosses.select("ticker", F.col("date").alias("observed_on"), kind.alias("kind"), strength.alias("z_score"), direction.alias("direction"), (F.col("gap") / F.col("slow_ma")).alias("measure"))


def detect_all_signals(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """All detectors' findings between two dates, ends included (W12, F3). Windows see all rows; the dates only select."""
    found = detect_volume_spikes(bars).unionByName(detect_vwap_deviations(bars)).unionByName(detect_twap_deviations(bars)).unionByName(detect_trend_breaks(bars))
    if start:
        found = found.filter(F.col("observed_on") >= F.lit(start).cast("date"))
    if end:
        found = found.filter(F.col("observed_on") <= F.lit(end).cast("date"))
    return found
