"""Structured Streaming jobs: arriving news and live monitoring of frozen fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.rolling import log


def news_arrivals(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """Items of a stream once each by news_id; copies within ``delay`` go, so a late copy never backdates a story (S-1)."""
    return stream.withWatermark("published_at", delay).dropDuplicatesWithinWatermark(["news_id"])


def live_monitor(bars: DataFrame, fits: DataFrame, *, delay: str = "2 days", entry: float = 2.0) -> DataFrame:
    """Each pair's z as soon as both legs' bars of a time have come, for abs z over ``entry`` (S-2).

    Bars are (ts, ticker, close); fits are static. Each bar is joined with the fits it is a leg of; both legs of a pair and time then
    meet in one aggregation, whose state the watermark bounds.
    """
    x = bars.withWatermark("ts", delay).select("ts", "ticker", log(F.col("close")).alias("p"))
    legs = fits.select("a", "b", "const", "beta", "spread_mean", "spread_std").withColumn("leg", F.explode(F.array(F.struct(F.col("a").alias("ticker"), F.lit(1).alias("side")), F.struct(F.col("b").alias("ticker"), F.lit(2).alias("side")))))
    legs = legs.select("a", "b", "const", "beta", "spread_mean", "spread_std", "leg.ticker", "leg.side")
    both = x.join(legs, "ticker").groupBy("ts", "a", "b", "const", "beta", "spread_mean", "spread_std").agg(F.max(F.when(F.col("side") == 1, F.col("p"))).alias("la"), F.max(F.when(F.col("side") == 2, F.col("p"))).alias("lb"))
    z = (F.col("la") - F.col("const") - F.col("beta") * F.col("lb") - F.col("spread_mean")) / F.col("spread_std")
    return both.filter("la is not null and lb is not null").select("ts", "a", "b", z.alias("z")).filter(F.abs("z") > entry)
