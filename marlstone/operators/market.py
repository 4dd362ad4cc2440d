"""Market-model readings: abnormal returns against a benchmark, horizon z-scores and peers, for all tickers at once.

Bars are (date, ticker, close, volume); the benchmark is (date, market): one close a date, so it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions.rolling import deviation, full, log, nonzero, over, sessions, total

ESTIMATION = 252
HORIZONS = {"1d": 1, "1w": 5, "1m": 21, "3m": 63, "1y": 252}
UNUSUAL, FOLLOWED, BUSY = 2.0, 1.0, 1.5


def market_join(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Bars with the benchmark on the asset's own dates."""
    return bars.join(benchmark, "date", "left")


def abnormal_returns(bars: DataFrame, benchmark: DataFrame, *, estimation: int = ESTIMATION) -> DataFrame:
    """Adds ret, mret, beta and abnormal (W1, W13, W14). The beta of a day comes from the returns that end the day before."""
    w = sessions()
    df = market_join(bars, benchmark)
    df = df.withColumns({"ret": log(F.col("close")) - F.lag(log(F.col("close"))).over(w), "mret": log(F.col("market")) - F.lag(log(F.col("market"))).over(w)})
    frame, both = over(-estimation, -1), F.col("ret") * F.col("mret")
    cov = full(F.covar_samp("ret", "mret").over(frame), both, frame, estimation)
    beta = cov / nonzero(full(F.var_samp("mret").over(frame), F.col("mret"), frame, estimation))
    return df.withColumn("beta", beta).withColumn("abnormal", F.col("ret") - F.col("beta") * F.col("mret"))


def horizon_columns(k: int, estimation: int = ESTIMATION) -> dict[str, Column]:
    """Cumulative abnormal return over k sessions, and its z-score by daily deviation before the horizon."""
    x = F.col("abnormal")
    cumulative = total(x, over(-(k - 1), 0), k)
    scale = nonzero(deviation(x, over(-(k + estimation - 1), -k), estimation) * F.sqrt(F.lit(float(k))))
    return {f"cum_{k}": cumulative, f"z_{k}": cumulative / scale}


def read_horizons(bars: DataFrame, benchmark: DataFrame, *, horizons: dict[str, int] = HORIZONS, estimation: int = ESTIMATION) -> DataFrame:
    """Each ticker's latest row read over each horizon, with a status instead of an error."""
    w = sessions()
    df = abnormal_returns(bars, benchmark, estimation=estimation)
    df = df.withColumns({name: c for k in horizons.values() for name, c in horizon_columns(k, estimation).items()})
    extra: dict[str, Column] = {}
    for k in horizons.values():
        base = max(3 * k, 60)
        extra[f"start_{k}"] = F.lag("close", k).over(w)
        extra[f"mstart_{k}"] = F.lag("market", k).over(w)
        extra[f"recent_{k}"] = F.avg("volume").over(over(-(k - 1), 0))
        extra[f"before_{k}"] = F.avg("volume").over(over(-(k + base - 1), -k))
    df = df.withColumns(extra).withColumn("_last", F.row_number().over(W.partitionBy("ticker").orderBy(F.col("date").desc()))).filter("_last = 1")
    readings = []
    for name, k in horizons.items():
        z, before = F.col(f"z_{k}"), F.col(f"before_{k}")
        multiple = F.when(before == 0, F.lit(1.0)).otherwise(F.col(f"recent_{k}") / nonzero(before))
        ok = z.isNotNull() & multiple.isNotNull()
        fields = {
            "return_pct": (F.col("close") / F.col(f"start_{k}") - 1) * 100, "benchmark_return_pct": (F.col("market") / F.col(f"mstart_{k}") - 1) * 100, "beta": F.col("beta"),
            "abnormal_return_pct": F.expm1(f"cum_{k}") * 100, "z_score": z, "unusual": F.abs(z) >= UNUSUAL, "volume_multiple": multiple, "volume_unusual": multiple >= BUSY,
        }
        readings.append(F.struct(F.lit(name).alias("horizon"), F.when(ok, "available").otherwise("unavailable").alias("status"), *[F.when(ok, c).alias(f) for f, c in fields.items()]))
    return df.select("ticker", "date", F.explode(F.array(*readings)).alias("r")).select("ticker", "date", "r.*")


def read_peers(bars: DataFrame, benchmark: DataFrame, *, sessions_back: int = 21, limit: int = 4, least: float = 0.45, estimation: int = ESTIMATION, subjects: list[str] | None = None) -> DataFrame:
    """Each subject's most correlated tickers before the horizon, and whether they moved with it.

    Correlation is on the ``estimation`` dates of the common calendar before the horizon. Without ``subjects`` all tickers are; the
    self-join is on dates within that window only.
    """
    k = sessions_back
    dates = bars.select("date").distinct().withColumn("back", F.row_number().over(W.orderBy(F.col("date").desc())))
    calendar = dates.withColumn("previous", F.lead("date").over(W.orderBy(F.col("date").desc())))  # a row a date: small
    prices = bars.select("ticker", "date", log(F.col("close")).alias("p"))
    now = prices.join(F.broadcast(calendar.filter(f"back > {k} and back <= {k + estimation}")), "date")
    ret = now.join(prices.withColumnsRenamed({"date": "previous", "p": "p0"}), ["ticker", "previous"]).select("ticker", "date", (F.col("p") - F.col("p0")).alias("r"))
    left = ret if subjects is None else ret.filter(F.col("ticker").isin(subjects))
    pairs = left.alias("a").join(ret.alias("b"), (F.col("a.date") == F.col("b.date")) & (F.col("a.ticker") != F.col("b.ticker")))
    corr = pairs.groupBy(F.col("a.ticker").alias("ticker"), F.col("b.ticker").alias("peer")).agg(F.corr("a.r", "b.r").alias("correlation")).filter(F.col("correlation") >= least)
    df = abnormal_returns(bars, benchmark, estimation=estimation).withColumns(horizon_columns(k, estimation))
    last = df.withColumn("_n", F.row_number().over(W.partitionBy("ticker").orderBy(F.col("date").desc()))).filter("_n = 1").select("ticker", F.col(f"cum_{k}").alias("cum"), F.col(f"z_{k}").alias("z"))
    own = last.select("ticker", F.signum("z").alias("direction"))
    peers = corr.join(last.withColumnsRenamed({"ticker": "peer"}), "peer").join(own, "ticker").filter("z is not null")
    rank = F.row_number().over(W.partitionBy("ticker").orderBy(F.col("correlation").desc(), "peer"))
    followed = F.coalesce((F.signum("z") == F.col("direction")) & (F.abs("z") >= FOLLOWED), F.lit(False))
    return peers.withColumn("rank", rank).filter(F.col("rank") <= limit).select("ticker", "peer", "rank", "correlation", (F.expm1("cum") * 100).alias("abnormal_return_pct"), F.col("z").alias("z_score"), followed.alias("followed"))


def market_view(bars: DataFrame, days: int = 252) -> DataFrame:
    """The last 20 to 800 closes of each ticker."""
    n = min(800, max(20, days))
    return bars.withColumn("_n", F.row_number().over(W.partitionBy("ticker").orderBy(F.col("date").desc()))).filter(F.col("_n") <= n).drop("_n")


def rebased(series: DataFrame, value: str = "close", *, logs: bool = False) -> DataFrame:
    """Level relative to the first observation, in percent."""
    first = F.first(value, ignorenulls=True).over(sessions().rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    level = (F.col(value) - first) * 100 if logs else F.col(value) / nonzero(first) * 100
    return series.withColumn("level", level)
