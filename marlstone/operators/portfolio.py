"""Returns of securities and portfolios, keyed by ticker or portfolio, on bars (date, ticker, close).

An unavailable measure is null with a status; nothing raises.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions.rolling import sessions

SESSIONS_A_YEAR = 252
LONGEST_GAP = 4


def cutoff_bars(bars: DataFrame, as_of: str) -> DataFrame:
    """Bars whose whole UTC day is over by the cutoff; a bare date means its end (F1)."""
    end = F.lit(as_of + "T23:59:59.999999Z" if len(as_of) == 10 else as_of).cast("timestamp")
    return bars.filter(F.col("date").cast("timestamp") + F.expr("INTERVAL '0 23:59:59.999999' DAY TO SECOND") <= end)


def validated_series(bars: DataFrame) -> DataFrame:
    """(ticker, status, reason) of each series: duplicate dates or closes that aren't finite and above 0 make it invalid (F2)."""
    per = bars.groupBy("ticker").agg(F.count("*").alias("n"), F.countDistinct("date").alias("days"), F.count_if(F.col("close").isNull() | F.isnan("close") | (F.col("close") <= 0) | (F.col("close") == float("inf"))).alias("bad"))
    reason = F.when(F.col("n") != F.col("days"), "duplicate dates").when(F.col("bad") > 0, "invalid closes")
    return per.select("ticker", F.when(reason.isNull(), "available").otherwise("unavailable").alias("status"), reason.alias("reason"))


def validated_portfolio(positions: DataFrame) -> DataFrame:
    """(portfolio_id, ticker, weight) of the valid portfolios, weights summing to 1."""
    per = positions.groupBy("portfolio_id").agg(F.count("*").alias("n"), F.countDistinct("ticker").alias("tickers"), F.count_if(F.col("ticker").isNull() | (F.trim("ticker") == "") | F.col("weight").isNull() | F.isnan("weight") | (F.col("weight") < 0)).alias("bad"), F.sum("weight").alias("sum"))
    good = per.filter("n between 1 and 100 and n = tickers and bad = 0").filter(F.abs(F.col("sum") - 1) <= 0.001)
    return positions.join(good.select("portfolio_id", "sum"), "portfolio_id").select("portfolio_id", "ticker", (F.col("weight") / F.col("sum")).alias("weight"))


def with_returns(bars: DataFrame) -> DataFrame:
    """Adds start (the row's previous date) and ret, null over gaps of more than four days."""
    w = sessions()
    df = bars.withColumns({"start": F.lag("date").over(w), "_p": F.lag("close").over(w)})
    return df.withColumn("ret", F.when(F.datediff("date", "start") <= LONGEST_GAP, F.col("close") / F.col("_p") - 1)).drop("_p")


def security_returns(bars: DataFrame) -> DataFrame:
    """Returns over 1, 5, 20, 63 and 252 sessions, volatilities and drawdown, after each ticker's last long gap."""
    w = sessions()
    df = with_returns(bars)
    df = df.withColumn("island", F.sum(F.when(F.datediff("date", "start") > LONGEST_GAP, 1).otherwise(0)).over(w))
    last = F.max("island").over(W.partitionBy("ticker"))
    df = df.withColumn("_last", last).filter("island = _last")
    df = df.withColumn("_back", F.row_number().over(W.partitionBy("ticker").orderBy(F.col("date").desc())))
    df = df.withColumn("ret", F.when(F.lag("date").over(w).isNotNull(), F.col("ret")))
    wealth = F.exp(F.sum(F.when(F.col("_back") <= SESSIONS_A_YEAR, F.log1p("ret"))).over(w))
    df = df.withColumn("wealth", F.when(F.col("ret").isNotNull() & (F.col("_back") <= SESSIONS_A_YEAR), wealth))
    df = df.withColumn("peak", F.greatest(F.lit(1.0), F.max("wealth").over(w)))
    at = lambda n: F.max(F.when(F.col("_back") == n, F.col("close")))
    recent = lambda n: F.when(F.count(F.when(F.col("_back") <= n, F.col("ret"))) == n, F.stddev_samp(F.when(F.col("_back") <= n, F.col("ret"))) * F.sqrt(F.lit(252.0)))
    return df.groupBy("ticker").agg(
        F.max("date").alias("last_session"), *[(at(1) / at(n + 1) - 1).alias(f"return_{n}") for n in (1, 5, 20, 63, 252)],
        recent(20).alias("volatility_20"), recent(60).alias("volatility_60"), F.min(F.col("wealth") / F.col("peak") - 1).alias("max_drawdown"),
    )


def aligned_returns(bars: DataFrame, positions: DataFrame) -> DataFrame:
    """(portfolio_id, date, ticker, weight, ret) on shared return intervals: the latest unbroken run of common sessions.

    An interval counts if all tickers have it with the same start; the last common date must be the last of any ticker; at least two are needed.
    """
    df = with_returns(bars).join(positions.select("portfolio_id", "ticker", "weight"), "ticker")
    count = positions.groupBy("portfolio_id").agg(F.countDistinct("ticker").alias("n"))
    union = df.select("portfolio_id", "date").distinct()
    union = union.withColumn("idx", F.row_number().over(W.partitionBy("portfolio_id").orderBy("date")))
    ends = union.groupBy("portfolio_id").agg(F.max("idx").alias("end_idx"))
    common = df.filter("ret is not null").groupBy("portfolio_id", "date", "start").agg(F.countDistinct("ticker").alias("k")).join(count, "portfolio_id").filter("k = n")
    common = common.join(union, ["portfolio_id", "date"])
    order = W.partitionBy("portfolio_id").orderBy("idx")
    common = common.withColumn("run", F.col("idx") - F.row_number().over(order))
    tail = common.groupBy("portfolio_id").agg(F.max("idx").alias("last_idx"), F.max_by("run", "idx").alias("last_run"), F.count("*").alias("rows")).join(ends, "portfolio_id").filter("last_idx = end_idx and rows >= 2")
    kept = common.join(tail.select("portfolio_id", "last_run"), "portfolio_id").filter("run = last_run")
    enough = kept.groupBy("portfolio_id").count().filter("count >= 2").select("portfolio_id")
    return kept.join(enough, "portfolio_id").select("portfolio_id", "date").join(df.select("portfolio_id", "date", "ticker", "weight", "ret"), ["portfolio_id", "date"])


def portfolio_returns(aligned: DataFrame) -> DataFrame:
    """(portfolio_id, date, ret): weighted sum a date."""
    return aligned.groupBy("portfolio_id", "date").agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"))


def _tail(df: DataFrame, n: int, by: str) -> DataFrame:
    return df.withColumn("_b", F.row_number().over(W.partitionBy(by).orderBy(F.col("date").desc()))).filter(F.col("_b") <= n).drop("_b")


def summary(returns: DataFrame, by: str = "portfolio_id", lookback: int = SESSIONS_A_YEAR) -> DataFrame:
    """Compound return, volatility, drawdown and sessions of the last ``lookback`` returns."""
    df = _tail(returns, lookback, by)
    w = W.partitionBy(by).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("wealth", F.product(1 + F.col("ret")).over(w))
    df = df.withColumn("peak", F.greatest(F.lit(1.0), F.max("wealth").over(w)))
    return df.groupBy(by).agg((F.product(1 + F.col("ret")) - 1).alias("return_window"), F.when(F.count("*") >= 2, F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("volatility"), F.min(F.col("wealth") / F.col("peak") - 1).alias("max_drawdown"), F.count("*").alias("sessions"), F.min("date").alias("start"), F.max("date").alias("end"))


def contributions(aligned: DataFrame, lookback: int = 20) -> DataFrame:
    """(portfolio_id, ticker, contribution) over the last sessions; they sum to the compound return."""
    total = _tail(portfolio_returns(aligned), lookback, "portfolio_id")
    w = W.partitionBy("portfolio_id").orderBy("date")
    prior = F.exp(F.coalesce(F.sum(F.log1p("ret")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    total = total.withColumns({"prior": prior, "n": F.count("*").over(W.partitionBy("portfolio_id"))}).filter(F.col("n") >= lookback).drop("ret", "n")
    return aligned.join(total, ["portfolio_id", "date"]).groupBy("portfolio_id", "ticker").agg(F.sum(F.col("prior") * F.col("weight") * F.col("ret")).alias("contribution"))


def top_contributors(contribution: DataFrame, k: int = 3) -> DataFrame:
    """The k largest positive and the k largest negative contributions of each portfolio."""
    side = F.when(F.col("contribution") > 0, "positive").when(F.col("contribution") < 0, "negative")
    df = contribution.withColumn("side", side).filter("side is not null")
    w = W.partitionBy("portfolio_id", "side").orderBy(F.abs("contribution").desc(), "ticker")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def concentration(positions: DataFrame) -> DataFrame:
    """Largest weight and sum of squares."""
    return positions.groupBy("portfolio_id").agg(F.max("weight").alias("largest_weight"), F.sum(F.col("weight") * F.col("weight")).alias("hhi"))


def overlay(bars: DataFrame, positions: DataFrame, a: str, b: str, *, gross: float = 0.02, lookback: int = 252) -> DataFrame:
    """(portfolio_id, series, return_window, volatility, max_drawdown, sessions, correlation) with half of a less half of b added."""
    if a == b:
        raise ValueError("an overlay needs two different tickers")
    two = positions.select("portfolio_id").distinct().withColumn("ticker", F.explode(F.array(F.lit(a), F.lit(b)))).withColumn("weight", F.lit(0.0))
    both = positions.select("portfolio_id", "ticker", "weight").unionByName(two).groupBy("portfolio_id", "ticker").agg(F.sum("weight").alias("weight"))
    leg = F.when(F.col("ticker") == a, 0.5 * F.col("ret")).when(F.col("ticker") == b, -0.5 * F.col("ret"))
    daily = aligned_returns(bars, both).groupBy("portfolio_id", "date").agg(F.sum(F.col("weight") * F.col("ret")).alias("base"), F.sum(leg).alias("pair"))
    daily = _tail(daily, lookback, "portfolio_id").withColumn("n", F.count("*").over(W.partitionBy("portfolio_id"))).filter("n >= 20")
    corr = daily.groupBy("portfolio_id").agg(F.when((F.stddev_samp("base") > 0) & (F.stddev_samp("pair") > 0), F.corr("base", "pair")).alias("correlation"))
    series = F.explode(F.array(*[F.struct(F.lit(name).alias("series"), c.alias("ret")) for name, c in (("base", F.col("base")), ("candidate", F.col("pair")), ("combined", F.col("base") + gross * F.col("pair")))])).alias("s")
    rows = daily.select("portfolio_id", "date", series).select("date", F.col("s.ret").alias("ret"), F.concat_ws("|", "portfolio_id", "s.series").alias("key"))
    out = summary(rows, by="key", lookback=lookback)
    return out.select(F.split("key", r"\|")[0].alias("portfolio_id"), F.split("key", r"\|")[1].alias("series"), "return_window", "volatility", "max_drawdown", "sessions").join(corr, "portfolio_id")


def relative_return(returns: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, n, difference) where both tickers' n-session returns have the same end points (J10). returns: (ticker, n, start_date, end_date, value)."""
    left = returns.withColumnsRenamed({"ticker": "a", "value": "va"})
    right = returns.withColumnsRenamed({"ticker": "b", "value": "vb"})
    return pairs.join(left, "a").join(right, ["b", "n", "start_date", "end_date"]).select("a", "b", "n", (F.col("va") - F.col("vb")).alias("difference"))


def input_fingerprint(rows: DataFrame, key: str) -> DataFrame:
    """(key, sha256) of each group's rows in canonical order."""
    names = sorted(c for c in rows.columns if c != key)
    return rows.groupBy(key).agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct(*names)))), 256).alias("input_sha256"))
