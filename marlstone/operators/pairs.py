"""Pairs: bounded screening by correlation, cointegration fits, monitoring with frozen parameters, outcomes.

Bars are (grp, date, ticker, close); grp is a universe and currency, so a self-join never crosses groups. Correlation runs first and
keeps a few peers a ticker; only those pairs are aligned and fitted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.plans.shared import written
from marlstone.functions.rolling import log
from marlstone.operators.unitroot import adf, integrated, mackinnon_p

NO_TICKERS = "grp string, ticker string, i1 boolean"


def formation(bars: DataFrame, as_of: str, days: int = 450) -> DataFrame:
    """Rows of the ``days`` days before as_of, that day excluded."""
    day = F.lit(as_of).cast("date")
    return bars.filter((F.col("date") >= F.date_sub(day, days)) & (F.col("date") < day))


def calendar_returns(bars: DataFrame, observations: int = 252) -> DataFrame:
    """(grp, date, ticker, r) on each group's union calendar: a missing day nulls both returns around it (A1)."""
    days = bars.select("grp", "date").distinct()
    w = W.partitionBy("grp").orderBy(F.col("date").desc())  # a row a date: small
    days = days.withColumns({"back": F.row_number().over(w), "before": F.lead("date").over(w)}).filter(F.col("back") <= observations)
    p = bars.select("grp", "date", "ticker", log(F.col("close")).alias("p"))
    now = p.join(days, ["grp", "date"])
    then = p.select("grp", F.col("date").alias("before"), "ticker", F.col("p").alias("p0"))
    return now.join(then, ["grp", "before", "ticker"]).select("grp", "date", "ticker", (F.col("p") - F.col("p0")).alias("r"))


def pair_correlation(returns: DataFrame, *, least_rows: int) -> DataFrame:
    """(grp, a, b, correlation, n) for a < b with enough common rows (A1)."""
    x, y = returns.alias("x"), returns.alias("y")
    both = x.join(y, (F.col("x.grp") == F.col("y.grp")) & (F.col("x.date") == F.col("y.date")) & (F.col("x.ticker") < F.col("y.ticker")))
    per = both.groupBy(F.col("x.grp").alias("grp"), F.col("x.ticker").alias("a"), F.col("y.ticker").alias("b")).agg(F.corr("x.r", "y.r").alias("correlation"), F.count(F.col("x.r") * F.col("y.r")).alias("n"))
    return per.filter(F.col("n") >= least_rows)


def blocked_correlation(returns: DataFrame, *, least_rows: int, floor: float, block: int = 512) -> DataFrame:
    """pair_correlation with correlation >= floor, for groups of thousands of tickers: masked matrix products of blocks of tickers."""
    dates = returns.select("grp", "date").distinct().withColumn("d", F.row_number().over(W.partitionBy("grp").orderBy("date")) - 1)
    ids = returns.select("grp", "ticker").distinct().withColumn("t", F.row_number().over(W.partitionBy("grp").orderBy("ticker")) - 1)
    blocks = F.ceil((F.max("t").over(W.partitionBy("grp")) + 1) / block).cast("int")
    ids = ids.withColumn("n", blocks).withColumn("k", F.floor(F.col("t") / block).cast("int"))
    rows = returns.join(dates, ["grp", "date"]).join(ids, ["grp", "ticker"]).groupBy("grp", "ticker", "n", "k").agg(F.collect_list(F.struct("d", "r")).alias("rs"))
    spread = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumns({"i": F.least("k", "o"), "j": F.greatest("k", "o")})

    def correlate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ticker")
        width = max((e["d"] for rs in pdf["rs"] for e in rs), default=-1) + 1
        x = np.full((len(pdf), width), np.nan)
        for row, rs in zip(x, pdf["rs"], strict=True):
            for e in rs:
                row[e["d"]] = np.nan if e["r"] is None else e["r"]
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        left, right = (np.flatnonzero(pdf["k"].to_numpy() == b) for b in (i, j))
        m, v = ~np.isnan(x), np.nan_to_num(x)
        (a, ma), (b, mb) = (v[left], m[left].astype(float)), (v[right], m[right].astype(float))
        n, sa, sb, saa, sbb, sab = ma @ mb.T, a @ mb.T, ma @ b.T, (a * a) @ mb.T, ma @ (b * b).T, a @ b.T
        with np.errstate(all="ignore"):
            c = (n * sab - sa * sb) / np.sqrt((n * saa - sa**2) * (n * sbb - sb**2))
        names = pdf["ticker"].to_numpy()
        p, q = np.nonzero((n >= least_rows) & (c >= floor) & (names[left][:, None] < names[right][None, :]))
        return pd.DataFrame({"grp": pdf["grp"].iloc[0], "a": names[left][p], "b": names[right][q], "correlation": c[p, q], "n": n[p, q].astype("int64")})

    return spread.groupBy("grp", "i", "j").applyInPandas(correlate, "grp string, a string, b string, correlation double, n long")


def top_peers(correlations: DataFrame, *, k: int = 5, floor: float = 0.5) -> DataFrame:
    """(grp, a, b, correlation), a < b: pairs that are among the k best of either ticker."""
    both = correlations.filter(F.col("correlation") >= floor)
    both = both.select("grp", "a", "b", "correlation").union(both.select("grp", F.col("b"), F.col("a"), "correlation"))
    rank = F.row_number().over(W.partitionBy("grp", "a").orderBy(F.col("correlation").desc(), "b"))
    kept = both.withColumn("_k", rank).filter(F.col("_k") <= k)
    return kept.groupBy("grp", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("correlation").alias("correlation"))


def aligned_pairs(bars: DataFrame, candidates: DataFrame, observations: int = 252) -> DataFrame:
    """(grp, a, b, date, la, lb): the last common rows of each candidate pair, in logs."""
    p = bars.select("grp", "date", "ticker", log(F.col("close")).alias("p")).filter("p is not null")
    left = candidates.select("grp", "a", "b").join(p.withColumnsRenamed({"ticker": "a", "p": "la"}), ["grp", "a"])
    both = left.join(p.withColumnsRenamed({"ticker": "b", "p": "lb"}), ["grp", "b", "date"])
    back = F.row_number().over(W.partitionBy("grp", "a", "b").orderBy(F.col("date").desc()))
    return both.withColumn("_n", back).filter(F.col("_n") <= observations).drop("_n").select("grp", "a", "b", "date", "la", "lb")


def pair_statistics(aligned: DataFrame) -> DataFrame:
    """Correlation of aligned returns, OLS of la on lb, half-life, spread mean and deviation, and the lag-0 unit-root statistic."""
    pair = W.partitionBy("grp", "a", "b")
    w = pair.orderBy("date")
    df = aligned.withColumns({"ra": F.col("la") - F.lag("la").over(w), "rb": F.col("lb") - F.lag("lb").over(w), "beta": F.regr_slope("la", "lb").over(pair), "const": F.regr_intercept("la", "lb").over(pair)})
    df = df.withColumn("s", F.col("la") - F.col("const") - F.col("beta") * F.col("lb"))
    df = df.withColumn("s1", F.lag("s").over(w)).withColumn("ds", F.col("s") - F.col("s1"))
    out = df.groupBy("grp", "a", "b").agg(
        F.count("*").alias("nobs"), F.corr("ra", "rb").alias("correlation"), F.first("beta").alias("beta"), F.first("const").alias("const"), F.regr_slope("ds", "s1").alias("pull"),
        F.avg("s").alias("spread_mean"), F.stddev_samp("s").alias("spread_std"), F.sum(F.col("ds") * F.col("s1")).alias("_xy"), F.sum(F.col("s1") * F.col("s1")).alias("_xx"), F.sum(F.col("ds") * F.col("ds")).alias("_yy"), F.count("ds").alias("_n"),
    )
    slope = F.try_divide("_xy", "_xx")
    error = F.sqrt(F.try_divide(F.greatest(F.lit(0.0), F.col("_yy") - slope * F.col("_xy")), (F.col("_n") - 1) * F.col("_xx")))
    half = F.when(F.col("pull") < 0, -F.ln(F.lit(2.0)) / F.col("pull"))
    return out.withColumns({"half_life_days": half, "df_stat": F.try_divide(slope, F.when(error > 0, error))}).drop("_xy", "_xx", "_yy", "_n", "pull")


def integrated_tickers(bars: DataFrame, observations: int = 252) -> DataFrame:
    """(grp, ticker, i1) by unit-root tests of the last log closes, once a ticker."""
    back = F.row_number().over(W.partitionBy("grp", "ticker").orderBy(F.col("date").desc()))
    rows = bars.select("grp", "ticker", "date", log(F.col("close")).alias("p")).filter("p is not null").withColumn("_n", back).filter(F.col("_n") <= observations)

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1][["grp", "ticker"]].assign(i1=integrated(pdf.sort_values("date")["p"].to_numpy()))

    return rows.select("grp", "ticker", "date", "p").groupBy("grp", "ticker").applyInPandas(test, NO_TICKERS)


def cointegrated(aligned: DataFrame) -> DataFrame:
    """(grp, a, b, adf_stat, adf_lags, pvalue): Engle-Granger on each aligned pair."""

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        x, y = pdf["lb"].to_numpy(), pdf["la"].to_numpy()
        design = np.column_stack([np.ones(len(x)), x])
        r = adf(y - design @ np.linalg.lstsq(design, y, rcond=None)[0], constant=False) if len(x) > 3 else None
        out = pdf.iloc[:1][["grp", "a", "b"]]
        return out.assign(adf_stat=r[0] if r else None, adf_lags=r[1] if r else None, pvalue=mackinnon_p(r[0], 2) if r else None)[: 1 if r else 0]

    return aligned.groupBy("grp", "a", "b").applyInPandas(test, "grp string, a string, b string, adf_stat double, adf_lags long, pvalue double")


def fit_pairs(bars: DataFrame, *, observations: int = 252, floor: float = 0.5, alpha: float = 0.1, peers: int = 5) -> DataFrame:
    """Frozen fits: screen, I(1) gate, exact correlation, cointegration, spread (C4). Order is the caller's (p, -correlation, a, b: T1)."""
    peers_ = top_peers(pair_correlation(calendar_returns(bars, observations), least_rows=observations - 2), k=peers, floor=floor)
    good = integrated_tickers(bars, observations).filter("i1").select("grp", "ticker")
    peers_ = peers_.join(good.withColumnRenamed("ticker", "a"), ["grp", "a"], "left_semi").join(good.withColumnRenamed("ticker", "b"), ["grp", "b"], "left_semi")
    aligned = written(aligned_pairs(bars, peers_, observations), "aligned")  # read by both branches below
    fits = pair_statistics(aligned).join(cointegrated(aligned), ["grp", "a", "b"])
    return fits.filter((F.col("nobs") == observations) & (F.col("correlation") >= floor) & (F.col("pvalue") < alpha) & (F.col("spread_std") > 0))


def eligible_fits(fits: DataFrame, least: float, alpha: float) -> DataFrame:
    """Fits above a correlation and below a p-value."""
    return fits.filter((F.col("correlation") >= least) & (F.col("pvalue") < alpha))


def spread_z(bars: DataFrame, fits: DataFrame) -> DataFrame:
    """(grp, a, b, date, z) of each fit with its frozen parameters."""
    p = bars.select("grp", "date", "ticker", log(F.col("close")).alias("p")).filter("p is not null")
    both = fits.join(p.withColumnsRenamed({"ticker": "a", "p": "la"}), ["grp", "a"]).join(p.withColumnsRenamed({"ticker": "b", "p": "lb"}), ["grp", "b", "date"])
    z = (F.col("la") - F.col("const") - F.col("beta") * F.col("lb") - F.col("spread_mean")) / F.col("spread_std")
    return both.select("grp", "a", "b", "date", z.alias("z"))


def monitor_pairs(bars: DataFrame, fits: DataFrame, *, start: str, end: str, entry: float = 2.0) -> DataFrame:
    """Pairs with a day of abs z over ``entry`` in the window; direction by the last z."""
    z = spread_z(bars, fits).filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    hot = F.abs("z") > entry
    per = z.groupBy("grp", "a", "b").agg(
        F.min("date").alias("window_start"), F.max("date").alias("window_end"), F.min(F.when(hot, F.col("date"))).alias("first_flag"), F.count_if(hot).alias("n_days_flagged"), F.max_by("z", "date").alias("z_score"), F.max(F.abs("z")).alias("max_abs_z"),
    )
    side = F.when(F.col("z_score") > 0, "a_rich").otherwise("b_rich")
    return per.filter("n_days_flagged > 0").withColumns({"direction": side, "anomaly_id": F.concat_ws("-", F.lit("PAIR"), "a", "b", F.col("window_end").cast("string"))})


def pair_positions(bars: DataFrame, fits: DataFrame, *, entry: float = 2.0) -> DataFrame:
    """(date, short, long) for each flagged pair and day."""
    z = spread_z(bars, fits).filter(F.abs("z") > entry)
    return z.select("date", F.when(F.col("z") > 0, F.col("a")).otherwise(F.col("b")).alias("short"), F.when(F.col("z") > 0, F.col("b")).otherwise(F.col("a")).alias("long"))


def scan_dates(bars: DataFrame, *, observations: int = 252, after: int = 20) -> DataFrame:
    """(as_of): sessions with at least ``observations`` sessions strictly before and ``after`` later ones (F5, C8). Only the calendar is ordered."""
    w = W.orderBy("date")
    days = bars.select("date").distinct().withColumns({"_before": F.row_number().over(w) - 1, "_all": F.count("*").over(W.partitionBy())})
    return days.filter((F.col("_before") >= observations) & (F.col("_all") - F.col("_before") - 1 >= after)).select(F.col("date").alias("as_of"))


def resolve_session(bars: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, as_of): the latest session at or before each asked date; null if there is none."""
    sessions = bars.select(F.col("date").alias("d"), F.col("date").alias("s"), F.lit(None).cast("date").alias("asked")).distinct()
    both = sessions.unionByName(asked.select(F.col("asked").alias("d"), F.lit(None).cast("date").alias("s"), "asked").distinct())
    w = W.orderBy("d", F.col("s").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("as_of", F.last("s", ignorenulls=True).over(w)).filter("asked is not null").select("asked", "as_of")


def scan_as_of(bars: DataFrame, dates: DataFrame, *, days: int = 450, observations: int = 252, floor: float = 0.5, alpha: float = 0.1, peers: int = 5, entry: float = 2.0) -> DataFrame:
    """Fits on each date's formation window and z on the date itself, all dates in one job: the date becomes part of the group.

    dates: (as_of). No row after a date takes part in its result. A pair of several groups is kept once a date, that of the last group (U5).
    """
    window = dates.select("as_of", F.explode(F.sequence(F.date_sub("as_of", days), F.col("as_of"))).alias("date"))
    held = bars.join(window, "date").withColumn("grp", F.concat_ws("|", "grp", F.col("as_of").cast("string")))
    fits = fit_pairs(held.filter("date < as_of").select("grp", "date", "ticker", "close"), observations=observations, floor=floor, alpha=alpha, peers=peers)
    z = spread_z(held.filter("date = as_of").select("grp", "date", "ticker", "close"), fits).filter(F.abs("z") > entry)
    found = z.join(fits, ["grp", "a", "b"]).withColumnRenamed("date", "as_of")
    rest = [c for c in found.columns if c not in ("as_of", "a", "b")]
    return found.groupBy("as_of", "a", "b").agg(F.max_by(F.struct(*rest), "grp").alias("_s")).select("as_of", "a", "b", *[F.col(f"_s.{c}").alias(c) for c in rest])


def ordered_fits(fits: DataFrame) -> DataFrame:
    """Fits by p-value, then falling correlation, then names."""
    return fits.orderBy("pvalue", F.col("correlation").desc(), "a", "b")


def top_signals(signals: DataFrame, k: int = 50) -> DataFrame:
    """The k signals of the largest abs z, then by names, with their rank."""
    kept = signals.orderBy(F.abs("z").desc(), "a", "b").limit(k)
    return kept.withColumn("rank", F.row_number().over(W.orderBy(F.abs("z").desc(), "a", "b")))


def scan_diagnostics(bars: DataFrame, fits: DataFrame, *, least: float = 0.65, alpha: float = 0.05) -> DataFrame:
    """One row: price_securities, groups_processed, raw_fit_count, eligible_fit_count (A11); a pair of several groups counts once as eligible."""
    priced = bars.agg(F.countDistinct("ticker").alias("price_securities"), F.countDistinct("grp").alias("groups_processed"))
    pair = F.when((F.col("correlation") >= least) & (F.col("pvalue") < alpha), F.struct("a", "b"))
    counted = fits.agg(F.count("*").alias("raw_fit_count"), F.countDistinct(pair).alias("eligible_fit_count"))
    return priced.join(counted)


def next_open_entry(signals: DataFrame, prices: DataFrame) -> DataFrame:
    """Signals with the first later date on which both legs have an open and a close (J7). prices: (date, ticker, open, close)."""
    p = prices.filter("open > 0 and close > 0").select("date", "ticker")
    both = signals.join(p.withColumnRenamed("ticker", "a"), "a").filter("date > as_of").join(p.withColumnRenamed("ticker", "b"), ["b", "date"])
    return both.groupBy(*signals.columns).agg(F.min("date").alias("entry"))


def forward_outcomes(signals: DataFrame, prices: DataFrame, *, horizons: tuple[int, ...] = (1, 5, 10, 20), cost_bps: float = 0.0) -> DataFrame:
    """(a, b, as_of, entry, horizon, date, return_pct, drawdown_pct): marked returns after entry at the next open.

    signals: (a, b, as_of, z, beta); weights -1 and beta (or +1 and -beta for a z below 0) over their gross. Labels stay apart from signals: they
    are hindsight. Horizons beyond the data are left out.
    """
    s = next_open_entry(signals, prices)
    opened = prices.select(F.col("date").alias("entry"), "ticker", "open")
    s = s.join(opened.withColumnsRenamed({"ticker": "a", "open": "oa"}), ["a", "entry"]).join(opened.withColumnsRenamed({"ticker": "b", "open": "ob"}), ["b", "entry"])
    side, gross = -F.signum("z"), 1 + F.abs("beta")
    s = s.withColumns({"wa": side / gross, "wb": -side * F.col("beta") / gross})
    p = prices.filter("close > 0").select("date", "ticker", "close")
    m = s.join(p.withColumnsRenamed({"ticker": "a", "close": "ca"}), "a").filter("date >= entry").join(p.withColumnsRenamed({"ticker": "b", "close": "cb"}), ["b", "date"])
    value = F.col("wa") * (F.col("ca") / F.col("oa") - 1) + F.col("wb") * (F.col("cb") / F.col("ob") - 1) - cost_bps / 1e4
    w = W.partitionBy("a", "b", "as_of").orderBy("date")
    m = m.withColumns({"path": value, "horizon": F.row_number().over(w)})
    m = m.withColumn("peak", F.greatest(F.lit(0.0), F.max("path").over(w)))
    m = m.withColumn("drawdown", F.min(F.col("path") - F.col("peak")).over(w))
    return m.filter(F.col("horizon").isin(*horizons)).select("a", "b", "as_of", "entry", "horizon", "date", (F.col("path") * 100).alias("return_pct"), (F.col("drawdown") * 100).alias("drawdown_pct"))
