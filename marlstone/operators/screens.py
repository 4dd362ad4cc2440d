"""Pair screens: complete cases of a window, and point-in-time scans of many dates by rolling cross-moments.

Bars are (grp, date, ticker, close). A scan of many dates copies no bar a date: returns don't depend on the window, so correlations of all
windows come from sums of x, y, xx, yy, xy that move on by a date at a time, in blocks of tickers; and a pair that any date needs is aligned once, its dates
being slices of that one series.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions.rolling import log
from marlstone.operators.pairs import cointegrated, pair_statistics
from marlstone.operators.unitroot import adf, integrated, mackinnon_p
from marlstone.plans.shared import written


def _blocked(rows: DataFrame, block: int) -> DataFrame:
    """rows (grp, ticker, ...), each for every pair (i, j) of its ticker's block k with another one."""
    ids = rows.select("grp", "ticker").distinct().withColumn("t", F.row_number().over(W.partitionBy("grp").orderBy("ticker")) - 1)
    ids = ids.withColumn("n", F.ceil((F.max("t").over(W.partitionBy("grp")) + 1) / block).cast("int")).withColumn("k", F.floor(F.col("t") / block).cast("int")).drop("t")
    spread = rows.join(ids, ["grp", "ticker"]).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return spread.withColumns({"i": F.least("k", "o"), "j": F.greatest("k", "o")}).drop("n", "o")


def complete_cases(bars: DataFrame, start: str, end: str) -> DataFrame:
    """(grp, ticker, date, p): log closes of the tickers that have a close on each of their group's dates between start and end, both included.

    A price that isn't above 0 among them is an error, as logarithms need. Missing dates are found by counts, not by a wide table.
    """
    held = bars.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & F.col("close").isNotNull() & ~F.isnan("close"))
    days = held.groupBy("grp").agg(F.countDistinct("date").alias("days"))
    whole = held.groupBy("grp", "ticker").agg(F.countDistinct("date").alias("days")).join(days, ["grp", "days"]).select("grp", "ticker")
    price = F.when(F.col("close") > 0, F.col("close")).otherwise(F.raise_error(F.lit("a complete-case screen needs prices above 0")).cast("double"))
    return held.join(whole, ["grp", "ticker"], "left_semi").select("grp", "ticker", "date", F.ln(price).alias("p"))


def complete_correlation(cases: DataFrame, *, floor: float = 0.7, block: int = 512) -> DataFrame:
    """(grp, a, b, correlation) of log returns of all pairs a < b at ``floor`` or above: with no date missing, a product of blocks of standardised returns."""
    series = cases.groupBy("grp", "ticker").agg(F.transform(F.sort_array(F.collect_list(F.struct("date", "p"))), lambda s: s["p"]).alias("ps"))

    def correlate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ticker")
        r = np.diff(np.stack(pdf["ps"].to_numpy()), axis=1)
        r = r - r.mean(axis=1, keepdims=True)
        size = np.sqrt((r * r).sum(axis=1, keepdims=True))
        r = np.divide(r, size, out=np.full_like(r, np.nan), where=size > 0)
        left, right = (np.flatnonzero(pdf["k"].to_numpy() == b) for b in (pdf["i"].iloc[0], pdf["j"].iloc[0]))
        c, names = r[left] @ r[right].T, pdf["ticker"].to_numpy()
        p, q = np.nonzero((c >= floor) & (names[left][:, None] < names[right][None, :]))
        return pd.DataFrame({"grp": pdf["grp"].iloc[0], "a": names[left][p], "b": names[right][q], "correlation": c[p, q]})

    return _blocked(series.filter(F.size("ps") > 2), block).groupBy("grp", "i", "j").applyInPandas(correlate, "grp string, a string, b string, correlation double")


def screen_pairs(bars: DataFrame, start: str, end: str, *, floor: float = 0.7, alpha: float = 0.01) -> DataFrame:
    """Fits of all pairs of complete cases with correlation ``floor`` or more and a cointegration p below ``alpha`` (C3); both tickers have to be I(1). Order is the caller's (pvalue)."""
    cases = written(complete_cases(bars, start, end), "cases")

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1][["grp", "ticker"]].assign(i1=integrated(pdf.sort_values("date")["p"].to_numpy()))

    pairs = complete_correlation(cases, floor=floor)
    some = pairs.select("grp", F.explode(F.array("a", "b")).alias("ticker")).distinct()
    good = cases.join(some, ["grp", "ticker"], "left_semi").groupBy("grp", "ticker").applyInPandas(test, "grp string, ticker string, i1 boolean").filter("i1").select("grp", "ticker")
    for end_ in ("a", "b"):
        pairs = pairs.join(good.withColumnRenamed("ticker", end_), ["grp", end_], "left_semi")
    both = pairs.select("grp", "a", "b").join(cases.withColumnsRenamed({"ticker": "a", "p": "la"}), ["grp", "a"]).join(cases.withColumnsRenamed({"ticker": "b", "p": "lb"}), ["grp", "b", "date"])
    aligned = written(both.select("grp", "a", "b", "date", "la", "lb"), "aligned")
    fits = pair_statistics(aligned).join(cointegrated(aligned), ["grp", "a", "b"])
    return fits.filter((F.col("pvalue") < alpha) & (F.col("spread_std") > 0))


def calendar(bars: DataFrame) -> DataFrame:
    """(grp, date, d): each group's sessions, numbered from 0. One row a session."""
    return bars.select("grp", "date").distinct().withColumn("d", (F.row_number().over(W.partitionBy("grp").orderBy("date")) - 1).cast("int"))


def session_returns(bars: DataFrame, days: DataFrame) -> DataFrame:
    """(grp, ticker, d, r): log returns between sessions that follow each other in the group's calendar."""
    p = bars.select("grp", "date", "ticker", log(F.col("close")).alias("p")).filter("p is not null").join(days, ["grp", "date"])
    then = p.select("grp", "ticker", (F.col("d") + 1).alias("d"), F.col("p").alias("p0"))
    return p.join(then, ["grp", "ticker", "d"]).select("grp", "ticker", "d", (F.col("p") - F.col("p0")).alias("r"))


def windows(days: DataFrame, dates: DataFrame, *, observations: int = 252, longest: int = 450) -> DataFrame:
    """(grp, as_of, low, high): the sessions low to high - 1 of a group, the last ``observations`` before as_of and within ``longest`` days of it. Only the calendar is joined."""
    past = days.join(dates, (F.col("date") < F.col("as_of")) & (F.col("date") >= F.date_sub("as_of", longest)))
    w = past.groupBy("grp", "as_of").agg(F.min("d").alias("first"), (F.max("d") + 1).alias("high"))
    return w.select("grp", "as_of", F.greatest(F.col("first"), F.col("high") - observations).alias("low"), "high")


def rolling_correlation(returns: DataFrame, window: DataFrame, *, least_rows: int, floor: float, block: int = 256) -> DataFrame:
    """(grp, as_of, a, b, correlation, n) for a < b: correlations of the returns that both tickers have in each window, at ``floor`` or above (A1 for many dates).

    A block pair's task has its tickers' returns once and moves the sums from window to window, adding sessions that come in and taking off those that go
    out; every ``refresh`` sessions they are summed anew, so that rounding doesn't pile up.
    """
    series = returns.groupBy("grp", "ticker").agg(F.collect_list(F.struct("d", "r")).alias("rs"))
    spans = window.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("as_of", "low", "high"))).alias("spans"))
    refresh = 256

    def correlate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ticker")
        spans_ = [(s["as_of"], s["low"], s["high"]) for s in pdf["spans"].iloc[0]]
        width = max([*(e["d"] for rs in pdf["rs"] for e in rs), *(s[2] for s in spans_)]) + 1
        x = np.full((width, len(pdf)), np.nan)
        for t, rs in enumerate(pdf["rs"]):
            for e in rs:
                x[e["d"], t] = e["r"]
        left, right = (np.flatnonzero(pdf["k"].to_numpy() == b) for b in (pdf["i"].iloc[0], pdf["j"].iloc[0]))
        m, v = (~np.isnan(x)).astype(float), np.nan_to_num(x)
        a, ma, b, mb = v[:, left], m[:, left], v[:, right], m[:, right]
        pairs_of = [(ma, mb), (a, mb), (ma, b), (a * a, mb), (ma, b * b), (a, b)]
        summed = lambda lo, hi: [p[lo:hi].T @ q[lo:hi] for p, q in pairs_of]
        names, found = pdf["ticker"].to_numpy(), []
        ordered = names[left][:, None] < names[right][None, :]
        at, sums, age = (0, 0), summed(0, 0), 0
        for as_of, low, high in spans_:
            if low >= at[1] or low < at[0] or age > refresh:
                sums, age = summed(low, high), 0
            else:
                for s, more, less in zip(sums, summed(at[1], high), summed(at[0], low), strict=True):
                    s += more - less
                age += high - at[1]
            at = (low, high)
            n, sa, sb, saa, sbb, sab = sums
            with np.errstate(all="ignore"):
                c = (n * sab - sa * sb) / np.sqrt((n * saa - sa**2) * (n * sbb - sb**2))
            p, q = np.nonzero((np.rint(n) >= least_rows) & (c >= floor) & ordered)
            found.append(pd.DataFrame({"grp": pdf["grp"].iloc[0], "as_of": as_of, "a": names[left][p], "b": names[right][q], "correlation": c[p, q], "n": np.rint(n[p, q]).astype("int64")}))
        return pd.concat(found)

    rows = _blocked(series, block).join(spans, "grp")
    return rows.groupBy("grp", "i", "j").applyInPandas(correlate, "grp string, as_of date, a string, b string, correlation double, n long")


_FIT = "grp string, a string, b string, as_of date, nobs long, correlation double, beta double, const double, half_life_days double, spread_mean double, spread_std double, adf_stat double, adf_lags long, pvalue double, z double"


def _fitted(la: np.ndarray, lb: np.ndarray) -> dict | None:
    """The fit of one window of two aligned log series."""
    if len(la) < 4 or np.ptp(lb) == 0:
        return None
    beta = np.cov(la, lb)[0, 1] / np.var(lb, ddof=1)
    const = la.mean() - beta * lb.mean()
    s = la - const - beta * lb
    r = adf(s, constant=False)
    if r is None:
        return None
    ds, s1 = np.diff(s), s[:-1]
    pull = np.cov(ds, s1)[0, 1] / np.var(s1, ddof=1) if np.ptp(s1) > 0 else np.nan
    with np.errstate(all="ignore"):
        correlation = np.corrcoef(np.diff(la), np.diff(lb))[0, 1]
    return {"nobs": len(la), "correlation": correlation, "beta": beta, "const": const, "half_life_days": -np.log(2) / pull if pull < 0 else None, "spread_mean": s.mean(), "spread_std": s.std(ddof=1), "adf_stat": r[0], "adf_lags": r[1], "pvalue": mackinnon_p(r[0], 2)}


def window_fits(bars: DataFrame, wanted: DataFrame, *, observations: int = 252, longest: int = 450) -> DataFrame:
    """The fit of each wanted (grp, as_of, a, b) on the pair's last common sessions before as_of, and z on as_of itself.

    A pair is aligned once, over all dates; each date's window is a slice of it. No row after a date takes part in its fit.
    """
    asked = wanted.groupBy("grp", "a", "b").agg(F.sort_array(F.collect_set("as_of")).alias("dates"))
    p = bars.select("grp", "date", "ticker", log(F.col("close")).alias("p")).filter("p is not null")
    both = asked.select("grp", "a", "b").join(p.withColumnsRenamed({"ticker": "a", "p": "la"}), ["grp", "a"]).join(p.withColumnsRenamed({"ticker": "b", "p": "lb"}), ["grp", "b", "date"])
    series = both.groupBy("grp", "a", "b").agg(F.sort_array(F.collect_list(F.struct("date", "la", "lb"))).alias("rows")).join(asked, ["grp", "a", "b"])

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in _FIT.split(", ")]
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                days = np.array([r["date"] for r in row.rows], dtype="datetime64[D]")
                la, lb = (np.array([r[k] for r in row.rows]) for k in ("la", "lb"))
                for as_of in row.dates:
                    day = np.datetime64(as_of, "D")
                    high = int(np.searchsorted(days, day))
                    low = max(int(np.searchsorted(days, np.datetime64(as_of - timedelta(days=longest), "D"))), high - observations)
                    found = _fitted(la[low:high], lb[low:high])
                    if found:
                        on_day = high < len(days) and days[high] == day and found["spread_std"] > 0
                        z = (la[high] - found["const"] - found["beta"] * lb[high] - found["spread_mean"]) / found["spread_std"] if on_day else None
                        out.append({"grp": row.grp, "a": row.a, "b": row.b, "as_of": as_of, **found, "z": z})
            yield pd.DataFrame(out, columns=columns)

    return series.mapInPandas(fit, _FIT)


def integrated_at(bars: DataFrame, wanted: DataFrame, *, observations: int = 252, longest: int = 450) -> DataFrame:
    """(grp, ticker, as_of) of the wanted ones whose last log closes before as_of are I(1) (C1): a ticker's series is read once for all dates."""
    asked = wanted.groupBy("grp", "ticker").agg(F.sort_array(F.collect_set("as_of")).alias("dates"))
    p = bars.select("grp", "date", "ticker", log(F.col("close")).alias("p")).filter("p is not null")
    series = p.join(asked.select("grp", "ticker"), ["grp", "ticker"], "left_semi").groupBy("grp", "ticker").agg(F.sort_array(F.collect_list(F.struct("date", "p"))).alias("rows")).join(asked, ["grp", "ticker"])

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                days, values = np.array([r["date"] for r in row.rows], dtype="datetime64[D]"), np.array([r["p"] for r in row.rows])
                for as_of in row.dates:
                    high = int(np.searchsorted(days, np.datetime64(as_of, "D")))
                    low = max(int(np.searchsorted(days, np.datetime64(as_of - timedelta(days=longest), "D"))), high - observations)
                    if integrated(values[low:high]):
                        out.append((row.grp, row.ticker, as_of))
            yield pd.DataFrame(out, columns=["grp", "ticker", "as_of"])

    return series.mapInPandas(test, "grp string, ticker string, as_of date")


def universe_fits(bars: DataFrame, dates: DataFrame, *, observations: int = 252, longest: int = 450, floor: float = 0.5, alpha: float = 0.1, peers: int = 5) -> DataFrame:
    """Frozen fits of every group and date in one job (C5): the best ``peers`` of each ticker by rolling correlation, both tickers I(1), then exact fits. Columns as ``window_fits``."""
    days = written(calendar(bars), "calendar")
    window = written(windows(days, dates, observations=observations, longest=longest), "windows")
    near = rolling_correlation(session_returns(bars, days), window, least_rows=observations - 2, floor=floor)
    both = near.select("grp", "as_of", "a", "b", "correlation").union(near.select("grp", "as_of", "b", "a", "correlation"))
    rank = F.row_number().over(W.partitionBy("grp", "as_of", "a").orderBy(F.col("correlation").desc(), "b"))
    kept = both.withColumn("_k", rank).filter(F.col("_k") <= peers).select("grp", "as_of", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    kept = written(kept, "peers")
    good = written(integrated_at(bars, kept.select("grp", "as_of", F.explode(F.array("a", "b")).alias("ticker")), observations=observations, longest=longest), "integrated")
    for end in ("a", "b"):
        kept = kept.join(good.withColumnRenamed("ticker", end), ["grp", "as_of", end], "left_semi")
    fits = window_fits(bars, kept, observations=observations, longest=longest)
    return fits.filter((F.col("nobs") == observations) & (F.col("correlation") >= floor) & (F.col("pvalue") < alpha) & (F.col("spread_std") > 0))


def scan_history(bars: DataFrame, dates: DataFrame, *, least: float = 0.65, most: float = 0.05, entry: float = 1.5, **options) -> DataFrame:
    """Signals of every date: fits of its formation that are eligible (F7: ``least`` correlation, p below ``most``) and whose abs z on the date is over ``entry``.

    A pair of several groups counts once a date, with the fit of the last group (U5). The defaults are the reference's.
    """
    if not (0 <= least <= 1 and 0 < most <= 1 and entry > 0):
        raise ValueError("least is within [0, 1], most within (0, 1], entry above 0")
    fits = universe_fits(bars, dates, **options)
    rest = [c for c in fits.columns if c not in ("as_of", "a", "b")]
    one = fits.groupBy("as_of", "a", "b").agg(F.max_by(F.struct(*rest), "grp").alias("s")).select("as_of", "a", "b", "s.*")
    return one.filter((F.col("correlation") >= least) & (F.col("pvalue") < most) & (F.abs("z") > entry))


def newest_with_signals(signals: DataFrame, k: int = 5) -> DataFrame:
    """The signals of the k latest dates that have any, with ``date_rank`` from 1 (C8). Dates are ranked by themselves, a row each."""
    dates = signals.select("as_of").distinct().withColumn("date_rank", F.row_number().over(W.orderBy(F.col("as_of").desc()))).filter(F.col("date_rank") <= k)
    return signals.join(dates, "as_of")
