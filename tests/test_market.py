"""Detectors, market model and portfolios against pandas and by future rows that must not matter."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.operators import market, portfolio, signals


def walk(n: int, tickers=("AAA", "BBB"), seed: int = 7) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    rows = []
    for t in tickers:
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        for i, c in enumerate(close):
            rows.append((dt.date(2020, 1, 1) + dt.timedelta(days=i), t, c * 0.999, c * 1.005, c * 0.995, c, float(1000 + rng.integers(0, 200))))
    return pd.DataFrame(rows, columns=["date", "ticker", "open", "high", "low", "close", "volume"])


def test_vwap_deviation_as_in_pandas(spark):
    pdf = walk(160)
    got = signals.detect_vwap_deviations(spark.createDataFrame(pdf), threshold=1.0).toPandas()
    want = []
    for t, g in pdf.groupby("ticker"):
        g = g.sort_values("date")
        tp = (g.high + g.low + g.close) / 3
        dev = g.close / ((tp * g.volume).rolling(20).sum() / g.volume.rolling(20).sum()) - 1
        z = dev / np.sqrt((dev**2).shift(1).rolling(60).mean())
        want += [(t, d, round(v, 6)) for d, v in zip(g.date, z, strict=True) if abs(v) > 1.0]
    assert sorted(want) == sorted(zip(got.ticker, got.observed_on, got.z_score.round(6), strict=True)) and want


def test_volume_spike_and_trend_rules(spark):
    pdf = walk(60, ("AAA",))
    pdf["volume"] = [1000.0 + (i % 3) for i in range(59)] + [9000.0]
    spikes = signals.detect_volume_spikes(spark.createDataFrame(pdf)).toPandas()
    assert spikes.observed_on.tolist() == [pdf.date.iloc[-1]] and spikes.measure[0] == pytest.approx(9000 / pdf.volume[39:59].mean())
    crosses = signals.detect_trend_breaks(spark.createDataFrame(walk(200))).toPandas()
    gap = {t: (g.close.rolling(7).mean() - g.close.rolling(25).mean()).dropna() for t, g in walk(200).groupby("ticker")}
    want = sum(int(((np.sign(x) != np.sign(x).shift(1)) & (np.sign(x) != 0)).sum()) - 1 for x in gap.values())
    assert len(crosses) == want > 0 and set(crosses.kind) <= {"trend_cross", "trend_whipsaw"}


@pytest.mark.parametrize("detect", [signals.detect_vwap_deviations, signals.detect_twap_deviations, signals.detect_trend_breaks, signals.detect_volume_spikes])
def test_later_rows_change_nothing(spark, detect):
    pdf = walk(180)
    cut = dt.date(2020, 1, 1) + dt.timedelta(days=140)
    whole = detect(spark.createDataFrame(pdf)).filter(F.col("observed_on") <= F.lit(cut)).toPandas()
    part = detect(spark.createDataFrame(pdf[pdf.date <= cut])).toPandas()
    key = ["ticker", "observed_on"]
    pd.testing.assert_frame_equal(whole.sort_values(key).reset_index(drop=True), part.sort_values(key).reset_index(drop=True))


def test_abnormal_returns_as_in_pandas(spark):
    pdf = walk(80)
    bench = pdf.groupby("date").close.mean().rename("market").reset_index()
    got = market.abnormal_returns(spark.createDataFrame(pdf), spark.createDataFrame(bench), estimation=30).filter("ticker = 'AAA'").orderBy("date").toPandas()
    g = pdf[pdf.ticker == "AAA"].merge(bench, on="date").sort_values("date")
    r, m = np.log(g.close).diff(), np.log(g.market).diff()
    beta = (r.rolling(30).cov(m) / m.rolling(30).var()).shift(1)
    np.testing.assert_allclose(got.beta.to_numpy(float), beta.to_numpy(), rtol=1e-7)
    read = market.read_horizons(spark.createDataFrame(pdf), spark.createDataFrame(bench), horizons={"1w": 5, "1y": 252}, estimation=30).toPandas()
    assert set(read[read.horizon == "1w"].status) == {"available"} and set(read[read.horizon == "1y"].status) == {"unavailable"}


def test_portfolio_identities_and_alignment(spark):
    pdf = walk(40, ("AAA", "BBB", "CCC"))
    pdf = pdf[~((pdf.ticker == "BBB") & (pdf.date == dt.date(2020, 1, 11)))]
    bars = spark.createDataFrame(pdf[["date", "ticker", "close"]])
    pos = portfolio.validated_portfolio(spark.createDataFrame([("p", "AAA", 0.6), ("p", "BBB", 0.4), ("bad", "AAA", -1.0), ("short", "AAA", 0.5)], "portfolio_id string, ticker string, weight double"))
    assert {r.portfolio_id for r in pos.collect()} == {"p"}
    aligned = portfolio.aligned_returns(bars, pos)
    dates = sorted(r.date for r in aligned.select("date").distinct().collect())
    assert dates[0] == dt.date(2020, 1, 13) and len(dates) == 28  # the run after the hole in BBB
    total = portfolio.summary(portfolio.portfolio_returns(aligned), lookback=20).first()
    parts = portfolio.contributions(aligned, 20).toPandas()
    assert parts.contribution.sum() == pytest.approx(total.return_window)
    same = portfolio.summary(portfolio.portfolio_returns(portfolio.aligned_returns(portfolio.cutoff_bars(bars, "2020-01-31"), pos)))
    again = portfolio.summary(portfolio.portfolio_returns(portfolio.aligned_returns(bars.filter("date <= '2020-01-31'"), pos)))
    assert same.collect() == again.collect()
