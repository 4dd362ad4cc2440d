"""Unit-root tests, screening, frozen monitoring, point-in-time scans and outcomes."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.operators import pairs, unitroot, universe


def test_mackinnon_at_published_critical_values():
    for n, values in {1: (-3.43035, -2.86154, -2.56677), 2: (-3.89644, -3.33613, -3.04445)}.items():
        assert [unitroot.mackinnon_p(v, n) for v in values] == pytest.approx([0.01, 0.05, 0.10], abs=2e-3)


def test_unit_root_verdicts():
    rng = np.random.default_rng(1)
    noise = rng.normal(size=252)
    assert unitroot.integrated(np.cumsum(noise)) and not unitroot.integrated(noise)
    assert unitroot.adf(np.ones(50)) is None and unitroot.adf(np.array([1.0, 2.0])) is None


def series(n: int = 130, seed: int = 3) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    base = np.cumsum(rng.normal(0, 0.02, n))
    s = np.zeros(n)
    for i in range(1, n):
        s[i] = 0.4 * s[i - 1] + rng.normal(0, 0.004)
    logs = {"AAA": 1 + base + s, "BBB": 2 + base, "CCC": 3 + np.cumsum(rng.normal(0, 0.02, n))}
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(n)]
    return pd.DataFrame([("g", d, t, float(np.exp(v[i]))) for t, v in logs.items() for i, d in enumerate(days)], columns=["grp", "date", "ticker", "close"])


def test_fits_find_the_cointegrated_pair_and_blocks_agree(spark):
    bars = spark.createDataFrame(series())
    fits = pairs.fit_pairs(bars, observations=120, floor=0.5, alpha=0.05).toPandas()
    assert list(zip(fits.a, fits.b, strict=True)) == [("AAA", "BBB")] and fits.beta[0] == pytest.approx(1, abs=0.1) and fits.half_life_days[0] < 3
    r = pairs.calendar_returns(bars, 120)
    one = pairs.pair_correlation(r, least_rows=100).filter("correlation >= -1").toPandas().sort_values(["a", "b"])
    two = pairs.blocked_correlation(r, least_rows=100, floor=-1.0, block=2).toPandas().sort_values(["a", "b"])
    np.testing.assert_allclose(one.correlation, two.correlation, rtol=1e-9)
    assert list(one.n) == list(two.n)


def test_scans_ignore_later_rows_and_outcomes_only_use_them(spark):
    pdf = series()
    dates = spark.createDataFrame([(dt.date(2020, 4, 20),)], "as_of date")
    scan = lambda p: sorted((r.a, r.b, round(r.z, 9)) for r in pairs.scan_as_of(spark.createDataFrame(p), dates, observations=100, floor=0.3, alpha=0.5, entry=0.0).collect())
    later = pdf.copy()
    later.loc[later.date > dt.date(2020, 4, 20), "close"] *= 3
    assert scan(pdf) == scan(later) == scan(pdf[pdf.date <= dt.date(2020, 4, 20)]) and scan(pdf)
    signals = spark.createDataFrame([("AAA", "BBB", dt.date(2020, 4, 20), 2.0, 1.0)], "a string, b string, as_of date, z double, beta double")
    prices = spark.createDataFrame(pdf).withColumn("open", F.col("close"))
    out = pairs.forward_outcomes(signals, prices, horizons=(1, 5)).toPandas().sort_values("horizon")
    assert out.entry.tolist() == [dt.date(2020, 4, 21)] * 2 and out.return_pct.iloc[0] == pytest.approx(0)
    wide = pdf.pivot(index="date", columns="ticker", values="close")
    ra, rb = (wide[t].loc[dt.date(2020, 4, 25)] / wide[t].loc[dt.date(2020, 4, 21)] - 1 for t in ("AAA", "BBB"))
    assert out.return_pct.iloc[1] == pytest.approx(50 * (rb - ra))


def test_monitoring_uses_frozen_parameters(spark):
    fit = spark.createDataFrame([("g", "AAA", "BBB", 0.0, 1.0, 0.0, 0.1)], "grp string, a string, b string, const double, beta double, spread_mean double, spread_std double")
    spread = [0.0, 0.25, -0.1, 0.3]
    rows = [("g", dt.date(2020, 1, 1 + i), t, float(100.0 * (np.exp(s) if t == "AAA" else 1))) for i, s in enumerate(spread) for t in ("AAA", "BBB")]
    out = pairs.monitor_pairs(spark.createDataFrame(rows, "grp string, date date, ticker string, close double"), fit, start="2020-01-01", end="2020-01-04").first()
    assert (out.n_days_flagged, out.first_flag, out.direction) == (2, dt.date(2020, 1, 2), "a_rich") and out.z_score == pytest.approx(3)


def test_scan_dates_sessions_and_orders(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=2 * i) for i in range(10)]
    bars = spark.createDataFrame([(d, t) for d in days for t in ("A", "B")], "date date, ticker string")
    assert [r.as_of for r in pairs.scan_dates(bars, observations=3, after=4).orderBy("as_of").collect()] == days[3:6]
    assert pairs.scan_dates(bars, observations=6, after=4).count() == 0
    asked = spark.createDataFrame([(days[0] - dt.timedelta(days=1),), (days[2],), (days[2] + dt.timedelta(days=1),)], "asked date")
    assert [r.as_of for r in pairs.resolve_session(bars, asked).orderBy("asked").collect()] == [None, days[2], days[2]]
    fits = spark.createDataFrame([("g", "A", "B", 0.9, 0.04), ("h", "A", "B", 0.9, 0.04), ("g", "A", "C", 0.95, 0.04), ("g", "B", "C", 0.7, 0.2)], "grp string, a string, b string, correlation double, pvalue double")
    assert [(r.a, r.b) for r in pairs.ordered_fits(fits).collect()] == [("A", "C"), ("A", "B"), ("A", "B"), ("B", "C")]
    d = pairs.scan_diagnostics(bars.withColumn("grp", F.lit("g")), fits).first()
    assert (d.price_securities, d.groups_processed, d.raw_fit_count, d.eligible_fit_count) == (2, 1, 4, 2)
    signals = spark.createDataFrame([("A", "B", -3.0), ("A", "C", 3.0), ("B", "C", 1.0)], "a string, b string, z double")
    assert [(r.a, r.b, r["rank"]) for r in pairs.top_signals(signals, 2).orderBy("rank").collect()] == [("A", "B", 1), ("A", "C", 2)]


def test_groups_of_universe_and_currency(spark):
    bars = spark.createDataFrame([("A",), ("B",), ("C",)], "ticker string")
    members = spark.createDataFrame([("A", "u", None, "mapped"), ("B", "u", None, "mapped"), ("C", "u", "c", "mapped"), ("A", "v", "c", "mapped"), ("B", "v", "c", "unmapped"), ("A", "w", "c", "mapped"), ("C", "w", "c", "mapped")], "ticker string, universe string, currency string, mapping_status string")
    got = sorted((r.grp, r.ticker) for r in universe.grouped_bars(bars, members).collect())
    assert got == [("u|", "A"), ("u|", "B"), ("w|c", "A"), ("w|c", "C")]
    assert [r["group"] for r in universe.attach_group(spark.createDataFrame([("A",), ("Z",)], "ticker string"), members).orderBy("ticker").collect()] == ["u", "unknown"]


def test_a_pair_of_two_groups_is_one_signal(spark):
    pdf = series()
    two = pd.concat([pdf, pdf.assign(grp="h")])
    dates = spark.createDataFrame([(dt.date(2020, 4, 20),)], "as_of date")
    out = pairs.scan_as_of(spark.createDataFrame(two), dates, observations=100, floor=0.3, alpha=0.5, entry=0.0).collect()
    assert len(out) == len({(r.a, r.b) for r in out}) > 0 and all(r.grp.startswith("h|") for r in out)
