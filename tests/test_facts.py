"""Filed facts: balances, trends; fits kept by date."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from marlstone.operators import fundamentals
from marlstone.sources import readers

FACT = "ticker string, concept string, tag string, alias_rank int, unit string, period_start date, period_end date, value double, form string, filed_at date, accession string"


def test_balances_are_selected(spark):
    end, filed = dt.date(2020, 12, 31), dt.date(2021, 2, 1)
    rows = [("A", c, c, 0, "USD", None, end, 1.0, "10-K", filed, "x") for c in ("inventory", "accounts_receivable", "accounts_payable", "cash")]
    got = fundamentals.select_facts(spark.createDataFrame(rows, FACT), "2021-12-31").collect()
    assert sorted(r.concept for r in got) == ["accounts_payable", "accounts_receivable", "cash", "inventory"]


def test_trends_need_whole_series_and_positive_debt(spark):
    ends = [dt.date(2017 + k, 12, 31) for k in range(4)]
    rows = [("whole", "roic", e, 0.1 + 0.01 * k) for k, e in enumerate(ends)] + [("gap", "roic", e, 0.1) for e in (ends[0], *ends[2:])] + [("gap", "roic", dt.date(2022, 12, 31), 0.1)]
    rows += [("debt", "net_debt", e, 100.0 + 50 * k) for k, e in enumerate(ends)] + [("credit", "net_debt", e, -5.0 + 10 * k) for k, e in enumerate(ends)]
    rows += [("short", "roic", e, 0.1) for e in ends[:2]] + [("other", "asset_turnover", e, 0.1) for e in ends]
    got = {(r.ticker, r.metric): (round(r.value, 6), r.unit, r.points) for r in fundamentals.metric_trends(spark.createDataFrame(rows, "ticker string, metric string, period_end date, value double")).collect()}
    assert got == {("whole", "roic"): (300.0, "bps", 4), ("debt", "net_debt"): (150.0, "percent", 4)}


def test_fits_of_other_dates_stay(spark, tmp_path):
    fits = lambda d, v: spark.createDataFrame([(d, "A", "B", "g", v)], "as_of date, a string, b string, grp string, beta double")
    path, one, two = str(tmp_path / "fits"), dt.date(2020, 1, 1), dt.date(2020, 2, 1)
    for d, v in ((one, 1.0), (two, 2.0), (two, 3.0)):
        readers.write_pair_fits(fits(d, v), path)
    assert [(r.as_of, r.beta) for r in spark.read.parquet(path).orderBy("as_of").collect()] == [(one, 1.0), (two, 3.0)]
    assert readers.read_pair_fits(spark, path, "2020-01-01").filter(F.col("beta") == 1).count() == 1
