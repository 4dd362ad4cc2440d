"""Readers, writers and small selections."""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import functions as F

from marlstone.operators import selection
from marlstone.sources import readers


def test_readers(spark, tmp_path):
    (tmp_path / "p.csv").write_text("ticker,date,close,volume\nA,2024-01-02,1.5,10\nB,bad,2,\n")
    assert [(r.ticker, r.date, r.close) for r in readers.read_prices(spark, str(tmp_path / "p.csv")).orderBy("ticker").collect()] == [("A", dt.date(2024, 1, 2), 1.5), ("B", None, 2.0)]
    (tmp_path / "t.txt").write_text("# Energy · 2\nxom\n\ncvx\n# Banks\n jpm \nXOM\n")
    assert sorted(r.ticker for r in readers.read_tickers(spark, str(tmp_path / "t.txt")).collect()) == ["CVX", "JPM", "XOM"]
    assert sorted((r.ticker, r.sector) for r in readers.read_universe_text(spark, str(tmp_path / "t.txt")).collect()) == [("CVX", "Energy"), ("JPM", "Banks"), ("XOM", "Banks"), ("XOM", "Energy")]
    (tmp_path / "news").mkdir()
    (tmp_path / "news" / "AXP.jsonl").write_text('{"id":"1","title":"Up!","url":"https://x/1","published_at":"2024-01-05T08:00:00Z"}\n{"id":"2","title":"UP","url":"https://x/2","published_at":"2024-01-05T09:00:00Z"}\nnot json\n{"id":"3","title":"Late","url":"https://x/3","published_at":"2024-01-06"}\n{"id":"4","title":"x","url":"ftp://x","published_at":"2024-01-05"}\n')
    read = lambda **k: sorted((r.ticker, r.id, r.hindsight) for r in readers.read_news_archive(spark, str(tmp_path / "news"), "2024-01-06 12:00:00", **k).collect())
    assert read() == [("AXP", "1", False)] and read(include_hindsight=True) == [("AXP", "1", False), ("AXP", "2", False), ("AXP", "3", True)]
    wide = spark.createDataFrame([(dt.date(2024, 1, 2), 1.0, 1.0, 1.0, 1.0, 5.0, 2.0)], "date date, A_open double, A_high double, A_low double, A_close double, A_volume double, B_close double")
    bars = readers.normalize_bars(wide, ["A", "B"])
    assert [(r.ticker, r.close) for r in bars.collect()] == [("A", 1.0)] and readers.dataset_manifest(bars, "p", "2024-01-01", "2024-02-01").first().row_count == 1


def test_fit_cache_and_selections(spark, tmp_path):
    fits = spark.createDataFrame([(dt.date(2024, 1, 1), "A", "B", g, 1.0) for g in ("y", "x")], "as_of date, a string, b string, grp string, beta double")
    readers.write_pair_fits(fits, str(tmp_path / "fits"))
    assert [r.groups for r in readers.read_pair_fits(spark, str(tmp_path / "fits"), "2024-01-01").collect()] == [["x", "y"]]
    an = spark.createDataFrame([("A", "B", 2.0, 0.7, 0.01), ("A", "C", -3.0, 0.7, 0.01), ("B", "C", 4.0, 0.7, 0.2)], "a string, b string, z double, correlation double, pvalue double")
    tick = spark.createDataFrame([("A",), ("B",), ("C",)], "ticker string")
    assert [(r.a, r.b) for r in selection.discovery_candidates(an, tick, tick.filter("ticker = 'C'")).orderBy("rank").collect()] == [("A", "B"), ("A", "C")]
    row = spark.createDataFrame([("Supply--Chain of!", None)], "t string, n string").select(selection.relation_label(F.col("t")).alias("l"), selection.stable_id("FIN", F.lit("T"), F.col("n")).alias("i")).first()
    assert row.l == "supply_chain_of" and row.i == "FIN-" + hashlib.sha256(b"T|None").hexdigest()[:20]
    docs = spark.createDataFrame([(1, 1, "Acme news", "Acme and Acme", 3, None), (1, 2, "Other", "Acme Bolt", 3, None)], "investigation_id int, document_id int, title string, text string, priority int, published_at timestamp")
    ents = spark.createDataFrame([(1, "Acme"), (1, "Bolt")], "investigation_id int, entity string")
    assert [(r.document_id, r.entities, r.mentions) for r in selection.select_documents(docs, ents, 5).orderBy("rank").collect()] == [(2, 2, 2), (1, 1, 3)]
