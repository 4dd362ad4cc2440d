"""Market context of securities as of a date, as rows and as parts of a graph; portfolios in one job; events of pair anomalies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.operators.portfolio import LONGEST_GAP, aligned_returns, concentration, contributions, portfolio_returns, sessions, summary

#: The sessions of returns that a context has, those that are compared, and those that a graph shows.
SPANS, COMPARED, SHOWN = (1, 5, 20, 63, 252), (20, 63), (1, 5, 20, 63)


def market_context(bars: DataFrame) -> DataFrame:
    """(ticker, n, value, start_date, end_date, start_close, end_close, status, reason) for each span of sessions (C12, W19 with its inputs).

    Only sessions after a ticker's last gap of more than a few days count; a span that reaches further back is unavailable, with the reason. bars end at the cutoff.
    """
    w = sessions()
    df = bars.filter("close > 0").withColumn("_gap", F.coalesce(F.datediff("date", F.lag("date").over(w)) > LONGEST_GAP, F.lit(False)))
    df = df.withColumn("_island", F.sum(F.col("_gap").cast("int")).over(w)).withColumn("_last", F.max("_island").over(W.partitionBy("ticker"))).filter("_island = _last")
    df = df.withColumn("_back", F.row_number().over(W.partitionBy("ticker").orderBy(F.col("date").desc()))).filter(F.col("_back") <= max(SPANS) + 1)
    at = lambda k: F.max(F.when(F.col("_back") == k, F.struct("date", "close")))
    wide = df.groupBy("ticker").agg(at(1).alias("e"), *[at(n + 1).alias(f"s{n}") for n in SPANS])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"s{n}").alias("s")) for n in SPANS])).alias("r")
    out = wide.select("ticker", "e", rows).select("ticker", F.col("r.n").alias("n"), "e", F.col("r.s").alias("s"))
    known = F.col("s").isNotNull()
    reason = F.when(~known, F.concat(F.lit("Insufficient contiguous history: "), F.col("n").cast("string"), F.lit(" sessions")))
    return out.select("ticker", "n", (F.col("e.close") / F.col("s.close") - 1).alias("value"), F.col("s.date").alias("start_date"), F.when(known, F.col("e.date")).alias("end_date"), F.col("s.close").alias("start_close"), F.when(known, F.col("e.close")).alias("end_close"), F.when(known, "available").otherwise("unavailable").alias("status"), reason.alias("reason"))


def relative_context(context: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, n, difference) of pairs (a, b) whose windows have the same first and last session (J10): windows that don't are never compared."""
    some = context.filter((F.col("status") == "available") & F.col("n").isin(*COMPARED)).select("ticker", "n", "start_date", "end_date", "value")
    left, right = some.withColumnsRenamed({"ticker": "a", "value": "va"}), some.withColumnsRenamed({"ticker": "b", "value": "vb"})
    return pairs.join(left, "a").join(right, ["b", "n", "start_date", "end_date"]).select("a", "b", "n", (F.col("va") - F.col("vb")).alias("difference"))


def _content(prefix: str, *parts: Column) -> Column:
    """An id by content: twenty digits of the hash of its parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 20))


def _micros(value: Column) -> Column:
    """A price in whole millionths, so that its text is the same everywhere."""
    return F.round(value * 1_000_000).cast("long")


def market_graph(context: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, kind, label) and edges (source, target, kind) of what a context shows (C32): a return is a calculation from its two end points.

    Ids are hashes of contents, so an end point that several windows share is one node, and reruns agree. No daily series is shown.
    """
    some = context.filter((F.col("status") == "available") & F.col("n").isin(*SHOWN))
    start = _content("observation:price-", F.col("ticker"), F.col("start_date"), _micros(F.col("start_close")))
    end = _content("observation:price-", F.col("ticker"), F.col("end_date"), _micros(F.col("end_close")))
    some = some.select("ticker", "n", "start_date", "end_date", start.alias("start"), end.alias("end"))
    some = some.withColumn("calculation", _content("calculation:market-", F.col("ticker"), F.col("n"), F.col("start"), F.col("end")))
    ends = some.select("ticker", "calculation", F.inline(F.array(F.struct(F.col("start").alias("target"), F.col("start_date").alias("date")), F.struct(F.col("end").alias("target"), F.col("end_date").alias("date")))))
    calculations = some.select(F.col("calculation").alias("node_id"), F.lit("calculation").alias("kind"), F.concat_ws(" ", "ticker", F.lit("return"), F.col("n").cast("string")).alias("label"))
    observations = ends.select(F.col("target").alias("node_id"), F.lit("observation").alias("kind"), F.concat_ws(" ", "ticker", F.lit("close"), F.col("date").cast("string")).alias("label")).distinct()
    return calculations.unionByName(observations), ends.select(F.col("calculation").alias("source"), "target", F.lit("calculated_from").alias("kind"))


def analyzed_portfolios(bars: DataFrame, positions: DataFrame, *, lookback: int = 20) -> DataFrame:
    """(portfolio_id, part, name, value): returns, risk, concentration and contributions of each portfolio, long (C11). The returns are aligned once for all parts."""
    aligned = aligned_returns(bars, positions)
    total = summary(portfolio_returns(aligned))
    long = lambda df, part, names: df.select("portfolio_id", F.lit(part).alias("part"), F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])))
    by = contributions(aligned, lookback).select("portfolio_id", F.lit("contribution").alias("part"), F.col("ticker").alias("name"), F.col("contribution").alias("value"))
    return reduce(DataFrame.unionByName, [long(total, "summary", ["return_window", "volatility", "max_drawdown", "sessions"]), long(concentration(positions), "concentration", ["largest_weight", "hhi"]), by])


def events_of_pairs(anomalies: DataFrame, *, close_hour: int = 21) -> DataFrame:
    """Events (event_id, ticker, related, detected_at, summary, metadata) of pair anomalies (C10): neutral ones, with what was measured as a map of texts.

    anomalies: rows of ``pairs.monitor_pairs``. A row whose last day isn't within its window, or whose z isn't a number, is left out. Times are UTC.
    """
    good = F.col("window_end").between(F.col("window_start"), F.col("window_end")) & F.col("z_score").isNotNull() & ~F.isnan("z_score") & (F.col("first_flag") >= F.col("window_start")) & (F.col("first_flag") <= F.col("window_end"))
    rich, poor = (F.when(F.col("direction") == "a_rich", F.col(x)).otherwise(F.col(y)) for x, y in (("a", "b"), ("b", "a")))
    measured = ["window_start", "window_end", "first_flag", "n_days_flagged", "direction"]
    metadata = F.map_from_arrays(F.array(*map(F.lit, measured)), F.array(*[F.col(c).cast("string") for c in measured]))
    text = F.concat(rich, F.lit(" stands above "), poor, F.lit(" in a pair that moved together, on "), F.col("window_end").cast("string"))
    at = F.to_timestamp(F.concat_ws(" ", F.col("window_end").cast("string"), F.lit(f"{close_hour}:00:00")))
    return anomalies.filter(good).select(F.col("anomaly_id").alias("event_id"), F.col("a").alias("ticker"), F.array("b").alias("related"), at.alias("detected_at"), text.alias("summary"), metadata.alias("metadata"))
