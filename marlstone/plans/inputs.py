"""Adapters from the driver's tables to the operators' inputs, and the same in DuckDB SQL.

Bars: a part's brand is the ticker, a ship date the session, price = extended price / quantity. Rows of a day are ordered by all their
columns, as (l_orderkey, l_linenumber) isn't unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, ticker, open, high, low, close, volume)."""
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker")), "l_partkey")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    line = line.select("ticker", F.to_date("l_shipdate").alias("date"), price.alias("p"), "l_quantity", order.alias("o"))
    return line.groupBy("date", "ticker").agg(F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"), F.sum("l_quantity").alias("volume"))


_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
BARS = f"""bars AS (
  SELECT CAST(l_shipdate AS DATE) AS date, p_brand AS ticker, first(l_extendedprice / l_quantity ORDER BY {_ORDER}) AS open,
    max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
    last(l_extendedprice / l_quantity ORDER BY {_ORDER}) AS close, sum(l_quantity) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def flag_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, ticker, close): return flag and line status as the ticker; denser in time than brands, so sessions meet."""
    line = table(spark, sf_dir, "lineitem")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return line.groupBy(F.to_date("l_shipdate").alias("date"), F.concat("l_returnflag", "l_linestatus").alias("ticker")).agg(F.max_by(price, order).alias("close"))


FLAG_BARS = f"""bars AS (
  SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag || l_linestatus AS ticker, last(l_extendedprice / l_quantity ORDER BY {_ORDER}) AS close
  FROM lineitem GROUP BY 1, 2)"""


def benchmark(series: DataFrame) -> DataFrame:
    """(date, market): the mean close of all tickers a date."""
    return series.groupBy("date").agg(F.avg("close").alias("market"))


BENCH = "bench AS (SELECT date, avg(close) AS market FROM bars GROUP BY date)"


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, ticker, close): a price index on weeks, of cumulative scaled mean log prices. Built once, before any cutoff: raw input."""
    from pyspark.sql import Window as W

    b = bars(spark, sf_dir).groupBy("ticker", F.to_date(F.date_trunc("week", "date")).alias("date")).agg(F.avg(F.ln("close")).alias("x"))
    per = b.groupBy("ticker").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    b = b.join(per, "ticker").withColumn("r", 0.02 * (F.col("x") - F.col("m")) / F.col("s"))
    path = F.sum("r").over(W.partitionBy("ticker").orderBy("date"))
    return b.select("date", "ticker", F.exp(path).alias("close"))


WEEKLY = """wk AS (SELECT ticker, CAST(date_trunc('week', date) AS DATE) AS date, avg(ln(close)) AS x FROM bars GROUP BY 1, 2),
wp AS (SELECT ticker, avg(x) AS m, stddev_samp(x) AS s FROM wk GROUP BY 1),
weekly AS (SELECT date, ticker, exp(sum(0.02 * (x - m) / s) OVER (PARTITION BY ticker ORDER BY date)) AS close FROM wk JOIN wp USING (ticker))"""


def portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(portfolio_id, ticker, weight) for the tickers of ``flag_bars``: stated, as a user states a portfolio."""
    return spark.createDataFrame([("p1", "NO", 0.4), ("p1", "AF", 0.35), ("p1", "NF", 0.25), ("p2", "AO", 0.5), ("p2", "RF", 0.5)], "portfolio_id string, ticker string, weight double")


PORTFOLIO = "pos AS (SELECT * FROM (VALUES ('p1', 'NO', 0.4::DOUBLE), ('p1', 'AF', 0.35), ('p1', 'NF', 0.25), ('p2', 'AO', 0.5), ('p2', 'RF', 0.5)) AS t(portfolio_id, ticker, weight))"
