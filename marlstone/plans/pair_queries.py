"""Queries over weekly price indices: screening, fits, monitoring, outcomes, universes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.operators import pairs, universe
from marlstone.plans import inputs
from marlstone.plans.market_queries import Query, rounded

OBS, AS_OF = 252, "2001-06-04"


def _grouped(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.weekly(spark, sf).withColumn("grp", F.lit("all"))


def _correlations(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.pair_correlation(pairs.calendar_returns(_grouped(spark, sf), OBS), least_rows=OBS - 30)


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.top_peers(_correlations(spark, sf), k=3, floor=0.0)


def _statistics(spark: SparkSession, sf: str, bars: DataFrame | None = None) -> DataFrame:
    return pairs.pair_statistics(pairs.aligned_pairs(_grouped(spark, sf) if bars is None else bars, _candidates(spark, sf), 120))


def pair_ols(spark: SparkSession, sf: str) -> DataFrame:
    out = _statistics(spark, sf).select("a", "b", "nobs", "correlation", "beta", "const", "half_life_days", "spread_std", "df_stat")
    return rounded(out)


def monitor(spark: SparkSession, sf: str) -> DataFrame:
    bars = _grouped(spark, sf)
    fits = _statistics(spark, sf, bars.filter(F.col("date") < F.lit(AS_OF).cast("date")))
    out = pairs.monitor_pairs(bars, fits, start=AS_OF, end="2001-10-29", entry=1.5)
    return rounded(out.drop("grp"))


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    bars = _grouped(spark, sf)
    fits = _statistics(spark, sf, bars.filter(F.col("date") < F.lit(AS_OF).cast("date")))
    signals = pairs.spread_z(bars.filter(F.col("date") == F.lit(AS_OF).cast("date")), fits).join(fits, ["grp", "a", "b"]).select("a", "b", F.col("date").alias("as_of"), "z", "beta")
    before = F.lag("close").over(W.partitionBy("ticker").orderBy("date"))  # an index opens half way from the close before
    return rounded(pairs.forward_outcomes(signals, bars.withColumn("open", F.coalesce((F.col("close") + before) / 2, F.col("close"))), horizons=(1, 5, 10, 20)))


def fit_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Engle-Granger fits of the screened pairs; the unit-root tests have no SQL."""
    return rounded(pairs.fit_pairs(_grouped(spark, sf), observations=120, floor=0.0, alpha=0.5, peers=5).drop("grp"), 6)


def scan_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Point-in-time scans of every session with the formation before it and 20 sessions after it."""
    bars = _grouped(spark, sf)
    dates = pairs.scan_dates(bars, observations=OBS, after=20)
    return rounded(pairs.scan_as_of(bars, dates, days=7 * (OBS + 2), observations=OBS, floor=0.0, alpha=0.5, entry=1.0).select("a", "b", "as_of", "z", "correlation", "pvalue"), 6)


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    asked = inputs.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("asked"))
    return pairs.resolve_session(_grouped(spark, sf), asked)


def signals_on_date(spark: SparkSession, sf: str) -> DataFrame:
    bars = _grouped(spark, sf)
    fits = _statistics(spark, sf, bars.filter(F.col("date") < F.lit(AS_OF).cast("date")))
    out = pairs.top_signals(pairs.spread_z(bars.filter(F.col("date") == F.lit(AS_OF).cast("date")), fits))
    return rounded(out.select("a", "b", "z", F.col("rank").cast("long").alias("rank")))


def _brands(spark: SparkSession, sf: str) -> DataFrame:
    """Memberships of brands by their parts' sizes; several a brand."""
    p = inputs.table(spark, sf, "part")
    return p.select(F.col("p_brand").alias("ticker"), F.concat(F.lit("u"), F.col("p_size") % 3).alias("universe"), F.when(F.col("p_size") % 5 > 0, F.concat(F.lit("c"), F.col("p_size") % 2)).alias("currency"), F.when(F.col("p_size") % 7 == 0, "unmapped").otherwise("mapped").alias("mapping_status"))


_BRANDS = "brands AS (SELECT p_brand AS ticker, 'u' || p_size % 3 AS universe, CASE WHEN p_size % 5 > 0 THEN 'c' || p_size % 2 END AS currency, CASE WHEN p_size % 7 = 0 THEN 'unmapped' ELSE 'mapped' END AS mapping_status FROM part)"


def group_counts(spark: SparkSession, sf: str) -> DataFrame:
    out = universe.grouped_bars(inputs.weekly(spark, sf), _brands(spark, sf))
    return out.groupBy("grp").agg(F.countDistinct("ticker").alias("tickers"), F.count("*").alias("bars"), F.min("date").alias("first_date"))


def blocked(spark: SparkSession, sf: str) -> DataFrame:
    out = pairs.blocked_correlation(pairs.calendar_returns(_grouped(spark, sf), OBS), least_rows=OBS - 30, floor=0.0, block=8)
    return rounded(out.select("a", "b", "correlation", "n"))


def _universe(spark: SparkSession, sf: str) -> DataFrame:
    s = inputs.table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("input_pos"), F.concat(F.lit("t"), F.pmod("s_suppkey", F.lit(60))).alias("ticker"), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("s_name")).alias("name"), F.when(F.col("s_suppkey") % 4 == 0, None).otherwise(F.concat(F.lit("sector"), F.col("s_nationkey") % 5)).alias("sector"), F.concat(F.lit("u"), F.col("s_nationkey") % 3).alias("universe"), F.when(F.col("s_suppkey") % 7 == 0, "unmapped").otherwise("mapped").alias("mapping_status"))


_UNIVERSE = """uni AS (SELECT s_suppkey AS input_pos, 't' || s_suppkey % 60 AS ticker, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END AS name,
  CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'sector' || s_nationkey % 5 END AS sector, 'u' || s_nationkey % 3 AS universe, CASE WHEN s_suppkey % 7 = 0 THEN 'unmapped' ELSE 'mapped' END AS mapping_status FROM supplier)"""


def _membership(spark: SparkSession, sf: str) -> DataFrame:
    day = F.date_add(F.lit("2000-01-01").cast("date"), F.col("s_nationkey") * 20)
    return inputs.table(spark, sf, "supplier").select(F.col("s_name").alias("ticker"), F.lit("u").alias("universe"), F.when(F.col("s_suppkey") % 5 > 0, F.concat(F.lit("c"), F.col("s_suppkey") % 2)).alias("currency"), F.concat(F.lit("s"), F.col("s_nationkey") % 4).alias("sector"), F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit("i"), F.col("s_suppkey") % 3)).alias("industry"), day.alias("valid_from"), F.when(F.col("s_suppkey") % 4 == 0, F.date_add(day, 200)).alias("valid_to"))


_MEMBERSHIP = """mem AS (SELECT s_name AS ticker, 'u' AS universe, CASE WHEN s_suppkey % 5 > 0 THEN 'c' || s_suppkey % 2 END AS currency, 's' || s_nationkey % 4 AS sector, CASE WHEN s_suppkey % 3 > 0 THEN 'i' || s_suppkey % 3 END AS industry,
  DATE '2000-01-01' + s_nationkey * 20 AS valid_from, CASE WHEN s_suppkey % 4 = 0 THEN DATE '2000-01-01' + s_nationkey * 20 + 200 END AS valid_to FROM supplier)"""


def pit_peers(spark: SparkSession, sf: str) -> DataFrame:
    m = _membership(spark, sf)
    return universe.pit_peers(m, m.select("ticker"), "2001-01-01").withColumn("rank", F.col("rank").cast("long"))


QUERIES: dict[str, Query] = {
    "pair_correlation": lambda s, sf: rounded(_correlations(s, sf).select("a", "b", "correlation", "n")),
    "blocked_correlation": blocked,
    "top_peers": lambda s, sf: rounded(_candidates(s, sf).select("a", "b", "correlation")),
    "pair_ols": pair_ols,
    "monitor_pairs": monitor,
    "forward_outcomes": outcomes,
    "fit_pairs": fit_pairs,
    "scan_as_of": scan_as_of,
    "scan_dates": lambda s, sf: pairs.scan_dates(_grouped(s, sf), observations=OBS, after=20),
    "resolve_session": sessions,
    "top_signals": signals_on_date,
    "universe_groups": group_counts,
    "attach_group": lambda s, sf: universe.attach_group(inputs.table(s, sf, "part").select("p_partkey", F.col("p_brand").alias("ticker")), _brands(s, sf)),
    "merge_securities": lambda s, sf: universe.merge_securities(_universe(s, sf)),
    "pit_peers": pit_peers,
}

_BASE = f"WITH {inputs.BARS}, {inputs.WEEKLY}"
_CAL = f"""cd AS (SELECT date, row_number() OVER (ORDER BY date DESC) AS back, lead(date) OVER (ORDER BY date DESC) AS before FROM (SELECT DISTINCT date FROM weekly)),
cr AS (SELECT n.ticker, n.date, ln(n.close) - ln(p.close) AS r FROM weekly n JOIN cd ON n.date = cd.date AND back <= {OBS} JOIN weekly p ON p.ticker = n.ticker AND p.date = before),
pc AS (SELECT x.ticker AS a, y.ticker AS b, corr(x.r, y.r) AS correlation, count(*) AS n FROM cr x JOIN cr y ON x.date = y.date AND x.ticker < y.ticker GROUP BY 1, 2 HAVING count(*) >= {OBS - 30})"""
_TOP = """tp AS (SELECT a, b, correlation FROM pc WHERE correlation >= 0 UNION ALL SELECT b, a, correlation FROM pc WHERE correlation >= 0),
tk AS (SELECT least(a, b) AS a, greatest(a, b) AS b, correlation FROM tp QUALIFY row_number() OVER (PARTITION BY tp.a ORDER BY correlation DESC, tp.b) <= 3),
cand AS (SELECT a, b, max(correlation) AS correlation FROM tk GROUP BY 1, 2)"""


def _fits(where: str = "true") -> str:
    return f"""al AS (SELECT cand.a, cand.b, x.date, ln(x.close) AS la, ln(y.close) AS lb FROM cand JOIN weekly x ON x.ticker = a JOIN weekly y ON y.ticker = b AND y.date = x.date WHERE x.{where}
  QUALIFY row_number() OVER (PARTITION BY cand.a, cand.b ORDER BY x.date DESC) <= 120),
f1 AS (SELECT *, la - lag(la) OVER w AS ra, lb - lag(lb) OVER w AS rb, regr_slope(la, lb) OVER (PARTITION BY a, b) AS beta, regr_intercept(la, lb) OVER (PARTITION BY a, b) AS const FROM al WINDOW w AS (PARTITION BY a, b ORDER BY date)),
f2 AS (SELECT *, la - const - beta * lb AS s FROM f1), f3 AS (SELECT *, lag(s) OVER (PARTITION BY a, b ORDER BY date) AS s1 FROM f2), f4 AS (SELECT *, s - s1 AS ds FROM f3),
f5 AS (SELECT a, b, count(*) AS nobs, corr(ra, rb) AS correlation, any_value(beta) AS beta, any_value(const) AS const, regr_slope(ds, s1) AS pull, avg(s) AS spread_mean, stddev_samp(s) AS spread_std, sum(ds * s1) AS xy, sum(s1 * s1) AS xx, sum(ds * ds) AS yy, count(ds) AS n FROM f4 GROUP BY 1, 2),
fits AS (SELECT *, CASE WHEN pull < 0 THEN -ln(2) / pull END AS half_life_days, (xy / nullif(xx, 0)) / nullif(sqrt(greatest(0, yy - xy / nullif(xx, 0) * xy) / nullif((n - 1) * xx, 0)), 0) AS df_stat FROM f5)"""


_R = lambda *cs: ", ".join(f"round({c}, 4) + 0 AS {c}" for c in cs)
_PAST = f"date < DATE '{AS_OF}'"
_Z = "zz AS (SELECT fits.a, fits.b, beta, x.date, (ln(x.close) - const - beta * ln(y.close) - spread_mean) / spread_std AS z FROM fits JOIN weekly x ON x.ticker = fits.a JOIN weekly y ON y.ticker = fits.b AND y.date = x.date)"
ORACLE: dict[str, str] = {
    "pair_correlation": f"{_BASE}, {_CAL} SELECT a, b, {_R('correlation')}, n FROM pc",
    "blocked_correlation": f"{_BASE}, {_CAL} SELECT a, b, {_R('correlation')}, n FROM pc WHERE correlation >= 0",
    "top_peers": f"{_BASE}, {_CAL}, {_TOP} SELECT a, b, {_R('correlation')} FROM cand",
    "pair_ols": f"{_BASE}, {_CAL}, {_TOP}, {_fits('date IS NOT NULL')} SELECT a, b, nobs, {_R('correlation', 'beta', 'const', 'half_life_days', 'spread_std', 'df_stat')} FROM fits",
    "monitor_pairs": f"""{_BASE}, {_CAL}, {_TOP}, {_fits(_PAST)}, {_Z}, zw AS (SELECT * FROM zz WHERE date BETWEEN DATE '{AS_OF}' AND DATE '2001-10-29')
SELECT a, b, min(date) AS window_start, max(date) AS window_end, min(date) FILTER (WHERE abs(z) > 1.5) AS first_flag, count(*) FILTER (WHERE abs(z) > 1.5) AS n_days_flagged, round(arg_max(z, date), 4) + 0 AS z_score,
  round(max(abs(z)), 4) + 0 AS max_abs_z, CASE WHEN arg_max(z, date) > 0 THEN 'a_rich' ELSE 'b_rich' END AS direction, 'PAIR-' || a || '-' || b || '-' || max(date) AS anomaly_id FROM zw GROUP BY a, b HAVING count(*) FILTER (WHERE abs(z) > 1.5) > 0""",
    "forward_outcomes": f"""{_BASE}, {_CAL}, {_TOP}, {_fits(_PAST)}, {_Z}, sg AS (SELECT a, b, date AS as_of, z, beta FROM zz WHERE date = DATE '{AS_OF}'),
wo AS (SELECT *, coalesce((close + lag(close) OVER (PARTITION BY ticker ORDER BY date)) / 2, close) AS open FROM weekly),
mk AS (SELECT sg.*, x.date, x.close AS ca, y.close AS cb, x.open AS xo, y.open AS yo FROM sg JOIN wo x ON x.ticker = a AND x.date > as_of JOIN wo y ON y.ticker = b AND y.date = x.date),
m1 AS (SELECT *, first_value(date) OVER w AS entry, first_value(xo) OVER w AS oa, first_value(yo) OVER w AS ob, row_number() OVER w AS horizon FROM mk WINDOW w AS (PARTITION BY a, b ORDER BY date)),
m2 AS (SELECT *, -sign(z) / (1 + abs(beta)) * (ca / oa - 1) + sign(z) * beta / (1 + abs(beta)) * (cb / ob - 1) AS path FROM m1),
m3 AS (SELECT *, greatest(0, max(path) OVER (PARTITION BY a, b ORDER BY date)) AS peak FROM m2), m4 AS (SELECT *, min(path - peak) OVER (PARTITION BY a, b ORDER BY date) AS dd FROM m3)
SELECT a, b, as_of, entry, horizon, date, round(path * 100, 4) + 0 AS return_pct, round(dd * 100, 4) + 0 AS drawdown_pct FROM m4 WHERE horizon IN (1, 5, 10, 20)""",
    "scan_dates": f"{_BASE}, c AS (SELECT date, row_number() OVER (ORDER BY date) AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM weekly)) SELECT date AS as_of FROM c WHERE pos > {OBS} AND n - pos >= 20",
    "resolve_session": f"{_BASE} SELECT asked, (SELECT max(date) FROM weekly WHERE date <= asked) AS as_of FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS asked FROM orders)",
    "top_signals": f"{_BASE}, {_CAL}, {_TOP}, {_fits(_PAST)}, {_Z} SELECT a, b, round(z, 4) + 0 AS z, row_number() OVER (ORDER BY abs(z) DESC, a, b) AS rank FROM zz WHERE date = DATE '{AS_OF}' QUALIFY rank <= 50",
    "universe_groups": f"""{_BASE}, {_BRANDS}, m AS (SELECT DISTINCT ticker, universe || '|' || coalesce(currency, '') AS grp FROM brands WHERE mapping_status = 'mapped')
SELECT grp, count(DISTINCT ticker) AS tickers, count(*) AS bars, min(date) AS first_date FROM weekly JOIN m USING (ticker) GROUP BY 1 HAVING count(DISTINCT ticker) >= 2""",
    "attach_group": f"WITH {_BRANDS} SELECT p_partkey, p_brand AS ticker, coalesce((SELECT min(universe) FROM brands WHERE ticker = p_brand), 'unknown') AS \"group\" FROM part",
    "merge_securities": f"WITH {_UNIVERSE} SELECT upper(trim(ticker)) AS ticker, arg_min(name, input_pos) FILTER (WHERE trim(name) <> '') AS name, arg_min(sector, input_pos) FILTER (WHERE trim(coalesce(sector, '')) <> '') AS sector, string_agg(DISTINCT universe, ',' ORDER BY universe) AS universes FROM uni WHERE mapping_status = 'mapped' GROUP BY 1",
    "pit_peers": f"""WITH {_MEMBERSHIP}, v AS (SELECT * FROM mem WHERE valid_from <= DATE '2001-01-01' AND (valid_to IS NULL OR DATE '2001-01-01' < valid_to)),
b AS (SELECT DISTINCT t.ticker, p.ticker AS peer FROM v t JOIN v p ON t.universe IS NOT DISTINCT FROM p.universe AND t.currency IS NOT DISTINCT FROM p.currency AND t.sector = p.sector AND t.ticker <> p.ticker AND (t.industry IS NULL OR t.industry = p.industry))
SELECT ticker, peer, row_number() OVER (PARTITION BY ticker ORDER BY peer) AS rank FROM b QUALIFY rank <= 3""",
}
