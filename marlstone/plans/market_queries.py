"""Queries over bars: detectors, market model, returns and portfolios."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import market, portfolio, signals
from marlstone.plans import inputs

Query = Callable[[SparkSession, str], DataFrame]
SIGNAL = ["ticker", "observed_on", "kind", "z_score", "direction", "measure"]


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, as sums in another order differ in their last bits; adding 0 turns -0 into 0."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _signals(detect: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: rounded(detect(inputs.bars(spark, sf)).select(*SIGNAL))


_T = "(high + low + close) / 3"


def _frame(n: int, shift: int = 1) -> str:
    lo, hi = n - 1 + shift, shift
    end = "CURRENT ROW" if hi == 0 else f"{hi} PRECEDING"
    return f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {lo} PRECEDING AND {end})"


def _full(f: str, x: str, n: int, shift: int = 1) -> str:
    return f"CASE WHEN count({x}) {_frame(n, shift)} = {n} THEN {f}({x}) {_frame(n, shift)} END"


_OUT = "ticker, date AS observed_on, '{kind}' AS kind, round(z, 4) + 0 AS z_score, {direction} AS direction, round(measure, 4) + 0 AS measure"
_SPIKES = f"""v AS (SELECT *, CASE WHEN volume > 0 THEN ln(volume) END AS lv FROM bars),
v1 AS (SELECT *, (lv - {_full("avg", "lv", 20)}) / nullif({_full("stddev_samp", "lv", 20)}, 0) AS z, volume / {_full("avg", "volume", 20)} AS measure FROM v),
spikes AS (SELECT {_OUT.format(kind="volume_spike", direction="CASE WHEN close / open - 1 >= 0 THEN 'up' ELSE 'down' END")} FROM v1 WHERE z > 3)"""
_VWAP = f"""w0 AS (SELECT *, {_T} * volume AS tv FROM bars),
w1 AS (SELECT *, close / nullif({_full("sum", "tv", 20, 0)} / nullif({_full("sum", "volume", 20, 0)}, 0), 0) - 1 AS measure FROM w0),
w2 AS (SELECT *, measure * measure AS m2 FROM w1), w3 AS (SELECT *, measure / nullif(sqrt({_full("avg", "m2", 60)}), 0) AS z FROM w2),
vwap AS (SELECT {_OUT.format(kind="vwap_deviation", direction="CASE WHEN measure > 0 THEN 'above' ELSE 'below' END")} FROM w3 WHERE abs(z) > 2.5)"""
_TWAP = f"""t0 AS (SELECT *, {_T} AS tp FROM bars),
t1 AS (SELECT *, {_full("avg", "tp", 5, 0)} / nullif(lag(close, 5) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS measure FROM t0),
t2 AS (SELECT *, measure * measure AS m2 FROM t1), t3 AS (SELECT *, measure / nullif(sqrt({_full("avg", "m2", 60)}), 0) AS z FROM t2),
twap AS (SELECT {_OUT.format(kind="twap_deviation", direction="CASE WHEN measure > 0 THEN 'above' ELSE 'below' END")} FROM t3 WHERE abs(z) > 2.5)"""
_W = "OVER (PARTITION BY ticker ORDER BY date)"
_TREND = f"""c0 AS (SELECT *, {_full("avg", "close", 7, 0)} AS fma, {_full("avg", "close", 25, 0)} AS sma FROM bars),
c1 AS (SELECT *, fma - sma AS gap FROM c0 WHERE sma IS NOT NULL),
c2 AS (SELECT *, sign(gap) AS side, gap - lag(gap) {_W} AS step, row_number() {_W} AS pos_ FROM c1),
c3 AS (SELECT *, lag(side) {_W} AS was, {_full("stddev_samp", "step", 25)} AS spread FROM c2),
c4 AS (SELECT *, row_number() {_W} AS nth, lag(pos_) {_W} AS prev FROM c3 WHERE side <> 0 AND (was IS NULL OR was <> side)),
trend AS (SELECT ticker, date AS observed_on, CASE WHEN nth > 2 AND pos_ - prev <= 5 THEN 'trend_whipsaw' ELSE 'trend_cross' END AS kind,
  round(CASE WHEN spread > 0 THEN step / spread ELSE 0 END, 4) + 0 AS z_score, CASE WHEN side > 0 THEN 'bullish' ELSE 'bearish' END AS direction,
  round(gap / sma, 4) + 0 AS measure FROM c4 WHERE nth > 1)"""

_ABN = f"""a0 AS (SELECT bars.*, market FROM bars LEFT JOIN bench USING (date)),
a1 AS (SELECT *, ln(close) - lag(ln(close)) {_W} AS ret, ln(market) - lag(ln(market)) {_W} AS mret FROM a0),
a2 AS (SELECT *, CASE WHEN count(ret * mret) {_frame(252)} = 252 THEN covar_samp(ret, mret) {_frame(252)} END
  / nullif({_full("var_samp", "mret", 252)}, 0) AS beta FROM a1), a3 AS (SELECT *, ret - beta * mret AS abnormal FROM a2)"""


def _horizon(k: int) -> str:
    return f"{_full('sum', 'abnormal', k, 0)} AS cum_{k}, {_full('sum', 'abnormal', k, 0)} / nullif({_full('stddev_samp', 'abnormal', 252, k)} * sqrt({k}), 0) AS z_{k}"


_HORIZON = f"""h0 AS (SELECT *, {", ".join(_horizon(k) for k in market.HORIZONS.values())},
  {", ".join(f"lag(close, {k}) {_W} AS s_{k}, lag(market, {k}) {_W} AS m_{k}, avg(volume) {_frame(k, 0)} AS r_{k}, avg(volume) {_frame(max(3 * k, 60), k)} AS b_{k}" for k in market.HORIZONS.values())}
  FROM a3), h1 AS (SELECT * FROM h0 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1)"""


def _reading(name: str, k: int) -> str:
    m = f"CASE WHEN b_{k} = 0 THEN 1 ELSE r_{k} / b_{k} END"
    ok = f"(z_{k} IS NOT NULL AND {m} IS NOT NULL)"
    r = lambda x: f"CASE WHEN {ok} THEN round({x}, 4) + 0 END"
    return f"""SELECT ticker, date, '{name}' AS horizon, CASE WHEN {ok} THEN 'available' ELSE 'unavailable' END AS status, {r(f"(close / s_{k} - 1) * 100")} AS return_pct,
      {r(f"(market / m_{k} - 1) * 100")} AS benchmark_return_pct, {r("beta")} AS beta, {r(f"(exp(cum_{k}) - 1) * 100")} AS abnormal_return_pct, {r(f"z_{k}")} AS z_score,
      CASE WHEN {ok} THEN abs(z_{k}) >= 2 END AS unusual, {r(m)} AS volume_multiple, CASE WHEN {ok} THEN {m} >= 1.5 END AS volume_unusual FROM h1"""


def _abnormal(spark: SparkSession, sf: str) -> DataFrame:
    b = inputs.bars(spark, sf)
    df = market.abnormal_returns(b, inputs.benchmark(b))
    return rounded(df.filter("abnormal is not null").select("ticker", "date", "beta", "abnormal"), 6)


def _horizons(spark: SparkSession, sf: str) -> DataFrame:
    b = inputs.bars(spark, sf)
    return rounded(market.read_horizons(b, inputs.benchmark(b)))


def _peers(spark: SparkSession, sf: str) -> DataFrame:
    b = inputs.bars(spark, sf)
    out = market.read_peers(b, inputs.benchmark(b), least=0.02)
    return rounded(out.withColumn("rank", F.col("rank").cast("long")))


_PEERS = f"""d0 AS (SELECT date, row_number() OVER (ORDER BY date DESC) AS back, lead(date) OVER (ORDER BY date DESC) AS previous FROM (SELECT DISTINCT date FROM bars)),
rr AS (SELECT n.ticker, n.date, ln(n.close) - ln(p.close) AS r FROM bars n JOIN d0 ON n.date = d0.date AND back > 21 AND back <= 273 JOIN bars p ON p.ticker = n.ticker AND p.date = previous),
cc AS (SELECT a.ticker, b.ticker AS peer, corr(a.r, b.r) AS correlation FROM rr a JOIN rr b ON a.date = b.date AND a.ticker <> b.ticker GROUP BY 1, 2 HAVING corr(a.r, b.r) >= 0.02),
z0 AS (SELECT *, {_horizon(21)} FROM a3), z1 AS (SELECT * FROM z0 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1)
SELECT cc.ticker, peer, row_number() OVER (PARTITION BY cc.ticker ORDER BY correlation DESC, peer) AS rank, round(correlation, 4) + 0 AS correlation,
  round((exp(p.cum_21) - 1) * 100, 4) + 0 AS abnormal_return_pct, round(p.z_21, 4) + 0 AS z_score, coalesce(sign(p.z_21) = sign(o.z_21) AND abs(p.z_21) >= 1, false) AS followed
FROM cc JOIN z1 p ON p.ticker = peer AND p.z_21 IS NOT NULL JOIN z1 o ON o.ticker = cc.ticker QUALIFY rank <= 4"""

_RET = f"""r0 AS (SELECT ticker, date, close, lag(date) {_W} AS start, lag(close) {_W} AS p FROM bars),
r1 AS (SELECT *, CASE WHEN date - start <= 4 THEN close / p - 1 END AS ret, sum(CASE WHEN date - start > 4 THEN 1 ELSE 0 END) {_W} AS island FROM r0)"""
_SECURITY = f"""WITH {inputs.BARS}, {_RET},
s0 AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS back, lag(date) {_W} AS inner_start FROM r1 QUALIFY island = max(island) OVER (PARTITION BY ticker)),
s1 AS (SELECT * EXCLUDE (ret), CASE WHEN lag(date) {_W} IS NOT NULL THEN ret END AS ret FROM s0),
s2 AS (SELECT *, CASE WHEN ret IS NOT NULL AND back <= 252 THEN exp(sum(CASE WHEN back <= 252 THEN ln(1 + ret) END) {_W}) END AS wealth FROM s1),
s3 AS (SELECT *, greatest(1, max(wealth) {_W}) AS peak FROM s2)
SELECT ticker, max(date) AS last_session, {", ".join(f"round(max(CASE WHEN back = 1 THEN close END) / max(CASE WHEN back = {n + 1} THEN close END) - 1, 4) + 0 AS return_{n}" for n in (1, 5, 20, 63, 252))},
  {", ".join(f"CASE WHEN count(CASE WHEN back <= {n} THEN ret END) = {n} THEN round(stddev_samp(CASE WHEN back <= {n} THEN ret END) * sqrt(252), 4) + 0 END AS volatility_{n}" for n in (20, 60))},
  round(min(wealth / peak - 1), 4) + 0 AS max_drawdown FROM s3 GROUP BY ticker"""


def _aligned_sql(pos: str) -> str:
    return f"""x0 AS (SELECT portfolio_id, r1.*, weight FROM r1 JOIN {pos} USING (ticker)), xn AS (SELECT portfolio_id, count(DISTINCT ticker) AS n FROM {pos} GROUP BY 1),
xu AS (SELECT portfolio_id, date, row_number() OVER (PARTITION BY portfolio_id ORDER BY date) AS idx FROM (SELECT DISTINCT portfolio_id, date FROM x0)),
xc AS (SELECT portfolio_id, date, start FROM x0 WHERE ret IS NOT NULL GROUP BY 1, 2, 3 HAVING count(DISTINCT ticker) = (SELECT n FROM xn WHERE xn.portfolio_id = x0.portfolio_id)),
xr AS (SELECT xc.*, idx, idx - row_number() OVER (PARTITION BY portfolio_id ORDER BY idx) AS run FROM xc JOIN xu USING (portfolio_id, date)),
xt AS (SELECT portfolio_id, max(idx) AS li, arg_max(run, idx) AS lr, count(*) AS c FROM xr GROUP BY 1),
xk AS (SELECT xr.* FROM xr JOIN xt USING (portfolio_id) WHERE run = lr AND c >= 2 AND li = (SELECT max(idx) FROM xu WHERE xu.portfolio_id = xr.portfolio_id)),
aligned AS (SELECT xk.portfolio_id, xk.date, ticker, weight, ret FROM xk JOIN x0 USING (portfolio_id, date) WHERE portfolio_id IN (SELECT portfolio_id FROM xk GROUP BY 1 HAVING count(*) >= 2))"""


_DAILY = "daily AS (SELECT portfolio_id, date, sum(weight * ret) AS ret FROM aligned GROUP BY 1, 2)"


def _summary_sql(source: str, key: str) -> str:
    w = f"OVER (PARTITION BY {key} ORDER BY date)"
    return f"""y0 AS (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY date DESC) <= 252),
y1 AS (SELECT *, product(1 + ret) {w} AS wealth FROM y0), y2 AS (SELECT *, greatest(1, max(wealth) {w}) AS peak FROM y1),
summed AS (SELECT {key}, round(product(1 + ret) - 1, 4) + 0 AS return_window, CASE WHEN count(*) >= 2 THEN round(stddev_samp(ret) * sqrt(252), 4) + 0 END AS volatility,
  round(min(wealth / peak - 1), 4) + 0 AS max_drawdown, count(*) AS sessions, min(date) AS start, max(date) AS "end" FROM y2 GROUP BY {key})"""


def _portfolio(use: Callable[[DataFrame, DataFrame], DataFrame], digits: int = 4) -> Query:
    return lambda spark, sf: rounded(use(inputs.flag_bars(spark, sf), portfolio.validated_portfolio(inputs.portfolio(spark, sf))), digits)


QUERIES: dict[str, Query] = {
    "volume_spikes": _signals(signals.detect_volume_spikes),
    "vwap_deviation": _signals(signals.detect_vwap_deviations),
    "twap_deviation": _signals(signals.detect_twap_deviations),
    "trend_breaks": _signals(signals.detect_trend_breaks),
    "all_signals": _signals(lambda b: signals.detect_all_signals(b, "1996-01-01", "2000-12-31")),
    "abnormal_returns": _abnormal,
    "horizon_readings": _horizons,
    "peer_readings": _peers,
    "security_returns": lambda spark, sf: rounded(portfolio.security_returns(inputs.bars(spark, sf))),
    "aligned_returns": _portfolio(lambda b, p: portfolio.aligned_returns(b, p).select("portfolio_id", "date", "ticker", "ret"), 6),
    "portfolio_summary": _portfolio(lambda b, p: portfolio.summary(portfolio.portfolio_returns(portfolio.aligned_returns(b, p)))),
    "contributions": _portfolio(lambda b, p: portfolio.contributions(portfolio.aligned_returns(b, p), 3)),
    "overlay": _portfolio(lambda b, p: portfolio.overlay(b, p, "NO", "AF")),
    "series_quality": lambda spark, sf: portfolio.validated_series(inputs.bars(spark, sf)),
    "rebased_closes": lambda spark, sf: rounded(market.rebased(market.market_view(portfolio.cutoff_bars(inputs.bars(spark, sf), "2000-06-30"), 100)).select("ticker", "date", "level")),
}

_MODEL = f"WITH {inputs.BARS}, {inputs.BENCH}, {_ABN}"
_PF = f"WITH {inputs.BARS}, {inputs.PORTFOLIO}, {_RET}, {_aligned_sql('pos')}".replace(inputs.BARS, inputs.FLAG_BARS)
ORACLE: dict[str, str] = {
    "volume_spikes": f"WITH {inputs.BARS}, {_SPIKES} SELECT * FROM spikes",
    "vwap_deviation": f"WITH {inputs.BARS}, {_VWAP} SELECT * FROM vwap",
    "twap_deviation": f"WITH {inputs.BARS}, {_TWAP} SELECT * FROM twap",
    "trend_breaks": f"WITH {inputs.BARS}, {_TREND} SELECT * FROM trend",
    "all_signals": f"WITH {inputs.BARS}, {_SPIKES}, {_VWAP}, {_TWAP}, {_TREND}, u AS (SELECT * FROM spikes UNION ALL SELECT * FROM vwap UNION ALL SELECT * FROM twap UNION ALL SELECT * FROM trend) SELECT * FROM u WHERE observed_on BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'",
    "abnormal_returns": f"{_MODEL} SELECT ticker, date, round(beta, 6) + 0 AS beta, round(abnormal, 6) + 0 AS abnormal FROM a3 WHERE abnormal IS NOT NULL",
    "horizon_readings": f"{_MODEL}, {_HORIZON} " + " UNION ALL ".join(_reading(n, k) for n, k in market.HORIZONS.items()),
    "peer_readings": f"{_MODEL}, {_PEERS}",
    "security_returns": _SECURITY,
    "aligned_returns": f"{_PF} SELECT portfolio_id, date, ticker, round(ret, 6) + 0 AS ret FROM aligned",
    "portfolio_summary": f"{_PF}, {_DAILY}, {_summary_sql('daily', 'portfolio_id')} SELECT * FROM summed",
    "contributions": f"""{_PF}, {_DAILY}, q0 AS (SELECT * FROM daily QUALIFY row_number() OVER (PARTITION BY portfolio_id ORDER BY date DESC) <= 3),
q1 AS (SELECT *, exp(coalesce(sum(ln(1 + ret)) OVER (PARTITION BY portfolio_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS prior FROM q0 QUALIFY count(*) OVER (PARTITION BY portfolio_id) >= 3)
SELECT portfolio_id, ticker, round(sum(prior * weight * aligned.ret), 4) + 0 AS contribution FROM aligned JOIN q1 USING (portfolio_id, date) GROUP BY 1, 2""",
    "overlay": f"""WITH {inputs.FLAG_BARS}, {inputs.PORTFOLIO}, {_RET}, both_ AS (SELECT portfolio_id, ticker, sum(weight) AS weight FROM (SELECT * FROM pos UNION ALL SELECT DISTINCT portfolio_id, t, 0 FROM pos, (VALUES ('NO'), ('AF')) v(t)) GROUP BY 1, 2), {_aligned_sql('both_')},
o0 AS (SELECT portfolio_id, date, sum(weight * ret) AS base, sum(CASE ticker WHEN 'NO' THEN 0.5 * ret WHEN 'AF' THEN -0.5 * ret END) AS pair FROM aligned GROUP BY 1, 2),
o1 AS (SELECT * FROM o0 QUALIFY row_number() OVER (PARTITION BY portfolio_id ORDER BY date DESC) <= 252), o2 AS (SELECT * FROM o1 QUALIFY count(*) OVER (PARTITION BY portfolio_id) >= 20),
oc AS (SELECT portfolio_id, CASE WHEN stddev_samp(base) > 0 AND stddev_samp(pair) > 0 THEN round(corr(base, pair), 4) + 0 END AS correlation FROM o2 GROUP BY 1),
os AS (SELECT portfolio_id || '|base' AS k, date, base AS ret FROM o2 UNION ALL SELECT portfolio_id || '|candidate', date, pair FROM o2 UNION ALL SELECT portfolio_id || '|combined', date, base + 0.02 * pair FROM o2),
{_summary_sql('os', 'k')} SELECT split_part(k, '|', 1) AS portfolio_id, split_part(k, '|', 2) AS series, return_window, volatility, max_drawdown, sessions, correlation FROM summed JOIN oc ON oc.portfolio_id = split_part(k, '|', 1)""",
    "series_quality": f"WITH {inputs.BARS} SELECT ticker, CASE WHEN n = d AND bad = 0 THEN 'available' ELSE 'unavailable' END AS status, CASE WHEN n <> d THEN 'duplicate dates' WHEN bad > 0 THEN 'invalid closes' END AS reason FROM (SELECT ticker, count(*) AS n, count(DISTINCT date) AS d, count(*) FILTER (WHERE close IS NULL OR close <= 0) AS bad FROM bars GROUP BY 1)",
    "rebased_closes": f"WITH {inputs.BARS}, k AS (SELECT * FROM bars WHERE date <= DATE '2000-06-30' QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 100) SELECT ticker, date, round(close / first_value(close) OVER (PARTITION BY ticker ORDER BY date) * 100, 4) + 0 AS level FROM k",
}
