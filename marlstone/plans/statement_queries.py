"""Queries over statements: windows of periods, ratios with lineage, derived quarters, evidence tables, the quarterly view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import fundamentals, statements
from marlstone.plans import evidence_queries as base
from marlstone.plans.inputs import table
from marlstone.plans.market_queries import Query, rounded

# Some brands miss their cash, pay negative capital expenditure, or depreciate below zero.
_PLANTED = "NOT (concept = 'cash' AND ticker LIKE '%3')"
_SIGNED = "CASE WHEN concept = 'capex' AND ticker LIKE '%7' OR concept = 'depreciation_and_amortization' AND ticker LIKE '%1' THEN -value ELSE value END"


def _annual(spark: SparkSession, sf: str) -> DataFrame:
    facts = fundamentals.select_facts(base._facts(spark, sf), base.AS_OF, "annual").filter(_PLANTED).withColumn("value", F.expr(_SIGNED))
    return statements.with_fact_ids(facts)


def _lineage(spark: SparkSession, sf: str) -> DataFrame:
    out = statements.metric_lineage(_annual(spark, sf))
    return rounded(out.withColumns({"input_ids": F.array_join("input_ids", ","), "fact_ids": F.array_join("fact_ids", ",")}))


_ID = "'FACT-' || substring(sha256(concat_ws('|', ticker, concept, coalesce(CAST(period_start AS VARCHAR), 'None'), period_end, ticker || '-' || v)), 1, 20)"
_HELD = f"held AS (SELECT ticker, concept, period_start, period_end, {_SIGNED} AS value, filed_at, ticker || '-' || v AS accession, {_ID} AS fact_id FROM picked WHERE {_PLANTED})"
_NEED = "revenue operating_income net_income operating_cash_flow capex depreciation_and_amortization interest_expense tax_expense pretax_income diluted_shares cash total_debt current_assets current_liabilities total_assets shareholders_equity short_term_debt current_long_term_debt long_term_debt finance_lease_current finance_lease_noncurrent".split()


def _node(metric: str, inputs: list[tuple[str, bool]], value: str, *checks: tuple[str, str]) -> str:
    """The columns of a metric in SQL: reason, value, facts, direct inputs and starts."""
    why = [f"'{n}: ' || {n}_w" if made else f"{n}_w" for n, made in inputs]
    starts = "list_distinct(list_concat(" + ", ".join(f"{n}_s" for n, _ in inputs) + "))"
    own = [f"CASE WHEN {c} THEN '{m}' END" for c, m in checks] + [f"CASE WHEN len({starts}) > 1 THEN 'Incompatible duration contexts' END"]
    w = f"coalesce({', '.join(why + own)})"
    facts = "list_sort(list_distinct(list_concat(" + ", ".join(f"{n}_f" for n, _ in inputs) + ")))"
    ident = lambda n: f"['FIN-' || substring(sha256(concat_ws('|', ticker, '{n}', period_end, array_to_string({n}_i, ','))), 1, 20)]"
    direct = "list_concat(" + ", ".join(ident(n) if made else f"{n}_i" for n, made in inputs) + ")"
    pick = lambda x, none: f"CASE WHEN {w} IS NULL THEN {x} ELSE {none} END"
    return f"{w} AS {metric}_w, {pick(value, 'NULL')} AS {metric}_v, {pick(facts, '[]::VARCHAR[]')} AS {metric}_f, {pick(direct, '[]::VARCHAR[]')} AS {metric}_i, {pick(starts, '[]::DATE[]')} AS {metric}_s"


def _quotient(metric: str, a: tuple[str, bool], b: tuple[str, bool]) -> str:
    return _node(metric, [a, b], f"{a[0]}_v / nullif(greatest({b[0]}_v, 0), 0)", (f"{b[0]}_v <= 0", "Denominator must be positive; ratio not meaningful"))


_R, _M = (lambda n: (n, False)), (lambda n: (n, True))
_BASE_COLUMNS = ", ".join(f"max(value) FILTER (WHERE concept = '{c}') AS {c}_v, max(fact_id) FILTER (WHERE concept = '{c}') AS {c}_id, max(period_start) FILTER (WHERE concept = '{c}') AS {c}_start" for c in _NEED)
_AS_NODES = ", ".join(f"{c}_v, CASE WHEN {c}_v IS NULL THEN 'Missing {c} at ' || period_end END AS {c}_w, CASE WHEN {c}_v IS NULL THEN []::VARCHAR[] ELSE [{c}_id] END AS {c}_f, CASE WHEN {c}_v IS NULL THEN []::VARCHAR[] ELSE [{c}_id] END AS {c}_i, CASE WHEN {c}_start IS NULL THEN []::DATE[] ELSE [{c}_start] END AS {c}_s" for c in _NEED)
_PRIOR = lambda c: f"(SELECT CASE WHEN count(*) = 1 THEN any_value({{}}) END FROM held z, held y WHERE y.ticker = m2.ticker AND y.period_end = m2.period_end AND y.concept = '{c}' AND y.period_start IS NOT NULL AND z.ticker = m2.ticker AND z.concept = '{c}' AND z.period_start IS NOT NULL AND m2.period_end - z.period_end BETWEEN 350 AND 380 AND abs((y.period_end - y.period_start) - (z.period_end - z.period_start)) <= 7)"
_WAS = ", ".join(f"{_PRIOR(c).format('z.value')} AS was_{c}_v, {_PRIOR(c).format('z.fact_id')} AS was_{c}_id" for c in ("revenue", "diluted_shares"))
_WAS_NODES = ", ".join(f"CASE WHEN len({c}_s) = 0 THEN 'Missing current {c}' WHEN was_{c}_v IS NULL THEN 'Missing unambiguous prior comparable period' END AS was_{c}_w, CASE WHEN was_{c}_v IS NULL THEN []::VARCHAR[] ELSE [was_{c}_id] END AS was_{c}_f, CASE WHEN was_{c}_v IS NULL THEN []::VARCHAR[] ELSE [was_{c}_id] END AS was_{c}_i, []::DATE[] AS was_{c}_s" for c in ("revenue", "diluted_shares"))
_NO_START = "CASE WHEN start IS NULL THEN 'Unambiguous duration start required for beginning balance' ELSE {0} END"
_METRICS = "revenue_growth_yoy operating_margin net_margin operating_cash_flow_margin capex_outflow free_cash_flow free_cash_flow_margin cash_conversion_or_cfo_to_net_income total_debt net_debt derived_ebitda net_debt_to_ebitda interest_coverage capex_to_revenue working_capital working_capital_to_revenue average_assets asset_turnover effective_tax_rate nopat invested_capital average_invested_capital roic share_dilution_yoy".split()
_LINEAGE = f"""{base._DUCK}, {base._pick("350 AND 380")}, {_HELD},
b0 AS (SELECT ticker, period_end, CASE WHEN min(period_start) = max(period_start) THEN min(period_start) END AS start, {_BASE_COLUMNS} FROM held GROUP BY 1, 2),
b1 AS (SELECT ticker, period_end, start, {_AS_NODES} FROM b0),
m1 AS (SELECT * , {_node("capex_outflow", [_R("capex")], "capex_v", ("capex_v < 0", "Negative SEC payments value: capex sign is ambiguous; not silently inverted"))}, {_node("working_capital", [_R("current_assets"), _R("current_liabilities")], "current_assets_v - current_liabilities_v")},
  {_node("derived_ebitda", [_R("operating_income"), _R("depreciation_and_amortization")], "operating_income_v + depreciation_and_amortization_v", ("depreciation_and_amortization_v < 0", "Negative D&A is unsuitable for derived EBITDA"))},
  {_node("effective_tax_rate", [_R("tax_expense"), _R("pretax_income")], "tax_expense_v / pretax_income_v", ("pretax_income_v <= 0", "Denominator must be positive; ratio not meaningful"), ("tax_expense_v / pretax_income_v NOT BETWEEN 0 AND 1", "Reported effective tax rate outside [0, 1]"))} FROM b1),
m2 AS (SELECT *, {_node("free_cash_flow", [_R("operating_cash_flow"), _M("capex_outflow")], "operating_cash_flow_v - capex_outflow_v")}, {_node("net_debt", [_M("total_debt"), _R("cash")], "total_debt_v - cash_v")},
  {_node("invested_capital", [_R("shareholders_equity"), _M("total_debt"), _R("cash")], "shareholders_equity_v + total_debt_v - cash_v")}, {_node("nopat", [_R("operating_income"), _M("effective_tax_rate")], "operating_income_v * (1 - effective_tax_rate_v)")} FROM m1),
m3 AS (SELECT m2.*, {_WAS},
  o.total_assets_v AS before_a_v, coalesce(o.total_assets_f, []::VARCHAR[]) AS before_a_f, coalesce(o.total_assets_i, []::VARCHAR[]) AS before_a_i, []::DATE[] AS before_a_s, {_NO_START.format("CASE WHEN o.ticker IS NULL THEN 'Missing total_assets at ' || CAST(m2.start - 1 AS DATE) ELSE o.total_assets_w END").replace("start IS", "m2.start IS")} AS before_a_w,
  o.invested_capital_v AS before_c_v, coalesce(o.invested_capital_f, []::VARCHAR[]) AS before_c_f, ['FIN-' || substring(sha256(concat_ws('|', m2.ticker, 'invested_capital', CAST(m2.start - 1 AS DATE), array_to_string(o.invested_capital_i, ','))), 1, 20)] AS before_c_i, []::DATE[] AS before_c_s,
  {_NO_START.format("'invested_capital: ' || CASE WHEN o.ticker IS NULL THEN 'Missing shareholders_equity at ' || CAST(m2.start - 1 AS DATE) ELSE o.invested_capital_w END").replace("start IS", "m2.start IS")} AS before_c_w
  FROM m2 LEFT JOIN m2 o ON o.ticker = m2.ticker AND o.period_end = m2.start - 1),
m4 AS (SELECT *, {_WAS_NODES} FROM m3),
m5 AS (SELECT *, {_node("average_assets", [_R("before_a"), _R("total_assets")], "(before_a_v + total_assets_v) / 2")}, {_node("average_invested_capital", [_R("before_c"), _M("invested_capital")], "(before_c_v + invested_capital_v) / 2")},
  {", ".join(_node(m, [_R(c), _R("was_" + c)], f"{c}_v / was_{c}_v - 1", (f"was_{c}_v <= 0", "Denominator must be positive; ratio not meaningful")) for m, c in (("revenue_growth_yoy", "revenue"), ("share_dilution_yoy", "diluted_shares")))} FROM m4),
m6 AS (SELECT *, {_quotient("operating_margin", _R("operating_income"), _R("revenue"))}, {_quotient("net_margin", _R("net_income"), _R("revenue"))}, {_quotient("operating_cash_flow_margin", _R("operating_cash_flow"), _R("revenue"))}, {_quotient("free_cash_flow_margin", _M("free_cash_flow"), _R("revenue"))},
  {_quotient("cash_conversion_or_cfo_to_net_income", _R("operating_cash_flow"), _R("net_income"))}, {_quotient("net_debt_to_ebitda", _M("net_debt"), _M("derived_ebitda"))}, {_quotient("interest_coverage", _R("operating_income"), _R("interest_expense"))}, {_quotient("capex_to_revenue", _M("capex_outflow"), _R("revenue"))},
  {_quotient("working_capital_to_revenue", _M("working_capital"), _R("revenue"))}, {_quotient("asset_turnover", _R("revenue"), _M("average_assets"))}, {_quotient("roic", _M("nopat"), _M("average_invested_capital"))} FROM m5)
{" UNION ALL ".join(f"SELECT ticker, period_end, '{m}' AS metric, 'FIN-' || substring(sha256(concat_ws('|', ticker, '{m}', period_end, array_to_string({m}_i, ','))), 1, 20) AS calculation_id, round({m}_v, 4) + 0 AS value, CASE WHEN {m}_w IS NULL THEN 'available' ELSE 'unavailable' END AS status, {m}_w AS reason, array_to_string({m}_i, ',') AS input_ids, array_to_string({m}_f, ',') AS fact_ids FROM m6" for m in _METRICS)}"""


def _window(spark: SparkSession, sf: str) -> DataFrame:
    facts = fundamentals.select_facts(base._facts(spark, sf), base.AS_OF, "annual")
    return rounded(statements.statement_window(facts, 2).select("ticker", "concept", "period_start", "period_end", "value"))


_WINDOW = f"""{base._DUCK}, {base._pick("350 AND 380")}, en AS (SELECT ticker, period_end, row_number() OVER (PARTITION BY ticker ORDER BY period_end DESC) AS k FROM (SELECT DISTINCT ticker, period_end FROM picked WHERE period_start IS NOT NULL)),
keep AS (SELECT ticker, period_end FROM en WHERE k <= 3 UNION SELECT p.ticker, CAST(p.period_start - 1 AS DATE) FROM picked p JOIN en USING (ticker, period_end) WHERE k <= 2 AND period_start IS NOT NULL)
SELECT ticker, concept, period_start, period_end, round(value, 4) + 0 AS value FROM picked SEMI JOIN keep USING (ticker, period_end)"""


def _derived(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(statements.derived_quarters(fundamentals.select_facts(base._facts(spark, sf), base.AS_OF, "cumulative")))


_WIDE_QUARTERS = ["revenue", "operating_income", "net_income", "operating_cash_flow", "capex", "cash", "total_debt"]
_COMPARED = {"revenue": "USD", "operating_cash_flow": "USD", "capex": "USD", "cash": "USD", "net_debt": "USD", "shares_outstanding": "shares", "diluted_shares": "shares"}
_MARGIN = ["gross_margin", "operating_margin", "net_margin", "free_cash_flow_margin"]
_DERIVED = f"""{base._DUCK}, {base._QUARTERS}, w0 AS (SELECT ticker, period_end, max(fiscal_year) * 4 + max(quarter) AS idx, {", ".join(f"max(value) FILTER (WHERE concept = '{c}') AS {c}" for c in _WIDE_QUARTERS)}, CAST(NULL AS DOUBLE) AS gross_margin, CAST(NULL AS DOUBLE) AS shares_outstanding, CAST(NULL AS DOUBLE) AS diluted_shares FROM quarters GROUP BY 1, 2),
w1 AS (SELECT *, CASE WHEN capex >= 0 THEN operating_cash_flow - capex END AS free_cash_flow, total_debt - cash AS net_debt, CASE WHEN revenue > 0 THEN operating_income / revenue END AS operating_margin, CASE WHEN revenue > 0 THEN net_income / revenue END AS net_margin FROM w0),
w2 AS (SELECT *, CASE WHEN revenue > 0 THEN free_cash_flow / revenue END AS free_cash_flow_margin FROM w1), la AS (SELECT * FROM w2 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY period_end DESC) <= 8),
cm AS (SELECT la.ticker, la.period_end, cad, {", ".join(f"la.{c} AS a_{c}, z.{c} AS b_{c}" for c in [*_COMPARED, *_MARGIN])} FROM la, (VALUES ('qoq', 1, 70, 110), ('yoy', 4, 350, 380)) k(cad, k, lo, hi) LEFT JOIN w2 z ON z.ticker = la.ticker AND z.idx = la.idx - k.k AND la.period_end - z.period_end BETWEEN lo AND hi)
{" UNION ALL ".join([f"SELECT ticker, period_end, '{m}' AS metric, round({m}, 4) + 0 AS value, '{'ratio' if m.endswith('margin') else 'USD'}' AS unit, CASE WHEN {m} IS NULL THEN 'Missing required inputs' END AS reason FROM la" for m in ["total_debt", "free_cash_flow", "net_debt", *_MARGIN]]
+ [f"SELECT ticker, period_end, '{c}_' || cad || '_change', round((a_{c} - b_{c}) * {10000 if c in _MARGIN else 1}, 4) + 0, '{'bps' if c in _MARGIN else _COMPARED[c]}', CASE WHEN a_{c} - b_{c} IS NULL THEN 'Missing comparable fiscal quarter or metric' END FROM cm" for c in [*_COMPARED, *_MARGIN]]
+ [f"SELECT ticker, period_end, '{c}_' || cad || '_growth', round(CASE WHEN b_{c} > 0 THEN a_{c} / b_{c} - 1 END, 4) + 0, 'ratio', CASE WHEN b_{c} > 0 AND a_{c} IS NOT NULL THEN NULL ELSE 'Missing comparison or nonpositive denominator' END FROM cm" for c in _COMPARED])}"""

# Brands whose name ends with 9 file under a number that isn't one.
_ACCESSION = "CASE WHEN ticker LIKE '%9' THEN 'bad' ELSE lpad(cik, 10, '0') || '-' || substring(CAST(year(period_end) AS {0}), 3, 2) || '-' || lpad(CAST({1} AS {0}), 6, '0') END"


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    facts = _annual(spark, sf).withColumn("cik", F.regexp_extract("ticker", r"(\d+)", 1))
    facts = facts.withColumn("accession", F.expr(_ACCESSION.format("STRING", "substring_index(accession, '-', -1)")))
    documents, observations, calculations = statements.fact_evidence(facts, statements.metric_lineage(_annual(spark, sf)))
    row = lambda df, kind, ident, text, inputs: df.select(F.lit(kind).alias("kind"), F.col(ident).alias("id"), F.col(text).alias("text"), inputs.alias("inputs"))
    joined = F.array_join(F.array_sort(F.concat("input_observation_ids", "input_calculation_ids")), ",")
    return row(documents, "document", "document_id", "title", F.col("url")).unionByName(row(observations, "observation", "observation_id", "name", F.col("document_id"))).unionByName(row(calculations, "calculation", "calculation_id", "label", joined))


_EVIDENCE = f"""WITH lin AS ({_LINEAGE}), {base._DUCK.removeprefix("WITH ")}, {base._pick("350 AND 380")}, {_HELD}, g AS (SELECT *, regexp_extract(ticker, '(\\d+)', 1) AS cik FROM held), a AS (SELECT * EXCLUDE (accession), {_ACCESSION.format("VARCHAR", "split_part(accession, '-', -1)")} AS acc FROM g), ok AS (SELECT *, 'SEC-FILING-' || cik || '-' || acc AS doc FROM a WHERE regexp_matches(acc, '^\\d{{10}}-\\d{{2}}-\\d{{6}}$'))
SELECT 'document' AS kind, doc AS id, min(ticker) || ' 10-Q filed ' || min(filed_at) AS text, 'https://www.sec.gov/Archives/edgar/data/' || CAST(any_value(cik) AS BIGINT) || '/' || replace(any_value(acc), '-', '') || '/' || any_value(acc) || '-index.html' AS inputs FROM ok GROUP BY doc
UNION ALL SELECT 'observation', fact_id, ticker || ' ' || concept || ' period ending ' || period_end, doc FROM ok
UNION ALL SELECT 'calculation', calculation_id, ticker || ' ' || array_to_string(list_transform(string_split(metric, '_'), lambda w: upper(w[1]) || w[2:]), ' ') || ' period ending ' || period_end, array_to_string(list_sort(string_split(input_ids, ',')), ',') FROM lin WHERE status = 'available'"""

# --- the quarterly view: a customer's graph has a snapshot a quarter, four calculations of each, and orders as filed facts.
_VIEW_NODES = """SELECT g AS graph_id, 'S' || p AS node_id, 'context' AS kind, p AS label, 'fundamental_snapshot' AS subtype, NULL AS provider, g AS entity, NULL AS metric_id, NULL AS frequency, p AS period_end, k > 4 AS older_quarter FROM s
UNION ALL SELECT g, metric || p, 'calculation', metric, NULL, NULL, g, metric, freq, p, NULL FROM s CROSS JOIN mt
UNION ALL SELECT g, 'O' || o, 'observation', 'order', NULL, provider, g, NULL, NULL, p, NULL FROM oq UNION ALL SELECT g, 'D' || o, 'document', 'filing', NULL, provider, g, NULL, NULL, p, NULL FROM oq
UNION ALL SELECT DISTINCT g, 'P' || provider, 'source', 'by ' || provider, NULL, NULL, g, NULL, NULL, NULL, NULL FROM oq"""
_VIEW_EDGES = """SELECT g AS graph_id, 'S' || p AS source, 'revenue_qoq_growth' || p AS target, 'derived_from' AS kind FROM s UNION ALL SELECT g, 'revenue_qoq_growth' || p, 'O' || o, 'calculated_from' FROM oq
UNION ALL SELECT g, 'O' || o, 'D' || o, 'extracted_from' FROM oq UNION ALL SELECT g, 'D' || o, 'P' || provider, 'published_by' FROM oq"""
_VIEW_BASE = """oq AS (SELECT CAST(o_custkey AS {0}) AS g, CAST(o_orderkey AS {0}) AS o, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) AS {0}) AS p, CASE WHEN o_orderstatus = 'P' THEN 'WIRE' ELSE 'SEC EDGAR' END AS provider FROM {1}),
s AS (SELECT g, p, row_number() OVER (PARTITION BY g ORDER BY p DESC) AS k FROM (SELECT DISTINCT g, p FROM oq) AS d),
mt AS (SELECT * FROM (VALUES ('revenue_qoq_growth', 'quarterly'), ('operating_margin_yoy_change', 'quarterly'), ('cash_qoq_change', 'quarterly'), ('net_debt_yoy_growth', 'annual')) AS t(metric, freq))"""


def _view(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    sql = lambda q: spark.sql(f"WITH {_VIEW_BASE.format('STRING', '{orders}')} {q}", orders=orders)
    expanded = sql("SELECT g AS graph_id, 'S' || p AS node_id FROM s WHERE k = 2 AND g LIKE '%5'")
    nodes, edges = statements.quarterly_view(sql(_VIEW_NODES), sql(_VIEW_EDGES), expanded=expanded)
    return nodes.select("graph_id", F.col("node_id").alias("a"), F.lit(None).cast("string").alias("b")).unionByName(edges.select("graph_id", F.col("source").alias("a"), F.col("target").alias("b")))


_VIEW = f"""WITH {_VIEW_BASE.format("VARCHAR", "orders")}, n AS ({_VIEW_NODES}), e AS ({_VIEW_EDGES}), x AS (SELECT g, p FROM s WHERE k = 2 AND g LIKE '%5'),
shown AS (SELECT g AS graph_id, 'S' || p AS node_id FROM x UNION SELECT g, 'revenue_qoq_growth' || p FROM x UNION SELECT g, 'O' || o FROM x JOIN oq USING (g, p) UNION SELECT g, 'D' || o FROM x JOIN oq USING (g, p) UNION SELECT g, 'P' || provider FROM x JOIN oq USING (g, p)),
kept AS (SELECT graph_id, node_id FROM n WHERE (graph_id, node_id) IN (SELECT * FROM shown) OR (kind = 'context' AND NOT older_quarter) OR (kind IN ('observation', 'document') AND provider = 'WIRE') OR (kind = 'source' AND label = 'by WIRE')
  OR (metric_id IN ('revenue_qoq_growth', 'operating_margin_yoy_change') AND period_end = (SELECT max(p) FROM s WHERE s.g = n.graph_id)))
SELECT graph_id, node_id AS a, NULL AS b FROM kept UNION ALL SELECT graph_id, source, target FROM e WHERE (graph_id, source) IN (SELECT * FROM kept) AND (graph_id, target) IN (SELECT * FROM kept)"""

QUERIES: dict[str, Query] = {"statement_window": _window, "metric_lineage": _lineage, "derived_quarters": _derived, "fact_evidence": _evidence, "quarterly_view": _view}
ORACLE: dict[str, str] = {"statement_window": _WINDOW, "metric_lineage": _LINEAGE, "derived_quarters": _DERIVED, "fact_evidence": _EVIDENCE, "quarterly_view": _VIEW}
