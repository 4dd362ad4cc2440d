"""Investigation graphs, statements, screens, research plans and market context on small fixtures."""

from __future__ import annotations

import datetime as dt
import re
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.operators import context, investigation, pairs, research, screens, statements
from marlstone.plans import investigation_queries, scan_queries
from marlstone.plans.shared import shared_folder

SCHEMAS = {
    "investigations": "graph_id string, anomaly_id string, summary string", "documents": "graph_id string, document_id string, publisher string, host string, title string", "model_runs": "graph_id string, run_id string, provider string, model string, operation string",
    "claims": "graph_id string, claim_id string, document_id string, model_run_id string, text string", "hypotheses": "graph_id string, hypothesis_id string, model_run_id string, text string", "audits": "graph_id string, audit_id string, hypothesis_id string, model_run_id string, assumptions array<string>, missing array<string>",
    "assessments": "graph_id string, assessment_id string, source_kind string, source_id string, target_kind string, target_id string, relation string, model_run_id string", "requirements": "graph_id string, requirement_id string, hypothesis_id string, model_run_id string, question string",
    "observations": "graph_id string, observation_id string, source_document_id string, name string, value string, unit string", "calculations": "graph_id string, calculation_id string, label string, value string, unit string, input_observation_ids array<string>, input_calculation_ids array<string>, ticker string, frequency string, period_end date, status string",
    "inferences": "graph_id string, inference_id string, model_run_id string, text string, derived_from_ids array<string>", "bundles": "graph_id string, ticker string, status string", "snapshots": "graph_id string, snapshot_id string, ticker string, fiscal_year int, fiscal_quarter int, period_end date, metric_ids array<string>",
}
DAY = dt.date(2024, 3, 31)
WHOLE = {
    "investigations": [("g", "A", "fell")], "documents": [("g", "D", None, "h.example", "News")], "model_runs": [("g", "R", "p", "m", "op")], "claims": [("g", "C", "D", "R", "it fell")], "hypotheses": [("g", "H", "R", "demand")], "audits": [("g", "U", "H", "R", ["steady prices"], ["orders"])],
    "assessments": [("g", "S1", "claim", "C", "hypothesis", "H", "supports", "R"), ("g", "S2", "claim", "C", "hypothesis", "H", "supports", "R"), ("g", "S3", "observation", "O", "hypothesis", "H", "unrelated", "R")], "requirements": [("g", "Q", "H", "R", "why")], "observations": [("g", "O", "D", "revenue", "5", "USD")],
    "calculations": [("g", "K1", "growth", "2", None, ["O"], [], "T", "quarterly", DAY, "available"), ("g", "K2", "trend", "3", None, [], ["K1"], "T", "annual", DAY, "available")], "inferences": [("g", "I", "R", "weak", ["C", "K2"])], "bundles": [("g", "X", "unavailable")], "snapshots": [("g", "F", "T", 2024, 1, DAY, ["O", "K1"])],
}


def graph(spark, **changed):
    t = {name: spark.createDataFrame([*rows, *changed.get(name, [])], SCHEMAS[name]) for name, rows in WHOLE.items()}
    return investigation.investigation_graph(t)


def test_a_whole_graph_has_no_violations(spark):
    nodes, edges, violations = graph(spark)
    assert violations.count() == 0
    ends = {r.node_id for r in nodes.collect()}
    rows = edges.collect()
    assert all(r.source in ends and r.target in ends for r in rows) and len({r.edge_id for r in rows}) == len(rows)
    of = {(r.source, r.kind, r.target) for r in rows}
    assert {("hypothesis:H", "candidate_explanation_for", "anomaly:A"), ("hypothesis:H", "requires", "assumption:U:1"), ("anomaly:A", "requires", "missing_evidence:fundamentals-X"), ("context:F", "derived_from", "observation:O"), ("context:F", "context_for", "calculation:K1"), ("inference:I", "derived_from", "calculation:K2")} <= of
    assert sum(r.kind == "supports" for r in rows) == 2 and not any(r.kind == "unrelated" for r in rows)  # two judgements of one pair stay apart


BROKEN = [
    ("claims", ("g", "C2", "D9", "R", "x"), "claim document", "D9"), ("claims", ("g", "C2", "D", "R9", "x"), "claim run", "R9"), ("hypotheses", ("g", "H2", "R9", "x"), "hypothesis run", "R9"), ("audits", ("g", "U2", "H9", "R", [], []), "audit hypothesis", "H9"), ("audits", ("g", "U2", "H", "R9", [], None), "audit run", "R9"),
    ("assessments", ("g", "S4", "claim", "C9", "hypothesis", "H", "supports", "R"), "assessment source", "C9"), ("assessments", ("g", "S4", "claim", "C", "inference", "H", "weakens", "R"), "assessment target", "H"), ("assessments", ("g", "S4", "claim", "C", "hypothesis", "H", "supports", "R9"), "assessment run", "R9"),
    ("requirements", ("g", "Q2", "H9", "R", "x"), "evidence_requirement hypothesis", "H9"), ("requirements", ("g", "Q2", "H", "R9", "x"), "evidence_requirement run", "R9"), ("observations", ("g", "O2", "D9", "n", "1", None), "observation document", "D9"), ("calculations", ("g", "K3", "l", "1", None, ["O9"], [], "T", "annual", DAY, "available"), "calculation observation", "O9"),
    ("calculations", ("g", "K3", "l", "1", None, [], ["K9"], "T", "annual", DAY, "available"), "calculation calculation", "K9"), ("inferences", ("g", "I2", "R", "x", ["N9"]), "inference derived", "N9"), ("inferences", ("g", "I2", "R9", "x", ["C"]), "inference run", "R9"), ("snapshots", ("g", "F2", "T", 2024, 2, DAY, ["M9"]), "context metric", "M9"),
    ("claims", ("g", "C", "D", "R", "again"), "duplicate claim", None), ("observations", ("g", "C", "D", "n", "1", None), "ambiguous", None), ("claims", ("other", "C", "D", "R", "elsewhere"), "claim document", "D"),
]


@pytest.mark.parametrize("case", range(0, len(BROKEN), 4))
def test_each_kind_of_broken_reference_is_found(spark, case):
    """Four breaks at a time, each in a graph of its own beside the whole one."""
    changed: dict[str, list] = {}
    want = set()
    for k, (name, row, check, ref) in enumerate(BROKEN[case : case + 4]):
        g = f"{row[0]}{k}"
        for other, rows in WHOLE.items():
            changed.setdefault(other, []).extend([(g, *r[1:]) for r in rows] if row[0] == "g" else [])
        changed[name].append((g, *row[1:]))
        want.add((g, check, ref))
    _, edges, violations = graph(spark, **changed)
    got = {(r.graph_id, r.check, r.ref) for r in violations.collect()}
    assert want <= got and {g for g, _, _ in got} == {g for g, _, _ in want}
    assert edges.filter(F.col("target").rlike("9$")).count() == 0


def test_cycles_of_calculations(spark):
    k = lambda a, *b: ("g", a, "l", "1", None, [], list(b), "T", "annual", DAY, "available")
    violations = graph(spark, calculations=[k("Z1", "Z2"), k("Z2", "Z3"), k("Z3", "Z1"), k("Z0", "Z1")])[2]
    assert {(r.check, r.id) for r in violations.collect()} == {("cycle", f"Z{i}") for i in range(4)}


def test_nodes_and_affected_hypotheses_read_no_other_references(spark, monkeypatch):
    whole = {name: spark.createDataFrame(rows, SCHEMAS[name]) for name, rows in WHOLE.items()}
    no = F.raise_error(F.lit("read")).cast("string")
    t = whole | {"assessments": whole["assessments"].withColumn("source_id", no)}
    assert investigation.investigation_graph(t)[0].count() == 16
    t = whole | {"claims": whole["claims"].withColumn("document_id", no)}
    monkeypatch.setattr(investigation_queries, "tables", lambda *_: dict(t))
    assert [tuple(r) for r in investigation_queries.QUERIES["affected_hypotheses"](spark, "").collect()] == [("g", "evidence_requirement:Q", "hypothesis:H")]


def test_edges_and_audit_resolve_references_in_one_shuffle(spark):
    t = {name: spark.createDataFrame([*rows, *rows], SCHEMAS[name]) for name, rows in WHOLE.items()}
    written = lambda: set(Path(shared_folder(spark)).glob("*/references"))
    before = written()
    _, edges, violations = investigation.investigation_graph(t)
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(graph_id" in plan and not any("edge_id" in line for line in plan.splitlines() if "hashpartitioning" in line) and written() == before
    rows = [tuple(r) for r in edges.collect()]
    once = [tuple(r) for r in graph(spark)[1].collect()]
    assert sorted(rows) == sorted(once)  # of rows that are there twice an edge is given once
    assert {r.check.split()[0] for r in violations.collect()} == {"duplicate"}


def test_cycles_of_the_query_need_no_lines(spark, tmp_path):
    for name in ("orders", "customer"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    got = investigation_queries.QUERIES["cycle_nodes"](spark, str(tmp_path)).collect()
    assert all(r.node_id.startswith("calculation:K") for r in got)


def test_the_quarterly_view_joins_no_nodes(spark):
    columns = "graph_id string, node_id string, kind string, label string, subtype string, provider string, entity string, metric_id string, frequency string, period_end string, older_quarter boolean"
    quarter = lambda g, s, p, old: (g, s, "context", p, "fundamental_snapshot", None, "e", None, None, p, old)
    calc = lambda g, n, p, entity="e": (g, n, "calculation", n, None, None, entity, "revenue_qoq_growth", "quarterly", p, None)
    filed = lambda g, n: (g, n, "observation", n, None, "SEC EDGAR", "e", None, None, "1", None)
    nodes = spark.createDataFrame([quarter("g", "S1", "1", True), quarter("g", "S2", "2", False), calc("g", "K1", "1"), calc("g", "K2", "2"), calc("g", "K0", "2", None), filed("g", "O1"), filed("g", "O2"), filed("plain", "O1"), (None, *filed("g", "N")[1:])], columns)
    edges = spark.createDataFrame([("g", "S1", "K1", "derived_from"), ("g", "K1", "O1", "calculated_from"), ("g", "K2", "O2", "calculated_from"), ("g", "S2", "K2", "derived_from")], "graph_id string, source string, target string, kind string")
    kept, links = statements.quarterly_view(nodes, edges, expanded=spark.createDataFrame([("g", "S1"), ("g", "gone")], "graph_id string, node_id string"))
    assert "Join" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(((r.graph_id or "", r.node_id) for r in kept.collect())) == [("", "N"), ("g", "K1"), ("g", "K2"), ("g", "O1"), ("g", "S1"), ("g", "S2"), ("plain", "O1")]
    assert sorted((r.source, r.target) for r in links.collect()) == [("K1", "O1"), ("S1", "K1"), ("S2", "K2")]


def facts(spark, rows):
    return statements.with_fact_ids(spark.createDataFrame([("T", c, c, "USD", s, e, v, "10-K", dt.date(2024, 2, 1), "0000000001-24-000001") for c, s, e, v in rows], "ticker string, concept string, tag string, unit string, period_start date, period_end date, value double, form string, filed_at date, accession string"))


def test_metrics_carry_their_facts_and_reasons(spark):
    year = lambda y: (dt.date(y, 1, 1), dt.date(y, 12, 31))
    rows = [("revenue", *year(2023), 200.0), ("revenue", *year(2022), 160.0), ("operating_income", *year(2023), 50.0), ("operating_cash_flow", *year(2023), 40.0), ("capex", *year(2023), -5.0), ("net_income", dt.date(2023, 2, 1), dt.date(2023, 12, 31), 20.0), ("total_assets", None, dt.date(2022, 12, 31), 90.0), ("total_assets", None, dt.date(2023, 12, 31), 110.0), ("cash", None, dt.date(2023, 12, 31), 7.0)]
    f = facts(spark, rows)
    ids = {(r.concept, r.period_end.year): r.fact_id for r in f.collect()}
    out = {(r.metric, r.period_end.year): r for r in statements.metric_lineage(f).collect()}
    assert out["operating_margin", 2023].value == 0.25 and set(out["operating_margin", 2023].fact_ids) == {ids["revenue", 2023], ids["operating_income", 2023]}
    assert out["revenue_growth_yoy", 2023].value == pytest.approx(0.25) and set(out["revenue_growth_yoy", 2023].input_ids) == {ids["revenue", 2023], ids["revenue", 2022]}
    assert out["free_cash_flow", 2023].reason == "capex_outflow: Negative SEC payments value: capex sign is ambiguous; not silently inverted" and out["free_cash_flow", 2023].fact_ids == []
    assert out["net_margin", 2023].reason == "Incompatible duration contexts" and out["net_debt", 2023].reason == "total_debt: Missing short_term_debt at 2023-12-31"
    assert out["asset_turnover", 2023].reason == "average_assets: Unambiguous duration start required for beginning balance"  # net income starts on another day
    clean = {(r.metric, r.period_end.year): r for r in statements.metric_lineage(f.filter("concept <> 'net_income'")).collect()}
    turnover = clean["asset_turnover", 2023]
    assert turnover.value == 2.0 and set(turnover.fact_ids) == {ids["revenue", 2023], ids["total_assets", 2022], ids["total_assets", 2023]} and clean["average_assets", 2023].calculation_id in turnover.input_ids
    barred = {r.metric: r.status for r in statements.metric_lineage(f, financial=True).filter("year(period_end) = 2023").collect()}
    assert barred["roic"] == "not_applicable" and barred["operating_margin"] == "available"


def twins(n=330, seed=0):
    """Two cointegrated pairs in one group, with holidays of their own, and a shock near the end."""
    rng = np.random.default_rng(seed)
    common, noise = 4 + np.cumsum(rng.normal(0, 0.012, n)), rng.normal(0, 0.002, n)
    noise[300] = 0.07
    days = [dt.date(2023, 1, 2) + dt.timedelta(days=k + 2 * (k // 5)) for k in range(n)]
    value = {"AAA": common + noise, "BBB": common, "CCC": common + noise, "DDD": common}
    return [("EU", days[k], t, float(np.exp(v[k]))) for t, v in value.items() for k in range(n) if k not in ({15, 45} if t in ("AAA", "BBB") else {25, 55})], days


def test_scan_queries_make_their_bars_once(spark, monkeypatch):
    """What the steps read is a written table, not the lines again."""
    rows, days = twins()
    lines = spark.createDataFrame(rows, "grp string, date date, ticker string, close double").hint("merge")
    monkeypatch.setattr(scan_queries, "twins", lambda *_: lines)
    seen = []
    monkeypatch.setattr(screens, "universe_fits", lambda bars, dates, **_: seen.append(bars) or spark.createDataFrame([(days[0], 1.0)], "as_of date, x double"))
    scan_queries.QUERIES["universe_fits"](spark, "").collect()
    assert len(seen[0].inputFiles()) > 0 and seen[0].count() == len(rows)


def test_scans_of_many_dates_agree_with_single_ones(spark):
    rows, days = twins()
    bars = spark.createDataFrame(rows, "grp string, date date, ticker string, close double")
    dates = spark.createDataFrame([(days[k],) for k in (290, 300, 305)], "as_of date")
    found = screens.scan_history(bars, dates).select("as_of", "a", "b", "z", "pvalue", "correlation", "beta").collect()
    assert days[300] in {r.as_of for r in found}
    single = {(r.as_of, r.a, r.b): r for r in pairs.scan_as_of(bars, dates, floor=0.5, alpha=0.1, entry=1.5).collect()}
    assert {(r.as_of, r.a, r.b) for r in found} == {k for k, r in single.items() if r.correlation >= 0.65 and r.pvalue < 0.05}
    for r in found:
        s = single[r.as_of, r.a, r.b]
        assert (r.z, r.pvalue, r.correlation, r.beta) == pytest.approx((s.z, s.pvalue, s.correlation, s.beta), rel=1e-6)
    later = spark.createDataFrame([(g, d, t, c * 999 if d > days[300] else c) for g, d, t, c in rows] + [("EU", days[-1] + dt.timedelta(days=9), "FUTURE", 999.0)], bars.schema)
    again = screens.scan_history(later, dates.filter(F.col("as_of") == F.lit(days[300]))).select("as_of", "a", "b", "z", "pvalue", "correlation", "beta").collect()
    assert sorted(again) == sorted(r for r in found if r.as_of == days[300])
    both = bars.unionByName(bars.withColumn("grp", F.lit("ZZ")))
    assert screens.scan_history(both, dates).count() == len(found)  # a pair of two groups counts once
    with pytest.raises(ValueError):
        screens.scan_history(bars, dates, most=0.0)


def test_rolling_sums_match_direct_correlations(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 5))
    x[rng.random(x.shape) < 0.1] = np.nan
    returns = spark.createDataFrame([("g", f"t{j}", i, float(x[i, j])) for i in range(700) for j in range(5) if not np.isnan(x[i, j])], "grp string, ticker string, d int, r double")
    spans = [(dt.date(2020, 1, 1) + dt.timedelta(days=k), max(0, k - 60), k) for k in (*range(40, 700, 7), 700)]
    window = spark.createDataFrame([("g", *s) for s in spans], "grp string, as_of date, low int, high int")
    got = {(r.as_of, r.a, r.b): (r.correlation, r.n) for r in screens.rolling_correlation(returns, window, least_rows=20, floor=-1.0, block=2).collect()}
    assert len(got) == 10 * len(spans)
    for as_of, low, high in spans:
        for a in range(5):
            for b in range(a + 1, 5):
                ok = ~np.isnan(x[low:high, a]) & ~np.isnan(x[low:high, b])
                c = np.corrcoef(x[low:high, a][ok], x[low:high, b][ok])[0, 1]
                assert got[as_of, f"t{a}", f"t{b}"] == (pytest.approx(c, abs=1e-9), ok.sum())


def test_complete_cases_need_every_date(spark):
    rows, days = twins()
    bars = spark.createDataFrame(rows, "grp string, date date, ticker string, close double")
    tickers = lambda *span: {r.ticker for r in screens.complete_cases(bars, *map(str, span)).select("ticker").distinct().collect()}
    assert tickers(days[60], days[299]) == {"AAA", "BBB", "CCC", "DDD"} and tickers(days[20], days[40]) == {"AAA", "BBB"} and tickers(days[0], days[60]) == set()
    fits = screens.screen_pairs(bars, str(days[60]), str(days[299])).collect()
    assert ("AAA", "BBB") in {(r.a, r.b) for r in fits} and all(r.pvalue < 0.01 and r.correlation >= 0.7 for r in fits)
    with pytest.raises(Exception, match="prices above 0"):
        screens.complete_cases(bars.withColumn("close", -F.col("close")), str(days[60]), str(days[70])).collect()


def test_arguments_prefer_what_no_calculation_uses(spark):
    columns = "investigation_id int, argument_id string, kind string, text string, metric_id string, period_end date, frequency string, input_observation_ids array<string>"
    rows = [(1, f"o{k}", "observation", "revenue and demand", None, DAY, None, None) for k in range(4)] + [(1, "k", "calculation", "demand", "revenue_yoy_growth", DAY, "quarterly", ["o0", "o1"])] + [(1, f"c{k}", "claim", "demand fell" if k == 7 else "other", None, None, None, None) for k in range(9)] + [(1, "x", "unknown", "demand", None, None, None, None)]
    hypotheses = spark.createDataFrame([(1, "h", "Demand because of the company"), (2, "none", "x")], "investigation_id int, hypothesis_id string, text string")
    out = [(r.kind, r.argument_id) for r in research.select_arguments(spark.createDataFrame(rows, columns), hypotheses).orderBy("position").collect()]
    assert out[0] == ("claim", "c7") and out[6:9] == [("calculation", "k"), ("observation", "o2"), ("observation", "o3")] and len(out) == 14 and out[-2:] == [("observation", "o0"), ("observation", "o1")]
    assert research.select_arguments(spark.createDataFrame(rows, columns), hypotheses, limit=3).count() == 3


def test_of_lines_with_one_id_the_first_of_the_table_is_the_argument(spark, tmp_path):
    day = dt.datetime(1995, 1, 1)
    lines = pd.DataFrame([(1, 2, 3, 4, 5.0, day), (1, 3, 3, 4, 20.0, day - dt.timedelta(days=9))], columns=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate"])
    later = pd.DataFrame([(1, 2, 3, 4, 20.0, day)] + [(k, k % 3, k, k % 7, 10.0, day + dt.timedelta(hours=k)) for k in range(10, 3000)], columns=lines.columns)
    (tmp_path / "lineitem.parquet").mkdir()
    for name, df in (("lineitem.parquet/a.parquet", lines), ("lineitem.parquet/b.parquet", later)):  # the larger file is read first
        df.astype({"l_shipdate": "datetime64[us]"}).to_parquet(tmp_path / name)
    pd.DataFrame({"o_orderkey": [1], "o_custkey": [1]}).to_parquet(tmp_path / "orders.parquet")
    pd.DataFrame({"p_partkey": [2, 3], "p_name": ["a", "a"], "p_type": ["LARGE TIN", "LARGE TIN"]}).to_parquet(tmp_path / "part.parquet")
    out = scan_queries.QUERIES["select_arguments"](spark, str(tmp_path)).orderBy("position").collect()
    assert [r.argument_id for r in out] == ["1-4-3", "1-4-2"]  # the later row of 1-4-2 would have a period and come first


def chosen(arguments, hypothesis, text, limit):
    """The choice of one hypothesis, one argument after the other."""
    terms = set(re.findall("[a-z]{3,}", text.lower())) - set(research.PLAIN)
    words = lambda a: set(re.findall("[a-z]{3,}", f"{a[3]} {a[4] or ''}".replace("_", " ").lower()))
    key = lambda a: (-len(terms & words(a)), -(a[5].toordinal() if a[5] else 0), a[6] != "quarterly", not re.search(research.TREND, a[4] or ""), a[1])
    by = {k: sorted((a for a in arguments if a[2] == k), key=key) for k, _ in research.BUDGETS}
    used = {i for a in by["calculation"][:6] for i in a[7] or []}
    by["observation"].sort(key=lambda a: a[1] in used)
    rows = [a for k, n in research.BUDGETS for a in by[k][:n]] + [a for k, n in research.BUDGETS for a in by[k][n:]]
    return [(hypothesis, a[2], a[1], at) for at, a in enumerate(rows[:limit], 1)]


def test_arguments_are_those_of_a_choice_one_after_the_other(spark):
    columns = "investigation_id int, argument_id string, kind string, text string, metric_id string, period_end date, frequency string, input_observation_ids array<string>"
    rng = np.random.default_rng(5)
    pick = lambda *values: values[rng.integers(len(values))]
    rows, texts = [], ["demand and margin", "price growth", "", "peer revenue because of demand"]
    for g in range(12):
        for k in range(rng.integers(1, 60)):
            kind = pick("claim", "calculation", "observation", "inference", "unknown")
            inputs = pick(None, [], [f"{g}-{i}" for i in rng.integers(60, size=5)], [None, f"{g}-{k - 1}"]) if kind in ("calculation", "claim") else None
            rows.append((g, f"{g}-{k}", kind, pick("demand fell", "margin", "revenue"), pick(None, "price_yoy_growth", "margin_peer"), pick(None, DAY, DAY - dt.timedelta(days=90)), pick(None, "quarterly", "annual"), inputs))
    a, h = spark.createDataFrame(rows, columns), [(g, f"h{g}-{i}", t) for g in range(11) for i, t in enumerate(texts)]
    for limit in (1, 9, 20):
        expected = [r for g, name, text in h for r in chosen([x for x in rows if x[0] == g], name, text, limit)]
        out = research.select_arguments(a, spark.createDataFrame(h, "investigation_id int, hypothesis_id string, text string"), limit=limit)
        assert sorted(map(tuple, out.collect())) == sorted(expected)
    own = [(*r, f"{r[0]}-{r[3]}", r[3]) for r in rows] + [(None, "lost", "claim", "demand", None, None, None, None, "lost", "demand")]
    expected = [r for g, name, text in {(r[0], r[8], r[9]) for r in own if r[0] is not None} for r in chosen([x for x in rows if x[0] == g], name, text, 16)]
    out = research.select_arguments(spark.createDataFrame(own, columns + ", hypothesis_id string, hypothesis_text string"))
    assert sorted(map(tuple, out.collect())) == sorted(expected)


def test_arguments_move_before_they_meet_the_hypotheses_and_not_after(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large to broadcast
    try:
        plan = scan_queries.QUERIES["select_arguments"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    # Lines by order, orders, these lines by part, parts, and all by customer. Each line is read and each pair of line and hypothesis sorted once.
    assert re.findall(r"Exchange hashpartitioning\((\w+)#", plan) == ["o_custkey", "l_partkey", "l_orderkey", "o_orderkey", "p_partkey"] and plan.count("Exchange") == 5
    assert plan.count("FileScan") == 3 and plan.count("Sort [investigation_id#") == 2


def test_an_order_or_part_that_occurs_twice_gives_an_argument_once(spark, tmp_path):
    day = dt.datetime(1995, 1, 1)
    lines = pd.DataFrame([(1, 2, 3, n, 20.0, day) for n in (1, 2, 4)] * 2, columns=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate"])
    lines.astype({"l_shipdate": "datetime64[us]"}).to_parquet(tmp_path / "lineitem.parquet")
    pd.DataFrame({"o_orderkey": [1, 1], "o_custkey": [7, 8]}).to_parquet(tmp_path / "orders.parquet")
    pd.DataFrame({"p_partkey": [2, 2], "p_name": ["a b", "a c"], "p_type": ["LARGE", "SMALL"]}).to_parquet(tmp_path / "part.parquet")
    out = scan_queries.QUERIES["select_arguments"](spark, str(tmp_path)).orderBy("position").collect()
    assert [(r.hypothesis_id, r.argument_id) for r in out] == [("7-b", "1-4-2"), ("7-b", "1-1-2"), ("7-b", "1-2-2")]


def test_context_stops_at_gaps(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(30)]
    bars = spark.createDataFrame([("A", d, 100.0 + k) for k, d in enumerate(days)] + [("B", d, 50.0) for k, d in enumerate(days) if not 10 <= k < 18], "ticker string, date date, close double")
    out = {(r.ticker, r.n): r for r in context.market_context(bars).collect()}
    assert out["A", 20].value == pytest.approx(129 / 109 - 1) and out["A", 63].status == "unavailable" and out["B", 5].status == "available" and out["B", 20].reason == "Insufficient contiguous history: 20 sessions"
    nodes, edges = context.market_graph(context.market_context(bars))
    assert nodes.count() == nodes.select("node_id").distinct().count() and edges.count() == 2 * nodes.filter("kind = 'calculation'").count()
    assert nodes.filter("label like 'A close 2024-01-30'").count() == 1  # the end that all windows share
