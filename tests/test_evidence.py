"""Facts, news, retrieval, scoring, graphs, universes and streams on small fixtures."""

from __future__ import annotations

import datetime as dt
import threading
import time

from pyspark.sql import functions as F

from marlstone.operators import fundamentals, graph, news, retrieval, scoring, selection, universe
from marlstone.streaming import live

D = dt.date
T = lambda *a: dt.datetime(*a)
FACT = "ticker string, concept string, tag string, alias_rank int, unit string, period_start date, period_end date, value double, form string, filed_at date, accession string"


def fact(concept, start, end, value, filed, accession="a", rank=0, form="10-K"):
    return ("T", concept, concept, rank, "USD", start, end, float(value), form, filed, accession)


def test_restatements_by_cutoff_and_ambiguity(spark):
    y = (D(2020, 1, 1), D(2020, 12, 31))
    rows = [fact("revenue", *y, 1000, D(2021, 2, 1)), fact("revenue", *y, 1500, D(2021, 6, 1), "b"), fact("revenue", *y, 1700, D(2021, 9, 1), "c", form="10-K/A"), fact("cash", None, D(2020, 12, 31), 5, D(2021, 2, 1)), fact("cash", None, D(2020, 12, 31), 6, D(2021, 2, 1), "z"), fact("revenue", D(2020, 1, 1), D(2020, 6, 30), 1, D(2021, 2, 1))]
    facts = spark.createDataFrame(rows, FACT)
    values = {d: [r.value for r in fundamentals.select_facts(facts, d).collect()] for d in ("2021-01-31", "2021-03-01", "2021-07-01", "2022-01-01")}
    assert values == {"2021-01-31": [], "2021-03-01": [1000.0], "2021-07-01": [1500.0], "2022-01-01": [1700.0]}


def test_quarters_by_subtraction(spark):
    ends = [D(2020, 3, 31), D(2020, 6, 30), D(2020, 9, 30), D(2020, 12, 31)]
    rows = [fact("revenue", D(2020, 1, 1), e, 100 * (i + 1) ** 2, e + dt.timedelta(days=30)) for i, e in enumerate(ends)]
    got = {r.quarter: r.value for r in fundamentals.discrete_quarters(spark.createDataFrame(rows, FACT)).collect()}
    assert got == {1: 100.0, 2: 300.0, 3: 500.0, 4: 700.0}
    changes = fundamentals.quarter_changes(fundamentals.discrete_quarters(spark.createDataFrame(rows, FACT))).collect()
    assert {r.cadence for r in changes} == {"qoq"} and sorted(r.change for r in changes) == [200.0, 200.0, 200.0]


def test_metrics_need_positive_denominators(spark):
    y = (D(2020, 1, 1), D(2020, 12, 31))
    facts = spark.createDataFrame([fact(c, *y, v, D(2021, 2, 1)) for c, v in {"revenue": 200, "operating_income": 50, "net_income": -5, "operating_cash_flow": 40, "capex": 10}.items()], FACT)
    got = {r.metric: (r.value, r.status) for r in fundamentals.financial_metrics(facts, ["revenue", "operating_income", "net_income", "operating_cash_flow", "capex"]).collect()}
    assert got["operating_margin"] == (0.25, "available") and got["free_cash_flow"] == (30.0, "available") and got["cash_conversion"] == (None, "unavailable") and got["roic"][1] == "unavailable"


def test_raw_facts_are_exploded(spark):
    json = '{"Revenues":{"units":{"USD":[{"start":"2020-01-01","end":"2020-12-31","val":7.0,"accn":"0000000001-21-000001","form":"10-K","filed":"2021-02-01"}],"EUR":[{"end":"2020-12-31","val":1.0}]}},"Other":{"units":{}}}'
    concepts = spark.createDataFrame([("revenue", "Revenues", 0, "USD")], "concept string, tag string, alias_rank int, unit string")
    out = fundamentals.explode_company_facts(spark.createDataFrame([("T", json)], "ticker string, json string"), concepts).collect()
    assert [(r.concept, r.value, r.period_end) for r in out] == [("revenue", 7.0, D(2020, 12, 31))]


NEWS = "news_id long, ticker string, title string, url string, published_at timestamp, date_only boolean, summary string"


def test_news_never_backdates_a_story(spark):
    rows = [(1, "AXP", "Amex grows!", "https://finnhub.io/1", T(2024, 1, 5, 8), False, "long summary here"), (2, "AXP", "amex GROWS", "https://x.example/2", T(2024, 1, 5, 9), False, ""), (3, "AXP", "Later", "https://x.example/3", T(2024, 1, 7), True, "about American Express"), (4, "AXP", "", "https://x.example/4", T(2024, 1, 5), False, None), (5, "AXP", "Old", "ftp://x", T(2024, 1, 5), False, None)]
    companies = spark.createDataFrame([("AXP", "The American Express Company")], "ticker string, name string")
    got = {r.news_id: r for r in news.news_feed(spark.createDataFrame(rows, NEWS), companies, "2024-01-06 00:00:00").collect()}
    assert set(got) == {2, 3} and got[2].published_at == T(2024, 1, 5, 9) and got[2]["items"] == 2
    assert got[3].availability == "hindsight" and got[3].relevance == 1
    aliases = companies.select(news.company_aliases(F.col("ticker"), F.col("name")).alias("a")).first().a
    assert aliases == ["AXP", "American Express"]


def test_ledger_order_of_rules(spark):
    hits = [(1, 10, "u1", 1, None, False), (1, 11, "u2", 2, T(2024, 2, 1), False), (1, 12, "u3", 3, None, False), (1, 13, "u9", 4, None, False), (2, 20, "u1", 1, None, False), (2, 21, "u4", 2, None, False)]
    docs = [("u1", "d1", T(2024, 1, 1), False), ("u3", "d3", T(2024, 3, 1), False), ("u4", "d4", None, False)]
    out = retrieval.retrieval_ledger(spark.createDataFrame(hits, "task_no int, hit_id long, url string, rank int, published_at timestamp, date_only boolean"), spark.createDataFrame(docs, "url string, document_id string, doc_published_at timestamp, doc_date_only boolean"), as_of="2024-01-15 00:00:00", budget=3)
    assert {r.hit_id: r.status for r in out.collect()} == {10: "fetched", 11: "filtered_future", 12: "filtered_future", 13: "skipped_budget", 20: "reused", 21: "fetched_undated"}


def test_quotes_and_diversity(spark):
    docs = spark.createDataFrame([(1, "the bank said no")], "document_id long, text string")
    claims = spark.createDataFrame([(1, "c", "bank said", 1), (1, "c", '"said no"', 2), (1, "d", "said yes", 3), (1, "c", "bank said", 4)], "document_id long, claim string, quote string, position int")
    assert sorted(r.grounded for r in retrieval.ground_claims(claims, docs).collect()) == ["bank said", "said no"]
    hits = spark.createDataFrame([(1, i, f"q{i % 2}", "p", i, f"u{i % 5}") for i in range(6)], "task_id int, hit_id long, query string, provider string, rank int, url string")
    out = sorted((r.position, r.hit_id) for r in retrieval.select_diverse(hits, 3).collect())
    assert out == [(1, 0), (2, 1), (3, 2)]


def test_score_counts_a_lineage_once_and_drops_late_criteria(spark):
    assess = spark.createDataFrame([(1, T(2024, 1, 3), T(2024, 1, 1, 12), T(2024, 1, 2))], "assessment_id long, as_of_at timestamp, anomaly_start_at timestamp, anomaly_end_at timestamp")
    ev = [(1, i, "primary_source", "supports", "L1", T(2024, 1, 1)) for i in (1, 2)] + [(1, 3, "independent_reporting", "contradicts", "L2", T(2024, 1, 1)), (1, 4, "primary_source", "supports", "L3", T(2024, 1, 2, 12))]
    crit = [(1, c, 1.0, [1]) for c in scoring.SUPPLIED if c != "novelty"] + [(1, "novelty", 1.0, [4])]
    evs = spark.createDataFrame(ev, "assessment_id long, evidence_id long, role string, stance string, lineage_id string, published_at timestamp")
    crits = spark.createDataFrame(crit, "assessment_id long, name string, value double, evidence_ids array<long>")
    r = scoring.causal_score(assess, evs, crits).first()
    assert r.eligible and r.coverage == 0.94 and r.contradiction == 0.8
    assert r.score == round(100 * (0.94 - 0.08 + 0.08 * 0.3333 - 0.25 * 0.8), 1) and r.classification == "plausible"
    bad = crits.unionByName(spark.createDataFrame([(1, "x", 1.0, [99])], crits.schema))
    assert [v.violation for v in scoring.assessment_violations(assess, evs, bad).collect()] == ["unknown evidence"]


def test_score_rounds_halves_away_from_zero(spark):
    assess = spark.createDataFrame([(1, T(2024, 1, 3), T(2024, 1, 1, 12), T(2024, 1, 2))], "assessment_id long, as_of_at timestamp, anomaly_start_at timestamp, anomaly_end_at timestamp")
    ev = [(1, 1, "independent_reporting", "supports", "L1", T(2024, 1, 1)), (1, 2, "independent_reporting", "supports", "L2", T(2024, 1, 1)), (1, 3, "secondary_analysis", "contradicts", "L3", T(2024, 1, 1)), (1, 4, "syndicated_report", "contradicts", "L4", T(2024, 1, 1))]
    evs = spark.createDataFrame(ev, "assessment_id long, evidence_id long, role string, stance string, lineage_id string, published_at timestamp")
    crits = spark.createDataFrame([], "assessment_id long, name string, value double, evidence_ids array<long>")
    assert scoring.causal_score(assess, evs, crits).first().contradiction == 0.5313  # 0.85 / 1.6 = 0.53125


def test_graph_closure_cycles_and_statuses(spark):
    edges = spark.createDataFrame([("g", a, b, "derived_from") for a, b in (("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("z", "gone"))], "graph_id string, source string, target string, kind string")
    assert {(r.root, r.node) for r in graph.lineage_closure(edges).collect()} == {("a", "b"), ("a", "c"), ("b", "c"), ("x", "y"), ("y", "x"), ("x", "x"), ("y", "y"), ("z", "gone")}
    assert {r.node_id for r in graph.cycle_nodes(edges).collect()} == {"x", "y"}
    nodes = spark.createDataFrame([("g", n, "source", T(2024, 1, 1) if n in "c" else None) for n in "abcxyz"], "graph_id string, node_id string, role string, available_at timestamp")
    status = lambda d: {r.node_id: r.status for r in graph.temporal_statuses(nodes, edges, d).collect()}
    assert status("2024-02-01")["a"] == "derived_from_available_evidence" and status("2023-01-01")["a"] == "appeared_after_cutoff"
    assert {status("2024-02-01")[n] for n in "xyz"} == {"date_unknown"}


def test_deep_chains_are_walked_to_their_end(spark):
    n = 53
    edges = spark.createDataFrame([("g", f"n{i}", f"n{i + 1}", "derived_from") for i in range(n)], "graph_id string, source string, target string, kind string")
    nodes = spark.createDataFrame([("g", f"n{i}", "evidence", T(2024, 1, 1) if i == n else None) for i in range(n + 1)], "graph_id string, node_id string, role string, available_at timestamp")
    got = {r.node_id: r.status for r in graph.temporal_statuses(nodes, edges, "2024-02-01").collect()}
    assert got.pop(f"n{n}") == "available_at_cutoff" and set(got.values()) == {"derived_from_available_evidence"}


def test_universe_rules(spark):
    m = spark.createDataFrame([("A", "u", None, "s", None, D(2020, 1, 1), None), ("B", "u", None, "s", "i", D(2020, 1, 1), D(2020, 6, 1)), ("C", "u", "c", "s", "i", D(2020, 1, 1), None), ("E", "u", None, "s", "i", None, None), ("F", "u", None, "s", "i", D(2020, 1, 1), None)], "ticker string, universe string, currency string, sector string, industry string, valid_from date, valid_to date")
    peers = lambda d: sorted((r.ticker, r.peer) for r in universe.pit_peers(m, m.select("ticker"), d).collect())
    assert peers("2020-03-01") == [("A", "B"), ("A", "F"), ("B", "F"), ("F", "B")] and peers("2020-06-01") == [("A", "F")]
    h = spark.createDataFrame([(D(2019, 1, 1), "X"), (D(2019, 6, 1), "A, B"), (D(2020, 6, 1), "C,")], "date date, tickers string")
    assert sorted(r.ticker for r in universe.index_members(h, "2020-01-01", "2020-12-31").collect()) == ["A", "B", "C"]


def test_peers_of_a_large_class_need_no_pairs(spark):
    """All pairs of this class would be 1.6 billion rows, which a minute doesn't do; rows of several classes of a ticker are ranked together."""
    n = 40000
    m = spark.range(n).select(F.format_string("t%05d", "id").alias("ticker"), F.lit("u").alias("universe"), F.lit(None).cast("string").alias("currency"), F.lit("s").alias("sector"), F.when(F.col("id") % 2 == 0, F.lit("i")).alias("industry"), F.lit(D(2020, 1, 1)).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    m = m.unionByName(m.filter("ticker in ('t00001', 't00009')").withColumn("ticker", F.translate("ticker", "19", "84")).withColumn("industry", F.lit(None).cast("string")))
    late = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        rows = universe.pit_peers(m, m.select("ticker"), "2020-03-01").collect()
    finally:
        late.cancel()
    got = {}
    for r in rows:
        got.setdefault(r.ticker, {})[r["rank"]] = r.peer
    assert len(got) == n and got["t00000"] == {1: "t00002", 2: "t00004", 3: "t00006"} and got["t00001"] == {1: "t00000", 2: "t00002", 3: "t00003"}
    assert got["t00008"] == {1: "t00000", 2: "t00001", 3: "t00002"} == got["t00004"] and got["t00006"] == {1: "t00000", 2: "t00002", 3: "t00004"}


def test_streams(spark, tmp_path):
    def run(df, name):
        q = df.writeStream.outputMode("append").format("memory").queryName(name).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
            time.sleep(0.1)
        return spark.table(name).collect()

    rows = [(1, T(2024, 1, 1)), (1, T(2024, 1, 2)), (2, T(2024, 1, 1))]
    spark.createDataFrame(rows, "news_id long, published_at timestamp").coalesce(1).write.parquet(str(tmp_path / "n"))
    assert sorted(r.news_id for r in run(live.news_arrivals(spark.readStream.schema("news_id long, published_at timestamp").parquet(str(tmp_path / "n"))), "arrivals")) == [1, 2]
    bars = [(T(2024, 1, 1), "A", 110.0), (T(2024, 1, 1), "B", 80.0), (T(2024, 3, 1), "A", 100.0), (T(2024, 3, 1), "B", 100.0)]
    spark.createDataFrame(bars, "ts timestamp, ticker string, close double").coalesce(1).write.parquet(str(tmp_path / "b"))
    fits = spark.createDataFrame([("A", "B", 0.0, 1.0, 0.0, 0.1)], "a string, b string, const double, beta double, spread_mean double, spread_std double")
    out = run(live.live_monitor(spark.readStream.schema("ts timestamp, ticker string, close double").parquet(str(tmp_path / "b")), fits), "monitor")
    assert [(r.a, r.b, round(r.z, 3)) for r in out] == [("A", "B", 3.185)]


def test_roles_by_both_ends_of_edges_and_kinds_of_nodes(spark):
    edges = spark.createDataFrame([("g", "a", "h", "supports"), ("g", "h", "b", "supported_by"), ("g", "c", "h", "weakens"), ("g", "h", "d", "contradicted_by"), ("g", "e", "h", "context_for"), ("g", "late", "h", "supports"), ("g", "ctx", "h", "supports")], "graph_id string, source string, target string, kind string")
    nodes = spark.createDataFrame([("g", "a", "evidence"), ("g", "f", "counter_evidence"), ("g", "h", "hypothesis"), ("g", "s", "subclaim"), ("other", "x", "calculation")], "graph_id string, node_id string, kind string")
    fine = [("g", n, "available_at_cutoff") for n in "abcdf"] + [("g", "e", "derived_from_available_evidence"), ("g", "late", "appeared_after_cutoff"), ("g", "ctx", "context")]
    roles = graph.evidence_roles(edges, spark.createDataFrame(fine, "graph_id string, node_id string, status string"), nodes)
    assert {(r.node_id, r.role) for r in roles.collect()} == {("a", "support"), ("b", "support"), ("c", "counter"), ("d", "counter"), ("e", "context"), ("f", "counter")}
    counts = {r.graph_id: r for r in graph.graph_counts(nodes, roles).collect()}
    g, other = counts["g"], counts["other"]
    assert (g.claims, g.hypotheses, g.evidence, g.counter_evidence, g.context, g.calculations) == (1, 1, 2, 3, 1, 0)
    assert (other.calculations, other.evidence, other.claims) == (1, 0, 0)


def test_coverage_diagnostics_and_pair_sets(spark):
    required = spark.createDataFrame([("g", s) for s in ("satisfied", "satisfied", "partial", "unsatisfied", None, "odd")], "graph_id string, status string")
    assert [tuple(r) for r in graph.requirement_coverage(required).collect()] == [("g", 6, 2, 2)]
    assessed = spark.createDataFrame([("g", "claim", "supports"), ("g", "claim", "supports"), ("g", "inference", "weakens"), ("g", "novel", "supports")], "graph_id string, source_kind string, relation string")
    rows = {(r.source_kind, r.relation): r.n for r in graph.relationship_diagnostics(assessed).collect()}
    assert len(rows) == 25 and sum(n for (k, _), n in rows.items() if k != "all") == 3  # a kind of its own counts in the sum alone
    assert rows["all", "supports"] == 3 and rows["claim", "supports"] == 2 and rows["inference", "weakens"] == 1 and rows["calculation", "unrelated"] == 0
    schema = "source_kind string, source_id long, hypothesis_id long"
    expected = spark.createDataFrame([("claim", 1, 1), ("claim", 2, 1)], schema)
    returned = spark.createDataFrame([("claim", 1, 1), ("claim", 1, 1), ("claim", 3, 1), ("claim", 3, 1)], schema)
    found = {(r.source_id, r.violation) for r in graph.pair_set_violations(expected, returned).collect()}
    assert found == {(2, "missing"), (1, "repeated"), (3, "unexpected"), (3, "repeated")}
    assert graph.pair_set_violations(expected, expected).isEmpty()


def test_unique_items_keep_the_first(spark):
    lists = spark.createDataFrame([(1, [" Oil ", "gas", "OIL", "", None, "Gas", "coal"]), (2, ["  "]), (3, None)], "list_id long, items array<string>")
    assert [tuple(r) for r in selection.unique_items(lists).collect()] == [(1, ["Oil", "gas", "coal"])]
