"""Statements over filed facts: windows of periods, ratios with their lineage, derived quarters, evidence tables and the quarterly view of a graph.

Facts are those of ``fundamentals.select_facts`` with a ``fact_id``: (ticker, concept, tag, unit, period_start, period_end, value, form, filed_at, accession, fact_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.operators.fundamentals import INDUSTRIAL, discrete_quarters
from marlstone.operators.graph import lineage_closure
from marlstone.operators.selection import stable_id
from marlstone.plans.shared import written

#: Fixed values: (metric, numerator, denominator) of the margins of a quarter.
MARGINS = [("gross_margin", "gross_profit", "revenue"), ("operating_margin", "operating_income", "revenue"), ("net_margin", "net_income", "revenue"), ("free_cash_flow_margin", "free_cash_flow", "revenue")]
DEBT = "short_term_debt current_long_term_debt long_term_debt finance_lease_current finance_lease_noncurrent".split()
COMPARED = "revenue operating_cash_flow capex cash net_debt shares_outstanding diluted_shares gross_margin operating_margin net_margin free_cash_flow_margin".split()
#: What the registry of ratios takes, beside the debt's parts.
TAKEN = "revenue operating_income net_income operating_cash_flow capex depreciation_and_amortization interest_expense tax_expense pretax_income diluted_shares cash total_debt current_assets current_liabilities total_assets shareholders_equity".split()
#: Fixed value: what a filing's accession number looks like.
ACCESSION = r"^\d{10}-\d{2}-\d{6}$"


def with_fact_ids(facts: DataFrame) -> DataFrame:
    """Facts with ``fact_id``, the same for the same filing, concept and period."""
    return facts.withColumn("fact_id", stable_id("FACT", F.col("ticker"), F.col("concept"), F.col("period_start"), F.col("period_end"), F.col("accession")))


def statement_window(facts: DataFrame, periods: int, *, before: int = 1) -> DataFrame:
    """The facts that the last ``periods`` period ends need (C14): theirs, those of the ``before`` ends ahead of them, and the balances on the day before each of their periods.

    Period ends are those of facts with a duration; a ticker with fewer ends has fewer. Ranking sees one row an end, not the facts.
    """
    ends = facts.filter("period_start is not null").select("ticker", "period_end").distinct()
    ends = ends.withColumn("_k", F.row_number().over(W.partitionBy("ticker").orderBy(F.col("period_end").desc())))
    own = ends.filter(F.col("_k") <= periods).select("ticker", "period_end")
    opening = facts.filter("period_start is not null").join(own, ["ticker", "period_end"], "left_semi").select("ticker", F.date_sub("period_start", 1).alias("period_end"))
    keep = ends.filter(F.col("_k") <= periods + before).select("ticker", "period_end").unionByName(opening).distinct()
    return facts.join(keep, ["ticker", "period_end"], "left_semi")


# --- ratios with lineage: a value is a struct of what it is (v), the facts behind it (f), its direct inputs (i), the starts of the durations
# that end with its period (s), and why it is missing (w).
_EMPTY = "CAST(array() AS array<string>)"


def _value(v: Column, f: Column, i: Column, s: Column, w: Column) -> Column:
    return F.struct(v.cast("double").alias("v"), f.alias("f"), i.alias("i"), s.alias("s"), w.cast("string").alias("w"))


def _nothing(why: Column) -> Column:
    none = F.expr(_EMPTY)
    return _value(F.lit(None), none, none, F.expr("CAST(array() AS array<date>)"), why)


def _fact(concept: str, cell: Column, end: Column) -> Column:
    """A fact (value, id, start) as a value."""
    held = _value(cell["value"], F.array(cell["id"]), F.array(cell["id"]), F.array_compact(F.array(cell["start"])), F.lit(None))
    return F.when(cell.isNotNull(), held).otherwise(_nothing(F.concat(F.lit(f"Missing {concept} at "), F.coalesce(end.cast("string"), F.lit("None")))))


def _made(metric: str, inputs: list[tuple[str, Column, bool]], value: Column, *checks: tuple[Column, str]) -> Column:
    """A metric from inputs (name, value, whether it is a metric): the first reason of an input, else of a check, is its own."""
    whys = [F.concat(F.lit(f"{name}: "), x["w"]) if made else x["w"] for name, x, made in inputs]
    starts = F.array_distinct(F.flatten(F.array(*[x["s"] for _, x, _ in inputs])))
    own = [F.when(cond, why) for cond, why in checks] + [F.when(F.size(starts) > 1, "Incompatible duration contexts")]
    why = F.coalesce(*whys, *own)
    facts = F.array_sort(F.array_distinct(F.flatten(F.array(*[x["f"] for _, x, _ in inputs]))))
    ident = lambda name, x: stable_id("FIN", F.col("ticker"), F.lit(name), F.col("period_end"), F.array_join(x["i"], ","))
    direct = F.flatten(F.array(*[F.array(ident(name, x)) if made else x["i"] for name, x, made in inputs]))
    return F.when(why.isNull(), _value(value, facts, F.array_distinct(direct), starts, F.lit(None))).otherwise(_nothing(why))


_POSITIVE = "Denominator must be positive; ratio not meaningful"


def metric_lineage(facts: DataFrame, *, financial: bool = False) -> DataFrame:
    """(ticker, period_end, metric, calculation_id, value, status, reason, input_ids, fact_ids): the registry of ratios over annual facts, each with the facts that it was made from.

    A value that can't be computed has the reason of its first missing input, and no ids. Concepts become columns of one wide table, which is written once;
    metrics follow each other as columns in the order in which they need each other; earlier balances and comparable periods come by two joins on it.
    """
    cell = F.struct("value", F.col("fact_id").alias("id"), F.col("period_start").alias("start"))
    names = [*TAKEN, *DEBT]
    wide = facts.groupBy("ticker", "period_end").agg(*[F.max(F.when(F.col("concept") == c, cell)).alias(c) for c in names], F.min("period_start").alias("_s"), F.max("period_start").alias("_s2"))
    end = F.col("period_end")
    df = wide.select("ticker", "period_end", F.when(F.col("_s") == F.col("_s2"), F.col("_s")).alias("start"), *[_fact(c, F.col(c), end).alias(c) for c in names], *[F.col(c).alias(f"_{c}") for c in ("revenue", "diluted_shares")])
    c = F.col
    raw = lambda *cs: [(x, c(x), False) for x in cs]
    made = lambda *cs: [(x, c(x), True) for x in cs]
    v = lambda x: c(x)["v"]
    debt = F.when(c("total_debt")["w"].isNull(), c("total_debt")).otherwise(_made("total_debt", raw(*DEBT), sum((v(x) for x in DEBT[1:]), v(DEBT[0]))))
    df = df.withColumns({
        "total_debt": debt,
        "capex_outflow": _made("capex_outflow", raw("capex"), v("capex"), (v("capex") < 0, "Negative SEC payments value: capex sign is ambiguous; not silently inverted")),
        "working_capital": _made("working_capital", raw("current_assets", "current_liabilities"), v("current_assets") - v("current_liabilities")),
        "derived_ebitda": _made("derived_ebitda", raw("operating_income", "depreciation_and_amortization"), v("operating_income") + v("depreciation_and_amortization"), (v("depreciation_and_amortization") < 0, "Negative D&A is unsuitable for derived EBITDA")),
        "effective_tax_rate": _made("effective_tax_rate", raw("tax_expense", "pretax_income"), v("tax_expense") / F.when(v("pretax_income") > 0, v("pretax_income")), (v("pretax_income") <= 0, _POSITIVE), (~(v("tax_expense") / F.when(v("pretax_income") > 0, v("pretax_income"))).between(0, 1), "Reported effective tax rate outside [0, 1]")),
    })
    df = df.withColumns({
        "free_cash_flow": _made("free_cash_flow", raw("operating_cash_flow") + made("capex_outflow"), v("operating_cash_flow") - v("capex_outflow")),
        "net_debt": _made("net_debt", made("total_debt") + raw("cash"), v("total_debt") - v("cash")),
        "invested_capital": _made("invested_capital", raw("shareholders_equity") + made("total_debt") + raw("cash"), v("shareholders_equity") + v("total_debt") - v("cash")),
        "nopat": _made("nopat", raw("operating_income") + made("effective_tax_rate"), v("operating_income") * (1 - v("effective_tax_rate"))),
    })
    df = written(df, "ratios")
    # The balances before the period, and the one comparable period a year before.
    opening = df.select("ticker", c("period_end").alias("_open"), c("total_assets").alias("_assets"), c("invested_capital").alias("_capital"))
    df = df.withColumn("_open", F.date_sub("start", 1)).join(opening, ["ticker", "_open"], "left")
    flows = facts.filter("period_start is not null").filter(c("concept").isin("revenue", "diluted_shares")).select("ticker", "concept", "period_end", "period_start", "value", "fact_id")
    was = flows.select("ticker", "concept", c("period_end").alias("_end"), c("period_start").alias("_start"), F.struct("value", c("fact_id").alias("id"), F.lit(None).cast("date").alias("start")).alias("_was"))
    near = F.datediff("period_end", "_end").between(350, 380) & (F.abs(F.datediff("period_end", "period_start") - F.datediff("_end", "_start")) <= 7)
    prior = flows.join(was, ["ticker", "concept"]).filter(near).groupBy("ticker", "period_end", "concept").agg(F.count("*").alias("n"), F.first("_was").alias("_was")).filter("n = 1")
    for name in ("revenue", "diluted_shares"):
        df = df.join(prior.filter(c("concept") == name).select("ticker", "period_end", c("_was").alias(f"_was_{name}")), ["ticker", "period_end"], "left")
    no_start = (c("start").isNull(), "Unambiguous duration start required for beginning balance")

    def averaged(metric: str, name: str, before: Column, is_made: bool, missing: str) -> Column:
        earlier = F.coalesce(before, _nothing(F.concat(F.lit(f"Missing {missing} at "), c("_open").cast("string"))))
        direct = F.array(stable_id("FIN", c("ticker"), F.lit(name), c("_open"), F.array_join(earlier["i"], ","))) if is_made else earlier["i"]
        earlier = _value(earlier["v"], earlier["f"], direct, F.expr("CAST(array() AS array<date>)"), F.when(no_start[0], no_start[1]).otherwise(F.concat(F.lit(f"{name}: "), earlier["w"]) if is_made else earlier["w"]))
        return _made(metric, [(name, earlier, False), (name, c(name), is_made)], (earlier["v"] + v(name)) / 2)

    def grown(metric: str, name: str) -> Column:
        then = F.when(c(f"_{name}")["start"].isNull(), _nothing(F.lit(f"Missing current {name}"))).when(c(f"_was_{name}").isNull(), _nothing(F.lit("Missing unambiguous prior comparable period"))).otherwise(_fact(name, c(f"_was_{name}"), end))
        return _made(metric, [(name, c(name), False), (name, then, False)], v(name) / F.when(then["v"] > 0, then["v"]) - 1, (then["v"] <= 0, _POSITIVE))

    df = df.withColumns({
        "average_assets": averaged("average_assets", "total_assets", c("_assets"), False, "total_assets"),
        "average_invested_capital": averaged("average_invested_capital", "invested_capital", c("_capital"), True, "shareholders_equity"),
        "revenue_growth_yoy": grown("revenue_growth_yoy", "revenue"),
        "share_dilution_yoy": grown("share_dilution_yoy", "diluted_shares"),
    })
    ratio = lambda m, a, b: _made(m, a + b, v(a[0][0]) / F.when(v(b[0][0]) > 0, v(b[0][0])), (v(b[0][0]) <= 0, _POSITIVE))
    df = written(df, "ratios").withColumns({
        "operating_margin": ratio("operating_margin", raw("operating_income"), raw("revenue")), "net_margin": ratio("net_margin", raw("net_income"), raw("revenue")), "operating_cash_flow_margin": ratio("operating_cash_flow_margin", raw("operating_cash_flow"), raw("revenue")),
        "free_cash_flow_margin": ratio("free_cash_flow_margin", made("free_cash_flow"), raw("revenue")), "cash_conversion_or_cfo_to_net_income": ratio("cash_conversion_or_cfo_to_net_income", raw("operating_cash_flow"), raw("net_income")), "net_debt_to_ebitda": ratio("net_debt_to_ebitda", made("net_debt"), made("derived_ebitda")),
        "interest_coverage": ratio("interest_coverage", raw("operating_income"), raw("interest_expense")), "capex_to_revenue": ratio("capex_to_revenue", made("capex_outflow"), raw("revenue")), "working_capital_to_revenue": ratio("working_capital_to_revenue", made("working_capital"), raw("revenue")),
        "asset_turnover": ratio("asset_turnover", raw("revenue"), made("average_assets")), "roic": ratio("roic", made("nopat"), made("average_invested_capital")),
    })
    metrics = "revenue_growth_yoy operating_margin net_margin operating_cash_flow_margin capex_outflow free_cash_flow free_cash_flow_margin cash_conversion_or_cfo_to_net_income total_debt net_debt derived_ebitda net_debt_to_ebitda interest_coverage capex_to_revenue working_capital working_capital_to_revenue average_assets asset_turnover effective_tax_rate nopat invested_capital average_invested_capital roic share_dilution_yoy".split()
    rows = df.select("ticker", "period_end", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), c(m).alias("x")) for m in metrics])).alias("r")).select("ticker", "period_end", "r.metric", "r.x")
    barred = c("metric").isin(INDUSTRIAL) if financial else F.lit(False)
    reason = F.when(barred, "Industrial-company formula is not applicable to financial institutions").otherwise(c("x.w"))
    status = F.when(barred, "not_applicable").when(c("x.w").isNotNull(), "unavailable").otherwise("available")
    ids = lambda k: F.when(~barred, c(f"x.{k}")).otherwise(F.expr(_EMPTY))
    ident = stable_id("FIN", c("ticker"), c("metric"), c("period_end"), F.array_join(ids("i"), ","))
    return rows.select("ticker", "period_end", "metric", ident.alias("calculation_id"), F.when(~barred, c("x.v")).alias("value"), status.alias("status"), reason.alias("reason"), ids("i").alias("input_ids"), ids("f").alias("fact_ids"))


def derived_quarters(facts: DataFrame, *, limit: int = 8) -> DataFrame:
    """(ticker, metric, period_end, value, unit, reason): the quarters of ``discrete_quarters`` with debt, cash flow and margins derived, and their changes and
    growth against the quarter before and a year before, for the last ``limit`` quarters of a ticker (C17). Comparisons may reach further back.

    Margins change in basis points and have no growth. Quarters become a row an end with a map of values, so derivation is projections and one self-join.
    """
    q = discrete_quarters(facts).groupBy("ticker", "period_end").agg(F.max("fiscal_year").alias("y"), F.max("quarter").alias("q"), F.map_from_entries(F.collect_list(F.struct("concept", "value"))).alias("m"))
    got = lambda k: F.try_element_at("m", F.lit(k))
    add = lambda df, name, value: df.withColumn("m", F.when(got(name).isNull() & value.isNotNull(), F.map_concat("m", F.create_map(F.lit(name), value))).otherwise(F.col("m")))
    q = add(q, "total_debt", sum((got(x) for x in DEBT[1:]), got(DEBT[0])))
    q = add(q, "free_cash_flow", F.when(got("capex") >= 0, got("operating_cash_flow") - got("capex")))
    q = add(q, "net_debt", got("total_debt") - got("cash"))
    for name, a, b in MARGINS:
        q = add(q, name, F.when(got(b) > 0, got(a) / got(b)))
    q = written(q.withColumn("idx", F.col("y") * 4 + F.col("q")), "quarters")
    last = q.withColumn("_k", F.row_number().over(W.partitionBy("ticker").orderBy(F.col("period_end").desc()))).filter(F.col("_k") <= limit)
    cadence = F.explode(F.array(*[F.struct(F.lit(n).alias("c"), F.lit(k).alias("k"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for n, k, lo, hi in (("qoq", 1, 70, 110), ("yoy", 4, 350, 380))])).alias("z")
    was = q.select("ticker", F.col("idx").alias("_idx"), F.col("period_end").alias("_end"), F.col("m").alias("_m"))
    both = last.select("ticker", "period_end", "idx", "m", cadence).withColumn("_idx", F.col("idx") - F.col("z.k")).join(was, ["ticker", "_idx"], "left")
    fits = F.datediff("period_end", "_end").between(F.col("z.lo"), F.col("z.hi"))
    both = both.select("ticker", "period_end", "m", "z", F.when(fits, F.col("_m")).alias("_m"))

    def compared(name: str) -> list[Column]:
        a, b = got(name), F.try_element_at("_m", F.lit(name))
        margin = name in {m for m, _, _ in MARGINS}
        unit = "bps" if margin else "shares" if "shares" in name else "USD"
        row = lambda kind, value, u, why: F.struct(F.concat(F.lit(f"{name}_"), F.col("z.c"), F.lit(f"_{kind}")).alias("metric"), value.cast("double").alias("value"), F.lit(u).alias("unit"), F.when(value.isNull(), why).alias("reason"))
        change = row("change", (a - b) * (10000 if margin else 1), unit, "Missing comparable fiscal quarter or metric")
        return [change] if margin else [change, row("growth", F.when(b > 0, a / F.when(b > 0, b) - 1), "ratio", "Missing comparison or nonpositive denominator")]

    changes = both.select("ticker", "period_end", F.inline(F.array(*[x for name in COMPARED for x in compared(name)])))
    own = ["total_debt", "free_cash_flow", "net_debt", *[m for m, _, _ in MARGINS]]
    derived = last.select("ticker", "period_end", F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), got(k).cast("double").alias("value"), F.lit("ratio" if k.endswith("margin") else "USD").alias("unit"), F.when(got(k).isNull(), "Missing required inputs").alias("reason")) for k in own])))
    return derived.unionByName(changes)


def fact_evidence(facts: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, observations and calculations of facts and results (C21): a filing is a document once, a fact an observation of it, an available result a calculation.

    facts: with cik and ticker; those without a proper accession number or cik are in none of the tables (``invalid_filings`` has them). results: rows of ``metric_lineage``.
    """
    good = facts.filter(F.col("accession").rlike(ACCESSION) & F.col("cik").rlike(r"^\d+$"))
    document = F.concat_ws("-", F.lit("SEC-FILING"), "cik", "accession")
    url = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.col("cik").cast("long").cast("string"), F.lit("/"), F.replace("accession", F.lit("-"), F.lit("")), F.lit("/"), F.col("accession"), F.lit("-index.html"))
    filed = good.groupBy("cik", "accession").agg(F.min("ticker").alias("ticker"), F.min("form").alias("form"), F.min("filed_at").alias("filed_at"))
    documents = filed.select(document.alias("document_id"), F.concat_ws(" ", "ticker", "form", F.lit("filed"), F.col("filed_at").cast("string")).alias("title"), F.lit("SEC EDGAR").alias("publisher"), url.alias("url"), F.col("filed_at").alias("published_on"))
    name = F.concat_ws(" ", "ticker", "concept", F.lit("period ending"), F.col("period_end").cast("string"))
    observations = good.select(F.col("fact_id").alias("observation_id"), name.alias("name"), "value", "unit", document.alias("document_id"), F.col("form").endswith("/A").alias("amended"))
    label = F.concat_ws(" ", "ticker", F.initcap(F.replace("metric", F.lit("_"), F.lit(" "))), F.lit("period ending"), F.col("period_end").cast("string"))
    inputs = F.filter("input_ids", lambda i: F.array_contains("fact_ids", i))
    calculations = results.filter("status = 'available'").select("calculation_id", label.alias("label"), "value", inputs.alias("input_observation_ids"), F.array_except("input_ids", "fact_ids").alias("input_calculation_ids"))
    return documents, observations, calculations


def invalid_filings(facts: DataFrame) -> DataFrame:
    """Facts whose filing can't be named: no proper accession number or cik."""
    return facts.filter(~F.coalesce(F.col("accession").rlike(ACCESSION) & F.col("cik").rlike(r"^\d+$"), F.lit(False)))


#: Edges that lead to what a node was made from; the metrics that stay in view.
MADE_FROM = ["derived_from", "calculated_from", "extracted_from", "published_by"]
SHOWN = r"^(revenue|operating_margin|operating_cash_flow|free_cash_flow_margin|cash|net_debt|shares_outstanding)_(qoq|yoy)_(growth|change)$"


def quarterly_view(nodes: DataFrame, edges: DataFrame, *, expanded: DataFrame | None = None, atomic: bool = False, older: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges to show of graphs with quarters (F18): filed facts, their filings and older quarters go; of calculations the headline changes of an entity's latest quarter stay.

    nodes: (graph_id, node_id, kind, label, subtype, provider, entity, metric_id, frequency, period_end, older_quarter). ``expanded`` (graph_id, node_id): nodes that stay with all that
    they were made from, however far. Graphs without a snapshot of a quarter stay as they are.
    """
    snapshot = F.col("subtype") == "fundamental_snapshot"
    df = nodes.withColumn("_shown", F.lit(False))
    if expanded is not None:
        roots = expanded.select("graph_id", "node_id").distinct()
        below = lineage_closure(edges, roots, kinds=MADE_FROM).select("graph_id", F.col("node").alias("node_id"))
        df = df.unionByName(roots.unionByName(below).withColumn("_shown", F.lit(True)), allowMissingColumns=True)
    # One shuffle by graph: what is shown, the graph's quarters and its entities' latest ones are windows within it.
    graph, own = W.partitionBy("graph_id"), F.col("graph_id").isNotNull()
    df = df.withColumn("_quarterly", F.max(F.when(snapshot & own, True)).over(graph)).withColumn("_latest", F.when(own & F.col("entity").isNotNull(), F.max(F.when(snapshot, F.col("period_end"))).over(W.partitionBy("graph_id", "entity"))))
    df = df.withColumn("_marked", F.max("_shown").over(W.partitionBy("graph_id", "node_id")) & own & F.col("node_id").isNotNull()).filter("not _shown")
    no = lambda cond: ~F.coalesce(cond, F.lit(False))
    calculated = (F.col("kind") == "calculation") & F.col("metric_id").isNotNull()
    headline = (F.col("frequency") == "quarterly") & (F.col("period_end") == F.col("_latest")) & F.col("metric_id").rlike(SHOWN) & (F.col("metric_id").contains("margin") | F.col("metric_id").endswith("growth"))
    filed = F.col("kind").isin("observation", "document") & (F.col("provider") == "SEC EDGAR") | (F.col("kind") == "source") & F.col("label").contains("SEC EDGAR")
    stays = no(F.col("older_quarter") & ~F.lit(older)) & no(filed) & (no(calculated) | F.coalesce(headline, F.lit(False)))
    stays = F.col("_quarterly").isNull() | F.lit(atomic) | stays
    kept = written(df.filter(stays | F.coalesce("_marked", F.lit(False))).select(*nodes.columns), "kept")  # read by the nodes and by both ends of edges
    ends = kept.select("graph_id", "node_id").distinct()
    for end in ("source", "target"):
        edges = edges.join(ends.withColumnRenamed("node_id", end), ["graph_id", end], "left_semi")
    return kept, edges
