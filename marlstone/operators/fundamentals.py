"""Filed company facts: point-in-time selection, ratios, discrete quarters, comparisons.

Facts are (ticker, concept, tag, alias_rank, unit, period_start, period_end, value, form, filed_at, accession). A filing counts as known at
the end of its UTC day. What can't be computed is null with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Filing forms, concepts that are balances on a day, day counts of periods, bands of fiscal quarters.
FORMS = ["10-K", "10-K/A", "10-Q", "10-Q/A"]
INSTANT = "shares_outstanding cash accounts_receivable inventory current_assets total_assets accounts_payable current_liabilities short_term_debt current_long_term_debt long_term_debt total_debt finance_lease_current finance_lease_noncurrent shareholders_equity".split()
DAYS = {"annual": (350, 380), "quarterly": (80, 100), "cumulative": (80, 380)}
FISCAL_BANDS = [(1, 80, 100), (2, 170, 195), (3, 260, 290), (4, 350, 380)]
#: Fixed values: (metric, numerator, denominator) of the plain ratios.
RATIOS = [
    ("operating_margin", "operating_income", "revenue"), ("net_margin", "net_income", "revenue"), ("operating_cash_flow_margin", "operating_cash_flow", "revenue"),
    ("free_cash_flow_margin", "free_cash_flow", "revenue"), ("cash_conversion", "operating_cash_flow", "net_income"), ("net_debt_to_ebitda", "net_debt", "derived_ebitda"),
    ("interest_coverage", "operating_income", "interest_expense"), ("capex_to_revenue", "capex_outflow", "revenue"), ("working_capital_to_revenue", "working_capital", "revenue"),
    ("asset_turnover", "revenue", "average_assets"), ("roic", "nopat", "average_invested_capital"),
]
INDUSTRIAL = "roic net_debt_to_ebitda derived_ebitda interest_coverage invested_capital average_invested_capital nopat".split()


def select_facts(facts: DataFrame, as_of: str, frequency: str = "annual") -> DataFrame:
    """One fact for each ticker, concept and period end, as known at the cutoff.

    The newest filing wins, then the first alias; periods whose candidates still disagree are dropped. ``cumulative`` keeps each period start apart.
    """
    low, high = DAYS[frequency]
    days = F.datediff("period_end", "period_start") + 1
    instant = F.col("concept").isin(INSTANT)
    fits = F.when(instant, F.col("period_start").isNull()).otherwise(days.between(low, high))
    known = (F.col("filed_at") <= F.lit(as_of).cast("date")) & F.col("form").isin(FORMS) & (F.col("period_end") <= F.col("filed_at"))
    df = facts.filter(known & F.coalesce(fits, F.lit(False)) & F.col("value").isNotNull() & ~F.isnan("value"))
    key = ["ticker", "concept", "period_end"] + (["period_start"] if frequency == "cumulative" else [])
    order = W.partitionBy(*key).orderBy(F.col("filed_at").desc(), "alias_rank")
    df = df.withColumn("_r", F.rank().over(order)).filter("_r = 1").drop("_r")
    choice = F.struct("value", "period_start", "accession")
    w = W.partitionBy(*key)
    df = df.withColumns({"_lo": F.min(choice).over(w), "_hi": F.max(choice).over(w), "_n": F.row_number().over(w.orderBy("accession", "value"))})
    return df.filter(F.col("_lo").eqNullSafe(F.col("_hi")) & (F.col("_n") == 1)).drop("_lo", "_hi", "_n")


def _ratio(a: Column, b: Column) -> Column:
    """a / b for b above 0."""
    return F.when(b > 0, a / b)


def financial_metrics(facts: DataFrame, concepts: list[str], *, financial: bool = False, digits: int | None = None) -> DataFrame:
    """(ticker, period_end, metric, value, status): the ratio registry over selected annual facts.

    Concepts become columns once, metrics are then projections in the order of their dependencies. Year-on-year values use the one period that ended 350 to 380
    days earlier; averages use the balance on the day before the period.
    """
    wide = facts.groupBy("ticker", "period_end").pivot("concept", concepts).agg(F.first("value"))
    starts = facts.filter("period_start is not null").groupBy("ticker", "period_end").agg(F.min("period_start").alias("s"), F.max("period_start").alias("s2")).filter("s = s2").drop("s2")
    for c in {*INSTANT, "revenue", "operating_income", "net_income", "operating_cash_flow", "capex", "depreciation_and_amortization", "interest_expense", "tax_expense", "pretax_income", "diluted_shares"} - set(concepts):
        wide = wide.withColumn(c, F.lit(None).cast("double"))
    c = F.col
    debt = c("short_term_debt") + c("current_long_term_debt") + c("long_term_debt") + c("finance_lease_current") + c("finance_lease_noncurrent")
    df = wide.withColumns({"total_debt": F.coalesce("total_debt", debt), "capex_outflow": F.when(c("capex") >= 0, c("capex")), "working_capital": c("current_assets") - c("current_liabilities"), "derived_ebitda": F.when(c("depreciation_and_amortization") >= 0, c("operating_income") + c("depreciation_and_amortization"))})
    tax = _ratio(c("tax_expense"), c("pretax_income"))
    df = df.withColumns({"free_cash_flow": c("operating_cash_flow") - c("capex_outflow"), "net_debt": c("total_debt") - c("cash"), "invested_capital": c("shareholders_equity") + c("total_debt") - c("cash"), "effective_tax_rate": F.when(tax.between(0, 1), tax)})
    df = df.withColumn("nopat", c("operating_income") * (1 - c("effective_tax_rate")))
    opening = df.select("ticker", c("period_end").alias("_open"), c("total_assets").alias("_assets"), c("invested_capital").alias("_capital"))
    df = df.join(starts, ["ticker", "period_end"], "left").withColumn("_open", F.date_sub("s", 1)).join(opening, ["ticker", "_open"], "left")
    df = df.withColumns({"average_assets": (c("_assets") + c("total_assets")) / 2, "average_invested_capital": (c("_capital") + c("invested_capital")) / 2})
    last = df.select("ticker", c("period_end").alias("_was"), c("s").alias("_s"), c("revenue").alias("_revenue"), c("diluted_shares").alias("_shares"))
    gap, length = F.datediff("period_end", "_was"), F.abs(F.datediff("period_end", "s") - F.datediff("_was", "_s"))
    prior = df.select("ticker", "period_end", "s").join(last, "ticker").filter(gap.between(350, 380) & (length <= 7))
    prior = prior.groupBy("ticker", "period_end").agg(F.count("*").alias("n"), F.first("_revenue").alias("_revenue"), F.first("_shares").alias("_shares")).filter("n = 1").drop("n")
    df = df.join(prior, ["ticker", "period_end"], "left")
    ratios = {name: _ratio(c(a), c(b)) for name, a, b in RATIOS}
    growth = {"revenue_growth_yoy": _ratio(c("revenue"), c("_revenue")) - 1, "share_dilution_yoy": _ratio(c("diluted_shares"), c("_shares")) - 1}
    plain = {m: c(m) for m in ("capex_outflow", "free_cash_flow", "total_debt", "net_debt", "derived_ebitda", "working_capital", "average_assets", "effective_tax_rate", "nopat", "invested_capital", "average_invested_capital")}
    values = plain | ratios | growth
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in values.items()])).alias("r")
    out = df.select("ticker", "period_end", rows).select("ticker", "period_end", "r.metric", "r.value")
    barred = F.col("metric").isin(INDUSTRIAL) if financial else F.lit(False)
    return out.select("ticker", "period_end", "metric", F.when(~barred, F.col("value")).alias("value"), F.when(barred, "not_applicable").when(F.col("value").isNull(), "unavailable").otherwise("available").alias("status"))


#: The metrics of which trends are told.
TRENDS = ["operating_margin", "roic", "free_cash_flow_margin", "net_debt"]


def metric_trends(metrics: DataFrame, least: int = 3) -> DataFrame:
    """(ticker, metric, period_end, first, last, points, value, unit): the change from the first to the last annual point.

    A series of fewer than ``least`` points, or with a gap anywhere, has none. Margins change in basis points; net debt in percent, where it
    begins above 0 and ends at 0 or more.
    """
    df = metrics.filter(F.col("value").isNotNull() & F.col("metric").isin(TRENDS))
    before = F.lag("period_end").over(W.partitionBy("ticker", "metric").orderBy("period_end"))
    df = df.withColumn("_gap", ~F.coalesce(F.datediff("period_end", before).between(350, 380), F.lit(True)))
    out = df.groupBy("ticker", "metric").agg(F.max("period_end").alias("period_end"), F.min_by("value", "period_end").alias("first"), F.max_by("value", "period_end").alias("last"), F.count("*").alias("points"), F.bool_or("_gap").alias("_gap"))
    first, last, debt = F.col("first"), F.col("last"), F.col("metric") == "net_debt"
    out = out.filter((F.col("points") >= least) & ~F.col("_gap") & (~debt | ((first > 0) & (last >= 0)))).drop("_gap")
    return out.withColumns({"value": F.when(debt, (_ratio(last, first) - 1) * 100).otherwise((last - first) * 10000), "unit": F.when(debt, "percent").otherwise("bps")})


def _quarter(days: Column) -> Column:
    q = F.lit(None).cast("int")
    for n, low, high in FISCAL_BANDS:
        q = F.when(days.between(low, high), n).otherwise(q)
    return q


def fiscal_contexts(facts: DataFrame) -> DataFrame:
    """(ticker, period_end, fy_start, fiscal_year, quarter): period ends matched to one fiscal year's start by day counts."""
    flows = facts.filter("period_start is not null")
    anchor = flows.withColumn("q", _quarter(F.datediff("period_end", "period_start") + 1)).filter((F.col("q").isNotNull()) & (F.datediff("filed_at", "period_end") <= 180))
    anchor = anchor.groupBy("ticker", F.col("period_start").alias("fy_start")).agg(F.max(F.when(F.col("q") == 4, 1).otherwise(0)).alias("full"), F.max("q").alias("most")).filter("most > 1")
    ends = flows.select("ticker", "period_end", "period_start").distinct()
    both = ends.join(anchor.select("ticker", "fy_start"), "ticker").filter("fy_start <= period_start").withColumn("quarter", _quarter(F.datediff("period_end", "fy_start") + 1)).filter("quarter is not null")
    per = both.groupBy("ticker", "period_end").agg(F.countDistinct("fy_start").alias("n"), F.min("fy_start").alias("fy_start"), F.min("quarter").alias("quarter")).filter("n = 1")
    return per.select("ticker", "period_end", "fy_start", F.year("fy_start").alias("fiscal_year"), "quarter")


def discrete_quarters(facts: DataFrame) -> DataFrame:
    """(ticker, concept, period_end, fiscal_year, quarter, value, derived): year-to-date less the preceding one, same start, tag and unit.

    Balances, shares and earnings per share are never subtracted. A reported quarter is taken as it is.
    """
    ctx = fiscal_contexts(facts)
    df = facts.filter("period_start is not null").join(ctx, ["ticker", "period_end"]).filter("period_start = fy_start")
    was = df.select("ticker", "concept", "fy_start", "tag", "unit", (F.col("quarter") + 1).alias("quarter"), F.col("value").alias("_was"))
    flows = df.join(was, ["ticker", "concept", "fy_start", "tag", "unit", "quarter"], "left")
    apart = ~F.col("concept").rlike("shares|^eps$")
    value = F.when(F.col("quarter") == 1, F.col("value")).when(apart, F.col("value") - F.col("_was"))
    flows = flows.select("ticker", "concept", "period_end", "fiscal_year", "quarter", value.alias("value"), (F.col("quarter") > 1).alias("derived"))
    reported = facts.filter((F.datediff("period_end", "period_start") + 1).between(80, 100)).join(ctx, ["ticker", "period_end"]).filter("period_start > fy_start")
    reported = reported.select("ticker", "concept", "period_end", "fiscal_year", "quarter", "value", F.lit(False).alias("derived"))
    balances = facts.filter("period_start is null").join(ctx, ["ticker", "period_end"]).select("ticker", "concept", "period_end", "fiscal_year", "quarter", "value", F.lit(False).alias("derived"))
    both = flows.filter("value is not null").unionByName(reported)
    w = W.partitionBy("ticker", "concept", "period_end").orderBy("derived")
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").unionByName(balances)


def quarter_changes(quarters: DataFrame) -> DataFrame:
    """(ticker, concept, period_end, cadence, change, growth) against the quarter before and a year before."""
    df = quarters.withColumn("idx", F.col("fiscal_year") * 4 + F.col("quarter"))
    was = df.select("ticker", "concept", F.col("idx").alias("_idx"), F.col("period_end").alias("_end"), F.col("value").alias("_was"))
    cases = df.withColumn("c", F.explode(F.array(F.struct(F.lit("qoq").alias("cadence"), F.lit(1).alias("k"), F.lit(70).alias("lo"), F.lit(110).alias("hi")), F.struct(F.lit("yoy").alias("cadence"), F.lit(4).alias("k"), F.lit(350).alias("lo"), F.lit(380).alias("hi")))))
    cases = cases.withColumn("_idx", F.col("idx") - F.col("c.k")).join(was, ["ticker", "concept", "_idx"])
    cases = cases.filter(F.datediff("period_end", "_end").between(F.col("c.lo"), F.col("c.hi")))
    return cases.select("ticker", "concept", "period_end", F.col("c.cadence").alias("cadence"), (F.col("value") - F.col("_was")).alias("change"), (_ratio(F.col("value"), F.col("_was")) - 1).alias("growth"))


def explode_company_facts(raw: DataFrame, concepts: DataFrame) -> DataFrame:
    """Raw company facts (ticker, json) to fact rows, for listed tags in the unit of their concept (S8). concepts: (concept, tag, alias_rank, unit)."""
    row = "struct<start:string,end:string,val:double,accn:string,fy:int,fp:string,form:string,filed:string>"
    parsed = raw.select("ticker", F.from_json("json", f"map<string,struct<units:map<string,array<{row}>>>>").alias("m"))
    units = parsed.select("ticker", F.explode("m").alias("tag", "u")).select("ticker", "tag", F.explode("u.units").alias("unit", "rows"))
    rows = units.join(F.broadcast(concepts), ["tag", "unit"]).select("ticker", "concept", "tag", "alias_rank", "unit", F.explode("rows").alias("r"))
    day = lambda c: F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd")).cast("date")
    return rows.select("ticker", "concept", "tag", "alias_rank", "unit", day("r.start").alias("period_start"), day("r.end").alias("period_end"), F.col("r.val").alias("value"), F.col("r.form").alias("form"), day("r.filed").alias("filed_at"), F.col("r.accn").alias("accession")).filter(F.col("accession").rlike(r"^\d{10}-\d{2}-\d{6}$"))


def explode_filings(submissions: DataFrame) -> DataFrame:
    """Parallel arrays of filings to a row each (S9). submissions: (cik, accession, filed, form, document) with array columns."""
    return submissions.select("cik", F.inline(F.arrays_zip("accession", "filed", "form", "document")))


def financial_flag(companies: DataFrame) -> DataFrame:
    """Adds ``financial``: by sector text or SIC 6000 to 6499 (C20)."""
    return companies.withColumn("financial", F.coalesce(F.lower("sector").contains("financ"), F.lit(False)) | F.coalesce(F.col("sic").between(6000, 6499), F.lit(False)))
