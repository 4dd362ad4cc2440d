"""Queries over facts, news, retrieval, claims, scores and graphs, with their adapters from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import fundamentals, graph, news, retrieval, scoring, selection
from marlstone.plans.inputs import table
from marlstone.plans.market_queries import Query, rounded

# --- facts: a brand's yearly and year-to-date sums; filed 40 days after the period, and restated 400 days after it.
FLOWS = {"revenue": "x", "operating_income": "x * 0.5 - d * 4", "net_income": "x * 0.3 - d * 3", "operating_cash_flow": "x * 0.4 - d", "capex": "d", "depreciation_and_amortization": "d * 0.5", "interest_expense": "d * 0.25", "tax_expense": "x * 0.05", "pretax_income": "x * 0.35 - d * 3"}
STOCKS = {"cash": "d * 2", "total_debt": "x * 0.6", "current_assets": "x * 0.7", "current_liabilities": "x * 0.4", "total_assets": "x * 3", "shareholders_equity": "x"}
CONCEPTS = [*FLOWS, *STOCKS]
AS_OF = "2001-01-15"
_SUMS = """
  SELECT p_brand AS ticker, year(l_shipdate) AS y, quarter(l_shipdate) AS q, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS DOUBLE) AS x,
    CAST(sum(CAST(floor(l_extendedprice * l_discount) AS BIGINT)) AS DOUBLE) AS d FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3"""


def _shared_sql(make_date: str, add: str, once: bool = False) -> str:
    """The fact table, in SQL for Spark (``once``: each row turned into its facts in one pass) or for DuckDB."""
    ytd = f"ytd AS (SELECT ticker, y, q, sum(x) OVER (PARTITION BY ticker, y ORDER BY q) AS x, sum(d) OVER (PARTITION BY ticker, y ORDER BY q) AS d, {make_date.format('y', '1')} AS s, {add.format('CASE q WHEN 4 THEN ' + make_date.format('y + 1', '1') + ' ELSE ' + make_date.format('y', 'q * 3 + 1') + ' END', '-1')} AS e FROM sums)"
    rows = [f"SELECT ticker, '{c}' AS concept, {v} AS value, s AS period_start, e AS period_end FROM ytd" for c, v in FLOWS.items()] + [f"SELECT ticker, '{c}', {v}, CAST(NULL AS DATE), e FROM ytd" for c, v in STOCKS.items()]
    versions = f"SELECT *, 0 AS v, {add.format('period_end', '40')} AS filed_at FROM base UNION ALL SELECT ticker, concept, value * 1.01, period_start, period_end, 1, {add.format('period_end', '400')} FROM base"
    if once:
        facts = [f"struct('{c}' AS concept, {v} AS value, s AS period_start, e AS period_end)" for c, v in FLOWS.items()] + [f"struct('{c}' AS concept, {v} AS value, CAST(NULL AS DATE) AS period_start, e AS period_end)" for c, v in STOCKS.items()]
        both = "struct(0 AS v, 1.0D AS up, 40 AS late), struct(1 AS v, 1.01D AS up, 400 AS late)"
        base = f"SELECT ticker, f.concept, f.value * g.up AS value, f.period_start, f.period_end, g.v, {add.format('f.period_end', 'g.late')} AS filed_at FROM ytd LATERAL VIEW inline(array({', '.join(facts)})) f LATERAL VIEW inline(array({both})) g"
        return f"sums AS ({_SUMS}), {ytd}, facts AS ({base})"
    return f"sums AS ({_SUMS}), {ytd}, base AS ({' UNION ALL '.join(rows)}), facts AS ({versions})"


_SPARK_FACTS = "WITH " + _shared_sql("make_date({0}, {1}, 1)", "date_add({0}, {1})", once=True) + " SELECT ticker, concept, concept AS tag, 0 AS alias_rank, 'USD' AS unit, period_start, period_end, value, '10-Q' AS form, filed_at, concat(ticker, '-', v) AS accession FROM facts"
_DUCK = "WITH " + _shared_sql("make_date({0}, {1}, 1)", "CAST({0} + ({1}) AS DATE)")


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_SPARK_FACTS.replace("FROM lineitem JOIN part", "FROM {lineitem} JOIN {part}"), lineitem=table(spark, sf, "lineitem"), part=table(spark, sf, "part"))


def _pick(days: str, start: str = "") -> str:
    return f"""picked AS (SELECT * FROM facts WHERE filed_at <= DATE '{AS_OF}' AND (CASE WHEN concept IN ({", ".join(f"'{c}'" for c in STOCKS)}) THEN period_start IS NULL ELSE period_end - period_start + 1 BETWEEN {days} END)
  QUALIFY row_number() OVER (PARTITION BY ticker, concept, period_end{start} ORDER BY filed_at DESC) = 1)"""


def _annual(spark: SparkSession, sf: str) -> DataFrame:
    return fundamentals.select_facts(_facts(spark, sf), AS_OF, "annual")


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    return fundamentals.financial_metrics(_annual(spark, sf), CONCEPTS)


_PLAIN = {"capex_outflow": "capex", "free_cash_flow": "operating_cash_flow - capex", "total_debt": "total_debt", "net_debt": "total_debt - cash", "derived_ebitda": "operating_income + depreciation_and_amortization", "working_capital": "current_assets - current_liabilities", "average_assets": "average_assets", "effective_tax_rate": "tax", "nopat": "operating_income * (1 - tax)", "invested_capital": "shareholders_equity + total_debt - cash", "average_invested_capital": "average_invested_capital"}


def _value(name: str) -> str:
    return f"({_PLAIN[name]})" if name in _PLAIN else name


_WIDE = f"""wide AS (SELECT ticker, period_end, max(period_start) AS s, {", ".join(f"max(value) FILTER (WHERE concept = '{c}') AS {c}" for c in CONCEPTS)} FROM picked GROUP BY 1, 2),
w1 AS (SELECT *, CASE WHEN pretax_income > 0 AND tax_expense / pretax_income BETWEEN 0 AND 1 THEN tax_expense / pretax_income END AS tax FROM wide),
w2 AS (SELECT w1.*, (o.total_assets + w1.total_assets) / 2 AS average_assets, (o.shareholders_equity + o.total_debt - o.cash + w1.shareholders_equity + w1.total_debt - w1.cash) / 2 AS average_invested_capital, pr.revenue AS was
  FROM w1 LEFT JOIN w1 o ON o.ticker = w1.ticker AND o.period_end = w1.s - 1 LEFT JOIN w1 pr ON pr.ticker = w1.ticker AND w1.period_end - pr.period_end BETWEEN 350 AND 380 AND abs((w1.period_end - w1.s) - (pr.period_end - pr.s)) <= 7),
met AS ({" UNION ALL ".join([f"SELECT ticker, period_end, '{m}' AS metric, CAST({e} AS DOUBLE) AS value FROM w2" for m, e in _PLAIN.items()] + [f"SELECT ticker, period_end, '{m}', CASE WHEN {_value(b)} > 0 THEN {_value(a)} / {_value(b)} END FROM w2" for m, a, b in fundamentals.RATIOS] + ["SELECT ticker, period_end, 'revenue_growth_yoy', CASE WHEN was > 0 THEN revenue / was - 1 END FROM w2", "SELECT ticker, period_end, 'share_dilution_yoy', NULL FROM w2"])})"""


def _quarters(spark: SparkSession, sf: str) -> DataFrame:
    return fundamentals.discrete_quarters(fundamentals.select_facts(_facts(spark, sf), AS_OF, "cumulative"))


_QUARTERS = f"""{_pick("80 AND 380", ", period_start")}, anch AS (SELECT ticker, period_start FROM picked WHERE period_start IS NOT NULL AND filed_at - period_end <= 180 AND (period_end - period_start + 1 BETWEEN 170 AND 195 OR period_end - period_start + 1 BETWEEN 260 AND 290 OR period_end - period_start + 1 BETWEEN 350 AND 380) GROUP BY 1, 2),
ctx AS (SELECT DISTINCT p.ticker, p.period_end, p.period_start AS fy_start, year(p.period_start) AS fiscal_year, quarter(p.period_end) AS quarter FROM picked p JOIN anch USING (ticker, period_start)),
dq AS (SELECT p.ticker, p.concept, p.period_end, fiscal_year, ctx.quarter, CASE WHEN ctx.quarter = 1 THEN p.value ELSE p.value - (SELECT any_value(w.value) FROM picked w WHERE w.ticker = p.ticker AND w.concept = p.concept AND w.period_start = p.period_start AND quarter(w.period_end) = ctx.quarter - 1) END AS value, ctx.quarter > 1 AS derived
  FROM picked p JOIN ctx ON ctx.ticker = p.ticker AND ctx.period_end = p.period_end AND ctx.fy_start = p.period_start UNION ALL SELECT p.ticker, p.concept, p.period_end, fiscal_year, ctx.quarter, p.value, false FROM picked p JOIN ctx ON ctx.ticker = p.ticker AND ctx.period_end = p.period_end WHERE p.period_start IS NULL),
quarters AS (SELECT * FROM dq WHERE value IS NOT NULL)"""


# --- news: a document is an item of its source.
NEWS_AS_OF = "2024-01-20 12:00:00"


def _news(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    at = F.lit("2024-01-01 06:00:00").cast("timestamp") + F.make_dt_interval(F.pmod("n_chars", F.lit(30)).cast("int"))
    host = F.when(F.col("doc_id") % 4 == 0, "https://finnhub.io/").otherwise("https://news.example/")
    return d.select(F.col("doc_id").alias("news_id"), F.col("source").alias("ticker"), F.split("text", r"\.")[0].alias("title"), F.concat(host, F.col("doc_id").cast("string")).alias("url"), at.alias("published_at"), (F.col("doc_id") % 3 == 0).alias("date_only"), F.col("text").alias("summary"), F.col("source"), "n_chars")


_NEWS = """nws AS (SELECT doc_id AS news_id, source AS ticker, split_part(text, '.', 1) AS title, CASE WHEN doc_id % 4 = 0 THEN 'https://finnhub.io/' ELSE 'https://news.example/' END || doc_id AS url,
  CASE WHEN doc_id % 3 = 0 THEN date_trunc('day', at_) + INTERVAL '86399999999 microseconds' ELSE at_ END AS published_at, doc_id % 3 = 0 AS date_only, text AS summary
  FROM (SELECT *, TIMESTAMP '2024-01-01 06:00:00' + to_days(CAST(n_chars % 30 AS INT)) AS at_ FROM documents))"""


def _companies(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("source").alias("ticker")).distinct().withColumn("name", F.lit("The Anatre Holdings Inc."))


def _feed(spark: SparkSession, sf: str) -> DataFrame:
    out = news.news_feed(_news(spark, sf), _companies(spark, sf), NEWS_AS_OF, days=15, limit=200)
    return out.select("news_id", "published_at", "relevance", "date_only", "items", "availability", F.col("rank").cast("long").alias("rank"))


_FEED = f"""WITH {_NEWS}, n1 AS (SELECT *, CASE WHEN regexp_matches(title, '(?i)(^|[^\\pL\\pN_])anatre($|[^\\pL\\pN_])') OR regexp_matches(title, '(?i)(^|[^\\pL\\pN_])' || ticker || '($|[^\\pL\\pN_])') THEN 2
  WHEN regexp_matches(summary, '(?i)(^|[^\\pL\\pN_])anatre($|[^\\pL\\pN_])') OR regexp_matches(summary, '(?i)(^|[^\\pL\\pN_])' || ticker || '($|[^\\pL\\pN_])') THEN 1 ELSE 0 END AS relevance FROM nws
  WHERE published_at BETWEEN TIMESTAMP '{NEWS_AS_OF}' - INTERVAL 15 DAY AND TIMESTAMP '{NEWS_AS_OF}' + INTERVAL 3 DAY AND title <> ''),
n2 AS (SELECT regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS story, CAST(published_at AS DATE) AS day, first(news_id ORDER BY contains(url, 'finnhub.io'), length(summary) DESC, news_id) AS news_id, max(published_at) AS published_at, max(relevance) AS relevance,
  bool_or(date_only) AS date_only, count(*) AS items FROM n1 GROUP BY 1, 2),
n3 AS (SELECT *, CASE WHEN published_at <= TIMESTAMP '{NEWS_AS_OF}' THEN 'published_by_cutoff' ELSE 'hindsight' END AS availability FROM n2)
SELECT news_id, published_at, relevance, date_only, items, availability, row_number() OVER (PARTITION BY availability ORDER BY relevance DESC, published_at DESC, news_id) AS rank FROM n3 QUALIFY rank <= 200"""


def _search(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return news.archive_search(_news(spark, sf), asked).withColumn("score", F.col("score").cast("long"))


_TOKENS = "list_distinct(regexp_extract_all(lower({0}), '[a-z]{{3,}}'))"
_SEARCH = f"""WITH {_NEWS}, asked AS (SELECT item_id AS query_id, unnest({_TOKENS.format("text")}) AS word FROM benchmark),
words AS (SELECT news_id, unnest({_TOKENS.format("title")}) AS word, 2 AS points FROM nws UNION ALL SELECT news_id, unnest({_TOKENS.format("summary")}), 1 FROM nws)
SELECT query_id, news_id, CAST(sum(points) AS BIGINT) AS score FROM words JOIN asked USING (word) GROUP BY 1, 2"""


# --- retrieval: documents are hits of their source's task.
def _hits(spark: SparkSession, sf: str) -> DataFrame:
    n = _news(spark, sf)
    return n.select(F.substring("ticker", 4, 9).cast("int").alias("task_no"), F.col("news_id").alias("hit_id"), F.concat(F.lit("u"), F.pmod("news_id", F.lit(700))).alias("url"), F.pmod(F.col("news_id") * 7, F.lit(97)).alias("rank"), F.when(F.col("news_id") % 5 > 0, F.col("published_at")).alias("published_at"), "date_only", F.pmod("news_id", F.lit(3)).alias("provider_no"), F.concat(F.lit("q"), F.pmod("news_id", F.lit(4))).alias("query"), "n_chars")


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    h = _hits(spark, sf)
    # Pages of under 400 characters couldn't be fetched.
    docs = h.groupBy("url").agg(F.min("hit_id").alias("k"), F.min_by("n_chars", "hit_id").alias("size")).filter("size >= 400").select("url", F.concat(F.lit("d"), F.col("k").cast("string")).alias("document_id"), F.when(F.col("k") % 4 > 0, F.lit("2024-01-10 00:00:00").cast("timestamp") + F.make_dt_interval(F.pmod("k", F.lit(14)).cast("int"))).alias("doc_published_at"), (F.col("k") % 2 == 0).alias("doc_date_only"))
    return retrieval.retrieval_ledger(h.drop("n_chars"), docs, as_of=NEWS_AS_OF, budget=40)


_HITS = """raw AS (SELECT CAST(substring(source, 4) AS INT) AS task_no, doc_id AS hit_id, 'u' || doc_id % 700 AS url, doc_id * 7 % 97 AS rank, CASE WHEN doc_id % 5 > 0 THEN TIMESTAMP '2024-01-01 06:00:00' + to_days(CAST(n_chars % 30 AS INT)) END AS published_at, doc_id % 3 = 0 AS date_only, doc_id % 3 AS provider_no, n_chars FROM documents)"""
_END = f"TIMESTAMP '{NEWS_AS_OF}'"
_LEDGER = f"""WITH {_HITS}, docs AS (SELECT url, 'd' || k AS document_id, CASE WHEN k % 4 > 0 THEN TIMESTAMP '2024-01-10 00:00:00' + to_days(CAST(k % 14 AS INT)) END AS dp, k % 2 = 0 AS dd FROM (SELECT url, min(hit_id) AS k, arg_min(n_chars, hit_id) AS size FROM raw GROUP BY 1) WHERE size >= 400),
l1 AS (SELECT raw.*, document_id, dp, dd, row_number() OVER (PARTITION BY task_no ORDER BY rank, hit_id) > 40 AS over_, coalesce(CASE WHEN date_only THEN CAST(published_at AS DATE) > CAST({_END} AS DATE) ELSE published_at > {_END} END, false) AS future,
  coalesce(CASE WHEN dd THEN CAST(dp AS DATE) > CAST({_END} AS DATE) ELSE dp > {_END} END, false) AS doc_future FROM raw LEFT JOIN docs USING (url)),
l2 AS (SELECT *, NOT over_ AND NOT future AND document_id IS NOT NULL AND NOT doc_future AS good FROM l1),
l3 AS (SELECT *, coalesce(bool_or(good) OVER (PARTITION BY url ORDER BY task_no, rank, hit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS earlier FROM l2)
SELECT task_no, hit_id, CASE WHEN over_ THEN 'skipped_budget' WHEN future THEN 'filtered_future' WHEN earlier THEN 'reused' WHEN document_id IS NULL THEN 'failed' WHEN NOT good THEN 'filtered_future' WHEN dp IS NULL THEN 'fetched_undated' WHEN dd THEN 'fetched_date_only' ELSE 'fetched' END AS status,
  CASE WHEN NOT over_ AND NOT future THEN document_id END AS document_id FROM l3"""


def _interleaved(spark: SparkSession, sf: str) -> DataFrame:
    h = _hits(spark, sf).withColumnRenamed("task_no", "task_id")
    return retrieval.interleave(h, 20).select("task_id", "hit_id", F.col("new_rank").cast("long").alias("new_rank"))


def _diverse(spark: SparkSession, sf: str) -> DataFrame:
    h = _hits(spark, sf).select(F.col("task_no").alias("task_id"), "hit_id", "query", F.concat(F.lit("p"), F.col("provider_no").cast("string")).alias("provider"), "rank", "url")
    return retrieval.select_diverse(h, 12).select("task_id", "hit_id", "position")


# --- claims: each sentence of a turn is a claim and is quoted from it, now and then with quotation marks or a change.
def _claims(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf, "conversations").withColumn("document_id", F.col("conv_id") * 100 + F.col("turn"))
    one = c.select("document_id", "conv_id", F.posexplode(F.split("text", r"\. ")).alias("k", "part"))
    turn = (F.col("document_id") + F.col("k")) % 3
    quote = F.when(turn == 0, F.col("part")).when(turn == 1, F.concat(F.lit('"'), F.col("part"), F.lit('"'))).otherwise(F.upper("part"))
    claims = one.select("document_id", F.col("part").alias("claim"), quote.alias("quote"), F.col("k").alias("position"), F.col("conv_id").alias("investigation_id"))
    return claims, c.select("document_id", "text")


def _grounded(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.ground_claims(*_claims(spark, sf)).select("claim_id", "document_id", "claim", "grounded")


_STRIP = "regexp_replace({0}, '{1}', '')"
_MARKS = "[\"''“”‘’«»]+"
_GROUND = f"""WITH t AS (SELECT conv_id * 100 + turn AS document_id, text, unnest(string_split(text, '. ')) AS claim, generate_subscripts(string_split(text, '. '), 1) - 1 AS k FROM conversations),
c AS (SELECT *, CASE (document_id + k) % 3 WHEN 0 THEN claim WHEN 1 THEN '"' || claim || '"' ELSE upper(claim) END AS quote FROM t),
o AS (SELECT *, regexp_replace(trim(quote), '^{_MARKS}', '') AS q1, regexp_replace(trim(quote), '{_MARKS}$', '') AS q2, regexp_replace(trim(quote), '^{_MARKS}|{_MARKS}$', '', 'g') AS q3 FROM c),
g AS (SELECT DISTINCT document_id, claim, coalesce(CASE WHEN quote <> '' AND contains(text, quote) THEN quote END, CASE WHEN q1 <> '' AND contains(text, q1) THEN q1 END, CASE WHEN q2 <> '' AND contains(text, q2) THEN q2 END, CASE WHEN q3 <> '' AND contains(text, q3) THEN q3 END) AS grounded FROM o)
SELECT 'CLAIM-' || substring(sha1(document_id || '|' || claim || '|' || grounded), 1, 12) AS claim_id, document_id, claim, grounded FROM g WHERE grounded IS NOT NULL"""


# --- assessments: an events user's day; each event is a piece of evidence.
ROLES = {"view": "market_data", "signup": "primary_source", "error": "syndicated_report", "purchase": "independent_reporting", "click": "secondary_analysis"}


def _evidence(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    role = F.coalesce(*[F.when(F.col("event_type") == t, r) for t, r in ROLES.items()])
    stance = F.when(F.col("k") % 3 == 0, "contradicts").when(F.col("k") % 3 == 1, "context").otherwise("supports")
    ev = e.select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("assessment_id"), F.col("event_id").alias("evidence_id"), role.alias("role"), stance.alias("stance"), (F.col("event_id") % 5).alias("lineage_id"), F.col("ts").alias("published_at"), "value")
    day = F.date_trunc("day", F.min("published_at"))
    hours = lambda h: day + F.make_dt_interval(F.lit(0), F.lit(h))
    assess = ev.groupBy("assessment_id").agg(hours(20).alias("as_of_at"), hours(12).alias("anomaly_start_at"), hours(18).alias("anomaly_end_at"))
    names = F.element_at(F.array(*map(F.lit, scoring.SUPPLIED)), (F.pmod("evidence_id", F.lit(len(scoring.SUPPLIED))) + 1).cast("int"))
    crit = ev.withColumn("name", names).groupBy("assessment_id", "name").agg(F.min_by(F.abs("value") - F.floor(F.abs("value")), "evidence_id").alias("value"), F.array(F.min("evidence_id")).alias("evidence_ids"))
    return assess, ev.drop("value"), crit


_EV = f"""ev AS (SELECT user_id * 100 + day(ts) AS assessment_id, event_id AS evidence_id, CASE event_type {" ".join(f"WHEN '{t}' THEN '{r}'" for t, r in ROLES.items())} END AS role,
  CASE k % 3 WHEN 0 THEN 'contradicts' WHEN 1 THEN 'context' ELSE 'supports' END AS stance, event_id % 5 AS lineage_id, ts AS published_at, value FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)),
ass AS (SELECT assessment_id, date_trunc('day', min(published_at)) AS day FROM ev GROUP BY 1),
crit AS (SELECT assessment_id, (['{"', '".join(scoring.SUPPLIED)}'])[evidence_id % {len(scoring.SUPPLIED)} + 1] AS name, arg_min(abs(value) - floor(abs(value)), evidence_id) AS value, min(evidence_id) AS evidence_id FROM ev GROUP BY 1, 2)"""
_W = scoring.WEIGHTS
_Q = "CASE role " + " ".join(f"WHEN '{r}' THEN {q}" for r, q in scoring.QUALITY.items()) + " END"
_SCORE = f"""WITH {_EV}, av AS (SELECT ev.*, day FROM ev JOIN ass USING (assessment_id) WHERE published_at <= day + INTERVAL 18 HOUR),
sup AS (SELECT assessment_id, min(published_at) AS fp, count(DISTINCT lineage_id) AS lin, max(CASE WHEN role = 'primary_source' THEN 1.0 ELSE 0.0 END) AS primary_source_support FROM av WHERE role <> 'market_data' AND stance = 'supports' GROUP BY 1),
q AS (SELECT assessment_id, stance, sum(m) AS w FROM (SELECT assessment_id, stance, lineage_id, CAST(max({_Q}) AS DOUBLE) AS m FROM av WHERE role <> 'market_data' GROUP BY 1, 2, 3) GROUP BY 1, 2),
gv AS (SELECT crit.assessment_id, {", ".join(f"max(crit.value) FILTER (WHERE name = '{c}' AND av.evidence_id IS NOT NULL) AS {c}" for c in scoring.SUPPLIED)} FROM crit LEFT JOIN av USING (assessment_id, evidence_id) GROUP BY 1),
s1 AS (SELECT ass.*, fp, primary_source_support, gv.* EXCLUDE (assessment_id), greatest(0, epoch(day + INTERVAL 12 HOUR - fp) / 3600) AS hours, least(1.0, lin / 3) AS si0, (SELECT w FROM q WHERE q.assessment_id = ass.assessment_id AND stance = 'supports') AS sw, (SELECT w FROM q WHERE q.assessment_id = ass.assessment_id AND stance = 'contradicts') AS cw
  FROM ass LEFT JOIN sup USING (assessment_id) LEFT JOIN gv USING (assessment_id)),
s2 AS (SELECT *, round(CASE WHEN hours <= 24 THEN 1.0 ELSE pow(0.5, (hours - 24) / 48) END, 4) AS temporal_fit, round(si0, 4) AS source_independence, round(CASE WHEN sw > 0 THEN least(1.0, coalesce(cw, 0) / sw) ELSE 0 END, 4) AS con FROM s1),
s3 AS (SELECT *, {" + ".join(f"CASE WHEN {c} IS NOT NULL THEN {w}::DOUBLE ELSE 0 END" for c, w in _W.items())} AS cov, {" + ".join(f"{w}::DOUBLE * coalesce({c}, 0)" for c, w in _W.items())} AS base FROM s2 WHERE fp IS NOT NULL),
s4 AS (SELECT *, round(cov, 9) < 0.7 AS thin, {" OR ".join(f"coalesce({c} < 0.25, false)" for c in scoring.CORE)} AS weak, {" OR ".join(f"{c} IS NULL" for c in scoring.CORE)} AS gone FROM s3),
s5 AS (SELECT *, round(least(100 * greatest(0, base - 0.25 * con), CASE WHEN thin THEN 60 ELSE 1e9 END, CASE WHEN weak THEN 40 ELSE 1e9 END), 9) AS sc FROM s4)
SELECT assessment_id, true AS eligible, round(sc, 1) AS score, CASE WHEN gone OR thin THEN 'insufficient_evidence' WHEN sc >= 85 THEN 'strong_candidate' WHEN sc >= 65 THEN 'plausible' ELSE 'weak' END AS classification, round(cov, 3) AS coverage, con AS contradiction FROM s5
UNION ALL SELECT assessment_id, false, 0, 'ineligible', 0, 0 FROM s2 WHERE fp IS NULL"""


# --- graphs: orders lead to customers, nations and regions.
def _lineage(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = t("orders").select(name("o", "o_orderkey").alias("source"), name("c", "o_custkey").alias("target")).unionByName(t("customer").select(name("c", "c_custkey").alias("source"), name("n", "c_nationkey").alias("target"))).unionByName(t("nation").select(name("n", "n_nationkey").alias("source"), name("r", "n_regionkey").alias("target")))
    return e.select(F.lit("g").alias("graph_id"), "source", "target", F.lit("derived_from").alias("kind"))


_LINEAGE = "e AS (SELECT 'o' || o_orderkey AS source, 'c' || o_custkey AS target FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Customers come out on a day by their balance, nations and regions always; orders have only inputs."""
    e = _lineage(spark, sf)
    ids = e.select(F.col("source").alias("node_id")).union(e.select("target")).distinct()
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node_id"), F.when(F.col("c_acctbal") > 9000, "hindsight").otherwise("source").alias("role"))
    df = ids.join(c, "node_id", "left")
    at = F.when(F.col("node_id").startswith("r"), F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.substring("node_id", 2, 9).cast("int")))
    return df.select(F.lit("g").alias("graph_id"), "node_id", F.coalesce("role", F.lit("source")).alias("role"), at.alias("available_at"))


def _statuses(spark: SparkSession, sf: str) -> DataFrame:
    return graph.temporal_statuses(_nodes(spark, sf), _lineage(spark, sf), "2024-01-03 00:00:00").select("node_id", "status")


_STATUS = f"""WITH {_LINEAGE}, r AS (SELECT 'r' || r_regionkey AS id, CASE WHEN r_regionkey > 2 THEN 'appeared_after_cutoff' ELSE 'available_at_cutoff' END AS s FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)),
n AS (SELECT 'n' || n_nationkey AS id, CASE WHEN r.s = 'appeared_after_cutoff' THEN r.s ELSE 'derived_from_available_evidence' END AS s FROM nation JOIN r ON r.id = 'r' || n_regionkey),
c AS (SELECT 'c' || c_custkey AS id, CASE WHEN c_acctbal > 9000 THEN 'hindsight' ELSE n.s END AS s FROM customer JOIN n ON n.id = 'n' || c_nationkey),
o AS (SELECT 'o' || o_orderkey AS id, CASE WHEN c.s IS NULL THEN 'date_unknown' WHEN c.s IN ('hindsight', 'appeared_after_cutoff') THEN 'appeared_after_cutoff' ELSE c.s END AS s FROM orders LEFT JOIN c ON c.id = 'c' || o_custkey)
SELECT id AS node_id, s AS status FROM (SELECT * FROM r UNION ALL SELECT * FROM n UNION ALL SELECT * FROM c UNION ALL SELECT * FROM o)"""


def _graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.explanation_graph(*_evidence(spark, sf))[1].select("graph_id", "source", "target", "kind")


def _graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.explanation_graph(*_evidence(spark, sf))[0].select("graph_id", "node_id", "kind")


def _shown(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The graph's edges, and which of its evidence came out before 18:00 of its day."""
    assess, evidence, criteria = _evidence(spark, sf)
    edges = graph.explanation_graph(assess, evidence, criteria)[1]
    known = evidence.join(assess.select("assessment_id", "anomaly_end_at"), "assessment_id")
    g = F.col("assessment_id").cast("string")
    node = F.concat(F.lit("EVD-"), F.substring(F.sha1(F.concat_ws("|", g, F.col("evidence_id").cast("string"))), 1, 12))
    status = F.when(F.col("published_at") <= F.col("anomaly_end_at"), "available_at_cutoff").otherwise("appeared_after_cutoff")
    return edges, known.select(g.alias("graph_id"), node.alias("node_id"), status.alias("status"))


def _seen_roles(spark: SparkSession, sf: str) -> DataFrame:
    edges, known = _shown(spark, sf)
    return graph.evidence_roles(edges.filter(F.col("target").startswith("CLM-")), known)


def _diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """Events as assessments: roles as kinds of source, stances as relations, without a use where k is a multiple of 5."""
    role, k = F.col("role"), F.col("k")
    kind = F.when(role == "primary_source", "claim").when(role == "independent_reporting", "observation").when(role == "market_data", "calculation").otherwise("inference")
    relation = F.when(k % 5 == 0, "unrelated").when(F.col("stance") == "context", "context_for").otherwise(F.col("stance"))
    k_of = table(spark, sf, "events").select(F.col("event_id").alias("evidence_id"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    ev = _evidence(spark, sf)[1].join(k_of, "evidence_id")
    return graph.relationship_diagnostics(ev.select(F.col("assessment_id").alias("graph_id"), kind.alias("source_kind"), relation.alias("relation")))


def _graph_counts(spark: SparkSession, sf: str) -> DataFrame:
    return graph.graph_counts(_graph_nodes(spark, sf), _seen_roles(spark, sf))


def _coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a customer's requirements."""
    status = F.when(F.col("o_orderstatus") == "F", "satisfied").when(F.col("o_orderstatus") == "O", "unsatisfied")
    return graph.requirement_coverage(table(spark, sf, "orders").select(F.col("o_custkey").alias("graph_id"), status.alias("status")))


def _pair_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with suppliers: expected of the lines not accepted, returned of those that left the shop; pending orders come back with their customer instead."""
    line, order = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    named = lambda df, i, h: df.select(F.lit("claim").alias("source_kind"), F.col(i).cast("long").alias("source_id"), F.col(h).cast("long").alias("hypothesis_id"))
    expected = named(line.filter("l_returnflag <> 'A'"), "l_orderkey", "l_suppkey")
    returned = named(line.filter("l_returnflag <> 'N'"), "l_orderkey", "l_suppkey").unionByName(named(order.filter("o_orderstatus = 'P'"), "o_orderkey", "o_custkey"))
    return graph.pair_set_violations(expected, returned)


def _unique_words(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("list_id"), F.split("text", " ").alias("items"))
    return selection.unique_items(c).select("list_id", F.concat_ws("|", "items").alias("items"), F.size("items").cast("long").alias("n"))


def _violations(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda n, key, alias: table(spark, sf, n).select(F.lit("g").alias("graph_id"), F.col(key).cast("long").alias(alias))
    c = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.lit("g").alias("graph_id"), F.col("c_custkey").alias("id"))
    return graph.foreign_key_violations([("order customer", one("orders", "o_custkey", "ref"), c), ("customer nation", one("customer", "c_nationkey", "ref"), one("nation", "n_nationkey", "id"))]).select("check", "ref")


def _reviews(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    decision = F.when(F.col("event_type") == "error", "challenged").when(F.col("event_type") == "purchase", "approved").when(F.col("event_type") == "view", "unresolved").otherwise("noted")
    r = e.select(F.col("user_id").alias("item_id"), "event_id", F.col("ts").alias("at"), decision.alias("decision"), F.when(F.col("event_id") % 7 > 0, "owner").alias("owner"), F.lit("note").alias("note"), F.when(F.col("event_id") % 2 == 0, "use").alias("purpose"))
    return graph.review_state(r)


_REVIEW = """WITH r AS (SELECT *, CASE event_type WHEN 'error' THEN 'challenged' WHEN 'purchase' THEN 'approved' WHEN 'view' THEN 'unresolved' ELSE 'noted' END AS decision FROM events WHERE event_id % 7 > 0 AND (event_type <> 'purchase' OR event_id % 2 = 0))
SELECT user_id AS item_id, decision, 'owner' AS owner, CASE WHEN decision = 'noted' THEN 'needs_review' ELSE decision END AS status FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""


def _roles(spark: SparkSession, sf: str) -> DataFrame:
    assess, ev, crit = _evidence(spark, sf)
    _, edges = graph.explanation_graph(assess, ev, crit)
    claims = assess.select(F.col("assessment_id").cast("string").alias("graph_id"), F.concat(F.lit("CLM-"), F.substring(F.sha1(F.col("assessment_id").cast("string")), 1, 12)).alias("node_id"))
    return graph.claim_summary(edges, claims)


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.page_documents(table(spark, sf, "pages"))


QUERIES: dict[str, Query] = {
    "pit_facts": lambda s, sf: rounded(_annual(s, sf).select("ticker", "concept", "period_end", "value", "filed_at")),
    "financial_metrics": lambda s, sf: rounded(_metrics(s, sf)),
    "metric_trends": lambda s, sf: rounded(fundamentals.metric_trends(_metrics(s, sf))),
    "discrete_quarters": lambda s, sf: rounded(_quarters(s, sf)),
    "quarter_changes": lambda s, sf: rounded(fundamentals.quarter_changes(_quarters(s, sf))),
    "news_feed": _feed,
    "archive_search": _search,
    "retrieval_ledger": _ledger,
    "interleave": _interleaved,
    "select_diverse": _diverse,
    "ground_claims": _grounded,
    "causal_score": lambda s, sf: rounded(scoring.causal_score(*_evidence(s, sf))),
    "graph_nodes": _graph_nodes,
    "graph_edges": _graph_edges,
    "claim_summary": _roles,
    "fk_violations": _violations,
    "lineage_closure": lambda s, sf: graph.lineage_closure(_lineage(s, sf)).select("root", "node"),
    "temporal_status": _statuses,
    "review_state": _reviews,
    "page_documents": _pages,
    "evidence_roles": _seen_roles,
    "graph_counts": _graph_counts,
    "relationship_diagnostics": _diagnostics,
    "requirement_coverage": _coverage,
    "pair_set_violations": _pair_sets,
    "unique_items": _unique_words,
    "temporal_summary": lambda s, sf: graph.temporal_summary(_seen_roles(s, sf)),
    "filtered_edges": lambda s, sf: graph.filtered_edges(_lineage(s, sf), _statuses(s, sf).filter("status <> 'date_unknown'").select(F.lit("g").alias("graph_id"), "node_id")).select("source", "target"),
    "timeline_steps": lambda s, sf: graph.timeline_steps(_nodes(s, sf), "2024-01-03 00:00:00").select("step"),
    "duplicate_ids": lambda s, sf: graph.duplicate_ids(table(s, sf, "lineitem").select(F.lit("line").alias("kind"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"))),
}

_IDS = """i AS (SELECT x.*, 'CLM-' || substring(sha1(graph_id), 1, 12) AS clm, 'EVD-' || substring(sha1(graph_id || '|' || evidence_id), 1, 12) AS evd, 'SRC-' || substring(sha1(graph_id || '|' || lineage_id), 1, 12) AS src FROM x),
ci AS (SELECT graph_id, 'CLM-' || substring(sha1(graph_id), 1, 12) AS clm, 'SUB-' || substring(sha1(graph_id || '|' || name), 1, 12) AS sub, 'EVD-' || substring(sha1(graph_id || '|' || evidence_id), 1, 12) AS evd FROM (SELECT CAST(assessment_id AS VARCHAR) AS graph_id, name, evidence_id FROM crit))"""
_ROLES_SQL = "SELECT DISTINCT graph_id, evd AS node_id, CASE stance WHEN 'supports' THEN 'support' WHEN 'contradicts' THEN 'counter' ELSE 'context' END AS role FROM i JOIN ass USING (assessment_id) WHERE published_at <= day + INTERVAL 18 HOUR"
_GRAPH = f"""WITH {_EV}, x AS (SELECT CAST(assessment_id AS VARCHAR) AS graph_id, * FROM ev)"""
ORACLE: dict[str, str] = {
    "pit_facts": f"{_DUCK}, {_pick('350 AND 380')} SELECT ticker, concept, period_end, round(value, 4) + 0 AS value, filed_at FROM picked",
    "financial_metrics": f"{_DUCK}, {_pick('350 AND 380')}, {_WIDE} SELECT ticker, period_end, metric, round(value, 4) + 0 AS value, CASE WHEN value IS NULL THEN 'unavailable' ELSE 'available' END AS status FROM met",
    "metric_trends": f"""{_DUCK}, {_pick('350 AND 380')}, {_WIDE}, t1 AS (SELECT *, period_end - lag(period_end) OVER (PARTITION BY ticker, metric ORDER BY period_end) AS gap FROM met
  WHERE value IS NOT NULL AND metric IN ('operating_margin', 'roic', 'free_cash_flow_margin', 'net_debt')),
t2 AS (SELECT ticker, metric, max(period_end) AS period_end, arg_min(value, period_end) AS f, arg_max(value, period_end) AS l, count(*) AS points, coalesce(bool_or(gap NOT BETWEEN 350 AND 380), false) AS broken FROM t1 GROUP BY 1, 2)
SELECT ticker, metric, period_end, round(f, 4) + 0 AS "first", round(l, 4) + 0 AS "last", points, round(CASE WHEN metric = 'net_debt' THEN (l / f - 1) * 100 ELSE (l - f) * 10000 END, 4) + 0 AS value,
  CASE WHEN metric = 'net_debt' THEN 'percent' ELSE 'bps' END AS unit FROM t2 WHERE points >= 3 AND NOT broken AND (metric <> 'net_debt' OR (f > 0 AND l >= 0))""",
    "discrete_quarters": f"{_DUCK}, {_QUARTERS} SELECT ticker, concept, period_end, fiscal_year, quarter, round(value, 4) + 0 AS value, derived FROM quarters",
    "quarter_changes": f"""{_DUCK}, {_QUARTERS} SELECT x.ticker, x.concept, x.period_end, cadence, round(x.value - y.value, 4) + 0 AS change, round(CASE WHEN y.value > 0 THEN x.value / y.value END - 1, 4) + 0 AS growth
FROM quarters x, (VALUES ('qoq', 1, 70, 110), ('yoy', 4, 350, 380)) k(cadence, k, lo, hi), quarters y WHERE y.ticker = x.ticker AND y.concept = x.concept AND y.fiscal_year * 4 + y.quarter = x.fiscal_year * 4 + x.quarter - k.k AND x.period_end - y.period_end BETWEEN lo AND hi""",
    "news_feed": _FEED,
    "archive_search": _SEARCH,
    "retrieval_ledger": _LEDGER,
    "interleave": f"WITH {_HITS}, a AS (SELECT *, row_number() OVER (PARTITION BY task_no, provider_no ORDER BY rank, hit_id) AS at_ FROM raw) SELECT task_no AS task_id, hit_id, row_number() OVER (PARTITION BY task_no ORDER BY at_, provider_no, hit_id) AS new_rank FROM a QUALIFY new_rank <= 20",
    "ground_claims": _GROUND,
    "causal_score": _SCORE,
    "graph_nodes": f"""{_GRAPH}, {_IDS} SELECT graph_id, clm AS node_id, 'claim' AS kind FROM i UNION SELECT graph_id, evd, 'evidence' FROM i UNION SELECT graph_id, src, 'source' FROM i UNION SELECT graph_id, sub, 'subclaim' FROM ci""",
    "graph_edges": f"""{_GRAPH}, {_IDS} SELECT graph_id, sub AS source, clm AS target, 'part_of' AS kind FROM ci UNION SELECT graph_id, evd, sub, 'supports' FROM ci UNION SELECT graph_id, evd, src, 'derived_from' FROM i UNION SELECT graph_id, evd, clm, stance FROM i""",
    "evidence_roles": f"{_GRAPH}, {_IDS} {_ROLES_SQL}",
    "graph_counts": f"""{_GRAPH}, {_IDS}, ro AS ({_ROLES_SQL}),
no AS (SELECT graph_id, clm AS node_id, 'claim' AS kind FROM i UNION SELECT graph_id, evd, 'evidence' FROM i UNION SELECT graph_id, src, 'source' FROM i UNION SELECT graph_id, sub, 'subclaim' FROM ci)
SELECT graph_id, count(*) FILTER (WHERE kind IN ('claim', 'primary_claim', 'subclaim')) AS claims, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {n}" for k, n in (("hypothesis", "hypotheses"), ("assumption", "assumptions"), ("missing_evidence", "missing_evidence"), ("calculation", "calculations"), ("source", "sources")))},
  {", ".join(f"(SELECT count(DISTINCT node_id) FROM ro WHERE ro.graph_id = no.graph_id AND role = '{r}') AS {n}" for r, n in (("support", "evidence"), ("counter", "counter_evidence"), ("context", "context")))} FROM no GROUP BY graph_id""",
    "relationship_diagnostics": f"""WITH {_EV}, d AS (SELECT assessment_id AS graph_id, CASE role WHEN 'primary_source' THEN 'claim' WHEN 'independent_reporting' THEN 'observation' WHEN 'market_data' THEN 'calculation' ELSE 'inference' END AS source_kind,
  CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 5 = 0 THEN 'unrelated' WHEN stance = 'context' THEN 'context_for' ELSE stance END AS relation FROM ev JOIN events ON event_id = evidence_id),
cells AS (SELECT graph_id, k AS source_kind, r AS relation FROM (SELECT DISTINCT graph_id FROM d), unnest(['all', 'claim', 'observation', 'calculation', 'inference']) u(k), unnest(['supports', 'contradicts', 'weakens', 'context_for', 'unrelated']) v(r))
SELECT cells.graph_id, cells.source_kind, cells.relation, count(d.graph_id) AS n FROM cells LEFT JOIN d ON d.graph_id = cells.graph_id AND d.relation = cells.relation AND (cells.source_kind = 'all' OR d.source_kind = cells.source_kind) GROUP BY 1, 2, 3""",
    "requirement_coverage": "SELECT o_custkey AS graph_id, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS satisfied, count(*) FILTER (WHERE o_orderstatus IS NULL OR o_orderstatus NOT IN ('F', 'O')) AS unknown FROM orders GROUP BY 1",
    "pair_set_violations": """WITH want AS (SELECT DISTINCT l_orderkey::BIGINT AS s, l_suppkey::BIGINT AS h FROM lineitem WHERE l_returnflag <> 'A'),
got AS (SELECT l_orderkey::BIGINT AS s, l_suppkey::BIGINT AS h FROM lineitem WHERE l_returnflag <> 'N' UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P')
SELECT 'claim' AS source_kind, s AS source_id, h AS hypothesis_id, 'missing' AS violation FROM (SELECT * FROM want EXCEPT SELECT * FROM got) UNION ALL SELECT 'claim', s, h, 'unexpected' FROM (SELECT * FROM got EXCEPT SELECT * FROM want)
UNION ALL SELECT 'claim', s, h, 'repeated' FROM got GROUP BY s, h HAVING count(*) > 1""",
    "unique_items": """WITH w AS (SELECT conv_id || '-' || turn AS list_id, unnest(string_split(text, ' ')) AS item, generate_subscripts(string_split(text, ' '), 1) AS at_ FROM conversations),
f AS (SELECT list_id, lower(trim(item)) AS low, min(at_) AS at_, arg_min(trim(item), at_) AS item FROM w WHERE trim(item) <> '' GROUP BY 1, 2)
SELECT list_id, string_agg(item, '|' ORDER BY at_) AS items, count(*) AS n FROM f GROUP BY 1""",
    "temporal_summary": f"""{_GRAPH}, {_IDS}, ro AS ({_ROLES_SQL}) SELECT graph_id, count(DISTINCT node_id) AS evidence, count(DISTINCT CASE WHEN role = 'support' THEN node_id END) AS support, count(DISTINCT CASE WHEN role = 'counter' THEN node_id END) AS counter FROM ro GROUP BY 1""",
    "filtered_edges": f"WITH st AS ({_STATUS}), {_LINEAGE} SELECT DISTINCT source, target FROM e WHERE source IN (SELECT node_id FROM st WHERE status <> 'date_unknown') AND target IN (SELECT node_id FROM st WHERE status <> 'date_unknown')",
    "timeline_steps": "SELECT TIMESTAMP '2024-01-03 00:00:00' AS step UNION SELECT TIMESTAMP '2024-01-01 00:00:00' + to_days(r_regionkey) FROM region WHERE r_regionkey > 2 AND r_regionkey IN (SELECT n_regionkey FROM nation)",
    "duplicate_ids": "SELECT 'line' AS kind, l_orderkey || '-' || l_linenumber AS id, count(*) AS n FROM lineitem GROUP BY 2 HAVING count(*) > 1",
    "claim_summary": f"{_GRAPH} SELECT graph_id, 'CLM-' || substring(sha1(graph_id), 1, 12) AS claim, count(*) FILTER (WHERE stance = 'supports') AS supporting, count(*) FILTER (WHERE stance = 'contradicts') AS counter FROM x GROUP BY 1, 2",
    "fk_violations": "SELECT DISTINCT 'order customer' AS check, o_custkey AS ref FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT DISTINCT 'customer nation', CAST(c_nationkey AS BIGINT) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)".replace("AS check", 'AS "check"'),
    "lineage_closure": f"WITH RECURSIVE {_LINEAGE}, r AS (SELECT source AS root, target AS node FROM e UNION SELECT r.root, e.target FROM r JOIN e ON e.source = r.node) SELECT root, node FROM r",
    "temporal_status": _STATUS,
    "review_state": _REVIEW,
}
