"""Research plans of whole tables of events: tasks with windows, search texts, follow-ups, choice and rendering of arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values: (kind, lookback days, forward days, priority, what its search text says) of the tasks of an entity, and of the shared one.
TASKS = [("recent_news", 7, None, 1, "recent company news"), ("upcoming_events", 2, 30, 2, "earnings investor relations upcoming events"), ("primary_disclosures", 450, None, 2, "SEC filing investor relations")]
SHARED = ("shared_context", 7, None, 1, "sector macro regulatory news")
#: Fixed values: (kind, scope) of the tasks that follow a gap up, in their order, and how far back they look.
FOLLOWUPS = [
    ("primary_disclosures", "Company-specific evidence"), ("shared_context", "Peer comparison; normal versus disproportionate exposure"), ("shared_context", "Sector context; context and analogy are not causal proof"),
    ("recent_news", "Contradictory evidence and alternative explanations; permit insufficient evidence"),
]
FOLLOWUP_DAYS = 45
#: Words that tell nothing of a hypothesis; the budgets of arguments by kind, in order; names of metrics that tell a trend.
PLAIN = ["the", "and", "may", "because", "company", "reflect", "that", "with"]
BUDGETS = [("claim", 6), ("calculation", 6), ("observation", 2), ("inference", 2)]
TREND = "_qoq_|_yoy_|_trend|peer|sector"


def _task(kind: str, back: int, ahead: int | None, priority: int, entities: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), entities.alias("entities"), F.lit(back).alias("lookback_days"), F.lit(ahead).cast("int").alias("forward_days"), F.lit(priority).alias("priority"))


def plan_research(events: DataFrame) -> DataFrame:
    """Tasks (event_id, task_id, kind, entities, as_of, since, until, lookback_days, forward_days, priority) of events (event_id, as_of, ticker, related).

    Each of an event's entities, in order and once, has three tasks, and all together one. Windows are dates around the event's time, whenever it is planned. A
    row is turned into its tasks in place: nothing is joined or shuffled.
    """
    entities = F.array_distinct(F.array_compact(F.concat(F.array("ticker"), F.coalesce("related", F.array().cast("array<string>")))))
    each = F.flatten(F.transform("all", lambda e: F.array(*[_task(k, back, ahead, p, F.array(e)) for k, back, ahead, p, _ in TASKS])))
    df = events.select("event_id", "as_of", entities.alias("all"))
    df = df.select("event_id", "as_of", F.inline(F.concat(each, F.array(_task(*SHARED[:4], F.col("all"))))))
    raw = F.concat_ws("|", F.col("event_id").cast("string"), "kind", F.array_join("entities", ","))
    ident = F.concat(F.lit("RQ-"), F.upper("kind"), F.lit("-"), F.substring(F.sha1(raw), 1, 10))
    day = F.to_date("as_of")
    return df.select("event_id", ident.alias("task_id"), "kind", "entities", "as_of", F.date_sub(day, F.col("lookback_days")).alias("since"), F.date_add(day, F.coalesce("forward_days", F.lit(0))).alias("until"), "lookback_days", "forward_days", "priority")


def plan_followup(gaps: DataFrame, names: DataFrame) -> DataFrame:
    """Four scoped tasks (run_id, task_id, kind, question, entities, since, until, priority) for each selected gap.

    gaps: (run_id, cutoff, ticker, related, peers, sector, question). names: (ticker, name): an entity is followed by its issuer's name, where that is another one. Aliases are
    joined on the ticker, a row an entity of a gap.
    """
    all_ = F.array_distinct(F.array_compact(F.concat(F.array("ticker"), F.coalesce("related", F.array().cast("array<string>")), F.coalesce("peers", F.array().cast("array<string>")))))
    one = gaps.select("run_id", F.posexplode(all_).alias("at", "entity")).join(names.groupBy(F.col("ticker").alias("entity")).agg(F.min("name").alias("name")), "entity", "left")
    one = one.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("at", "entity", F.coalesce("name", "entity").alias("name")))).alias("es"))
    entities = F.array_distinct(F.flatten(F.transform("es", lambda e: F.array(e["entity"], e["name"]))))
    tasks = F.array(*[F.struct(F.lit(i).alias("priority"), F.lit(k).alias("kind"), F.lit(scope).alias("scope")) for i, (k, scope) in enumerate(FOLLOWUPS, 1)])
    df = gaps.join(one.select("run_id", entities.alias("entities")), "run_id").select("run_id", "cutoff", "question", "sector", "entities", F.inline(tasks))
    question = F.concat(F.col("question"), F.lit("\nResearch scope: "), F.col("scope"), F.lit(". Sector: "), F.coalesce(F.nullif("sector", F.lit("")), F.lit("unverified")), F.lit("."))
    day = F.to_date("cutoff")
    return df.select("run_id", F.concat_ws("-", "run_id", F.lit("task"), F.col("priority").cast("string")).alias("task_id"), "kind", question.alias("question"), "entities", F.date_sub(day, FOLLOWUP_DAYS).alias("since"), day.alias("until"), "priority")


def temporal_context(kind: Column, as_of: Column, lookback: Column, forward: Column) -> Column:
    """Years, months or the month that a search text names (X8): years of the lookback for disclosures, this and the last month of upcoming events, else the event's month."""
    day = F.to_date(as_of)
    years = F.array_join(F.transform(F.sequence(F.year(F.date_sub(day, F.coalesce(lookback, F.lit(365)))), F.year(day)), lambda y: y.cast("string")), " ")
    month = lambda d: F.date_format(d, "MMMM yyyy")
    months = F.array_join(F.array_distinct(F.array(month(day), month(F.date_add(day, F.coalesce(forward, F.lit(30)))))), " ")
    return F.when(kind == "primary_disclosures", years).when(kind == "upcoming_events", months).otherwise(month(day))


def search_texts(tasks: DataFrame) -> DataFrame:
    """Tasks with ``search_text`` (X9): the entities, what their kind asks for, and the time; without a time where as_of is null, null for an unknown kind."""
    says = F.coalesce(*[F.when(F.col("kind") == k, text) for k, *_, text in [*TASKS, SHARED]])
    base = F.concat(F.array_join("entities", " "), F.lit(" "), says)
    time = temporal_context(F.col("kind"), F.col("as_of"), F.col("lookback_days"), F.col("forward_days"))
    return tasks.withColumn("search_text", F.when(F.col("as_of").isNull(), base).otherwise(F.concat(base, F.lit(" "), time)))


def evidence_text(kind: Column, text: Column, value: Column, unit: Column) -> Column:
    """What an argument is shown as (X14): measured ones as ``name: value unit``, others as their text."""
    return F.when(kind.isin("observation", "calculation"), F.concat(text, F.lit(": "), F.coalesce(value, F.lit("None")), F.lit(" "), F.coalesce(unit, F.lit("")))).otherwise(text)


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z]{3,})")))


def select_arguments(arguments: DataFrame, hypotheses: DataFrame | None = None, *, limit: int = 16) -> DataFrame:
    """(hypothesis_id, kind, argument_id, position): the arguments that a hypothesis is judged on, at most ``limit``.

    arguments: (investigation_id, argument_id, kind, text, metric_id, period_end, frequency, input_observation_ids); hypotheses, each of one investigation: (investigation_id, hypothesis_id,
    text). Without them each argument makes one for its investigation, of hypothesis_id and hypothesis_text. Within a kind
    those that share most words with the hypothesis come first, then by latest period, quarterly ones, trends, then by id. Claims, calculations, observations and inferences
    have budgets in this order; observations that a chosen calculation already uses go behind the others of their kind; room that is left is filled by kind in the same order.
    Arguments move once, by investigation, before they meet the hypotheses. Then they are sorted once by hypothesis and kind; what calculations use, and the places, are counted in that order.
    """
    if not 1 <= limit <= 20:
        raise ValueError("limit is within [1, 20]")
    kinds = [k for k, _ in BUDGETS]
    place = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(kinds)])
    terms = lambda text: F.array_except(_words(F.col(text)), F.array(*map(F.lit, PLAIN))).alias("_terms")
    metric = F.coalesce("metric_id", F.lit(""))
    words = _words(F.replace(F.concat_ws(" ", "text", metric), F.lit("_"), F.lit(" ")))
    period = F.coalesce(F.col("period_end").cast("string"), F.lit(""))
    own = [words.alias("_words"), period.alias("_period"), F.coalesce(F.col("frequency") == "quarterly", F.lit(False)).alias("_quarterly"), metric.rlike(TREND).alias("_trend")]
    own = ["investigation_id", place.alias("_place"), "argument_id", "input_observation_ids", *own]
    if hypotheses is None:
        one = F.struct("hypothesis_id", terms("hypothesis_text"))
        df = arguments.filter("investigation_id is not null").select(*own, F.collect_set(one).over(W.partitionBy("investigation_id")).alias("_of"))
        df = df.filter("_place is not null").select(*df.columns[:-1], F.inline("_of"))
    else:
        of = hypotheses.select("investigation_id", "hypothesis_id", terms("text"))
        df = arguments.select(*own).filter("_place is not null").repartition("investigation_id").join(of, "investigation_id")
    df = df.withColumn("_overlap", F.size(F.array_intersect("_terms", "_words"))).drop("_terms", "_words")

    # All windows begin with the investigation, so the rows stay where they are, and none needs another order than the first.
    of = W.partitionBy("investigation_id", "hypothesis_id")
    ranked = W.partitionBy("investigation_id", "hypothesis_id", "_place").orderBy(*[F.col(c).desc() for c in ("_overlap", "_period", "_quarterly", "_trend")], "argument_id")
    earlier = of.orderBy("_place").rangeBetween(W.unboundedPreceding, -1)
    at = {k: F.col("_place") == i for i, k in enumerate(kinds)}
    df = df.withColumn("_k", F.row_number().over(ranked))
    budget = F.get(F.array(*[F.lit(n) for _, n in BUDGETS]), F.col("_place"))
    within, beyond = F.when(F.col("_k") <= budget, 1), F.when(F.col("_k") > budget, 1)
    using = F.collect_list(F.when(at["calculation"] & (F.col("_k") <= dict(BUDGETS)["calculation"]), F.col("input_observation_ids")))
    df = df.withColumns({"_using": using.over(of), "_within": F.count(within).over(of)})
    used = F.coalesce(F.when(at["observation"], F.array_contains(F.flatten("_using"), F.col("argument_id"))), F.lit(False))
    df = df.withColumn("_used", used.cast("int")).drop("_using", "input_observation_ids")
    df = df.withColumns({"_before": F.count(within).over(earlier), "_behind": F.col("_within") + F.count(beyond).over(earlier) - budget})
    position = F.when(F.col("_k") <= budget, F.col("_before")).otherwise(F.col("_behind")) + F.col("_k")
    df = df.filter(at["observation"] | (position <= limit))
    unused = F.count(F.when(at["observation"] & (F.col("_used") == 0), 1)).over(of)
    df = df.withColumns({"_unused": unused, "_used_before": F.sum("_used").over(ranked.rowsBetween(W.unboundedPreceding, 0))})
    df = df.withColumn("_k", F.when(F.col("_used") == 1, F.col("_unused") + F.col("_used_before")).otherwise(F.col("_k") - F.col("_used_before")))
    df = df.select("hypothesis_id", F.get(F.array(*map(F.lit, kinds)), F.col("_place")).alias("kind"), "argument_id", position.cast("int").alias("position"))
    return df.filter(F.col("position") <= limit)
