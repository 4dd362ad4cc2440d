"""Small selections: discovery candidates, signals, corpus windows, overlays, document choice, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def discovery_candidates(anomalies: DataFrame, universe: DataFrame, held: DataFrame) -> DataFrame:
    """Anomalies worth a look, of pairs in the universe: those not held first, then by abs z (F14). (a, b, z, correlation, pvalue)."""
    good = anomalies.filter((F.col("a") != F.col("b")) & (F.abs("z") >= 1.5) & ~F.isnan("z") & (F.col("correlation") >= 0.65) & F.col("pvalue").between(0, 0.05))
    for leg in ("a", "b"):
        good = good.join(universe.select(F.col("ticker").alias(leg)).distinct(), leg, "left_semi")
    mine = held.select(F.col("ticker").alias("_h")).distinct()
    good = good.join(mine.withColumnRenamed("_h", "_ha"), F.col("a") == F.col("_ha"), "left").join(mine.withColumnRenamed("_h", "_hb"), F.col("b") == F.col("_hb"), "left")
    order = W.orderBy((F.col("_ha").isNotNull() | F.col("_hb").isNotNull()).cast("int"), F.abs("z").desc(), "a", "b")
    return good.withColumn("rank", F.row_number().over(order)).drop("_ha", "_hb")


def session_news(items: DataFrame, day: str | None) -> DataFrame:
    """Items of one day, or all."""
    return items if day is None else items.filter(F.to_date("published_at") == F.lit(day).cast("date"))


def select_signal(signals: DataFrame, as_of: str, a: str, b: str, *, ordered: bool = True) -> DataFrame:
    """The signal of one date and pair, in that order or in any."""
    pair = (F.col("a") == a) & (F.col("b") == b)
    pair = pair if ordered else pair | ((F.col("a") == b) & (F.col("b") == a))
    return signals.filter((F.col("as_of") == F.lit(as_of).cast("date")) & pair)


def corpus_window(items: DataFrame, as_of: str, lookback: int = 45) -> DataFrame:
    """Items issued in the days up to the cutoff's, both ends included."""
    day = F.to_date(F.lit(as_of))
    return items.filter(F.col("issue_date").between(F.date_sub(day, lookback), day))


def holding_research(runs: DataFrame, ticker: str, cutoff: str) -> DataFrame:
    """Runs about a ticker whose event is undated or not after the cutoff."""
    about = F.array_contains("primary_entities", ticker) | F.array_contains("related_entities", ticker)
    return runs.filter(about & (F.col("event_date").isNull() | (F.col("event_date") <= F.lit(cutoff).cast("date"))))


def turn_overlay(members: DataFrame, additions: DataFrame, turn: int) -> DataFrame:
    """(graph_id, id) of the first turn (all that no follow-up added) or of one follow-up (J21). additions: (graph_id, turn, id)."""
    if turn == 0:
        return members.join(additions.select("graph_id", "id"), ["graph_id", "id"], "left_anti")
    return additions.filter(F.col("turn") == turn).select("graph_id", "id").join(members, ["graph_id", "id"], "left_semi")


def select_documents(documents: DataFrame, entities: DataFrame, limit: int) -> DataFrame:
    """Each investigation's documents by entities named, mentions, priority, newest, title (T5). entities: (investigation_id, entity)."""
    text = F.lower(F.concat_ws(" ", "title", "text"))
    both = documents.join(entities, "investigation_id", "left")
    name = F.lower("entity")
    n = F.when(F.length(name) > 0, ((F.length(text) - F.length(F.replace(text, name, F.lit("")))) / F.length(name)).cast("long")).otherwise(0)
    per = both.withColumn("_n", F.coalesce(n, F.lit(0))).groupBy(*documents.columns).agg(F.count_if(F.col("_n") > 0).alias("entities"), F.sum("_n").alias("mentions"))
    order = W.partitionBy("investigation_id").orderBy(F.col("entities").desc(), F.col("mentions").desc(), "priority", F.col("published_at").desc_nulls_last(), "title", "document_id")
    return per.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def quarter_snapshots(metrics: DataFrame) -> DataFrame:
    """(ticker, period_end, available, unavailable, available_at): a quarter's metrics as maps (C18). (ticker, period_end, metric, id, value, reason, available_at)."""
    known = F.col("value").isNotNull()
    pairs = lambda cond, v: F.map_from_entries(F.array_sort(F.collect_list(F.when(cond, F.struct(F.col("metric"), v.alias("v"))))))
    return metrics.groupBy("ticker", "period_end").agg(pairs(known, F.col("id")).alias("available"), pairs(~known, F.coalesce("reason", F.lit("unavailable"))).alias("unavailable"), F.max("available_at").alias("available_at"))


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix-hash of the parts joined by | (X1); a null part counts as the text None."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]), 256), 1, 20))


def relation_label(text: Column) -> Column:
    """Lower case, runs of other characters as one underscore, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))


def assessment_band(score: Column) -> Column:
    """strong from .75, supported from .5, else weak; null is insufficient."""
    return F.when(score.isNull(), "insufficient").when(score >= 0.75, "strong").when(score >= 0.5, "supported").otherwise("weak")


def source_category(explicit: Column, kind: Column, derived: list[str]) -> Column:
    """The given category, DERIVED for calculated kinds, else Unclassified."""
    return F.coalesce(F.when(F.trim(explicit) != "", explicit), F.when(kind.isin(derived), "DERIVED"), F.lit("Unclassified"))


def unique_items(lists: DataFrame) -> DataFrame:
    """(list_id, items): each list (list_id, items array) trimmed, without blanks, and of items equal in lower case only the first.

    Lists without such an item give no row. Items are grouped before they are put together again, so long lists cost no quadratic work.
    """
    one = lists.select("list_id", F.posexplode("items").alias("at", "item")).withColumn("item", F.trim("item")).filter("item <> ''")
    first = one.groupBy("list_id", F.lower("item").alias("low")).agg(F.min(F.struct("at", "item")).alias("x"))
    return first.groupBy("list_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["item"]).alias("items"))
