"""Retrieval: candidate order, the admission ledger, quote grounding, budgets, page documents, research plans."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def known_future(published_at: Column, date_only: Column, as_of: Column) -> Column:
    """Published after the cutoff; a bare date counts by day, an unknown one never."""
    by_day = F.to_date(published_at) > F.to_date(as_of)
    return F.coalesce(F.when(date_only, by_day).otherwise(published_at > as_of), F.lit(False))


def strict_historical(published_at: Column, date_only: Column, as_of: Column) -> Column:
    """Certainly out by the cutoff: a bare date must be an earlier day, unless the cutoff is its day's last instant."""
    last = F.date_format(as_of, "HH:mm:ss.SSSSSS") == "23:59:59.999999"
    day = F.to_date(published_at)
    bare = (day < F.to_date(as_of)) | ((day == F.to_date(as_of)) & last)
    return F.coalesce(F.when(date_only, bare).otherwise(published_at <= as_of), F.lit(False))


def interleave(hits: DataFrame, limit: int) -> DataFrame:
    """Providers in turn, by each one's rank; ranked anew from 1 (T3). hits: (task_id, provider_no, rank, hit_id, ...)."""
    at = F.row_number().over(W.partitionBy("task_id", "provider_no").orderBy("rank", "hit_id"))
    df = hits.withColumn("_at", at)
    new = F.row_number().over(W.partitionBy("task_id").orderBy("_at", "provider_no", "hit_id"))
    return df.withColumn("new_rank", new).filter(F.col("new_rank") <= limit).drop("_at")


def select_diverse(hits: DataFrame, limit: int) -> DataFrame:
    """Greedy choice a task: the least used query, then the least used provider, rank, hit; one hit a URL (T4).

    Each choice depends on those before, so a task's candidates are one group; a task's candidates are bounded by what its searches return.
    """
    schema = hits.select("task_id", "hit_id", "query", "provider", "rank", "url").schema.simpleString()[7:-1]

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        rest = pdf.sort_values(["rank", "hit_id"]).drop_duplicates("url").to_dict("records")
        queries: dict[str, int] = {}
        providers: dict[str, int] = {}
        taken = []
        while rest and len(taken) < limit:
            best = min(rest, key=lambda h: (queries.get(h["query"], 0), providers.get(h["provider"], 0), h["rank"], h["query"], h["hit_id"]))
            rest.remove(best)
            queries[best["query"]] = queries.get(best["query"], 0) + 1
            providers[best["provider"]] = providers.get(best["provider"], 0) + 1
            taken.append(best | {"position": len(taken) + 1})
        return pd.DataFrame(taken, columns=[*pdf.columns, "position"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in hits.select("task_id", "hit_id", "query", "provider", "rank", "url").schema)
    del schema
    return hits.select("task_id", "hit_id", "query", "provider", "rank", "url").groupBy("task_id").applyInPandas(choose, f"{fields}, position long")


def retrieval_ledger(hits: DataFrame, documents: DataFrame, *, as_of: str, budget: int) -> DataFrame:
    """(task_no, hit_id, status, document_id) of each hit, by the first rule that holds.

    Over the task's budget; hit known to be later than the cutoff; URL fetched earlier in the order of tasks and ranks; not fetched; document
    later than the cutoff; fetched with a time, a bare date, or none. hits: (task_no, hit_id, url, rank, published_at, date_only); documents: (url,
    document_id, doc_published_at, doc_date_only).
    """
    end = F.lit(as_of).cast("timestamp")
    df = hits.withColumn("_n", F.row_number().over(W.partitionBy("task_no").orderBy("rank", "hit_id")))
    df = df.withColumn("over", F.col("_n") > budget).withColumn("future", known_future(F.col("published_at"), F.col("date_only"), end))
    df = df.join(documents, "url", "left")
    df = df.withColumn("good", ~F.col("over") & ~F.col("future") & F.col("document_id").isNotNull() & ~known_future(F.col("doc_published_at"), F.col("doc_date_only"), end))
    first = F.row_number().over(W.partitionBy("url", "good").orderBy("task_no", "rank", "hit_id"))
    earlier = F.max(F.col("good").cast("int")).over(W.partitionBy("url").orderBy("task_no", "rank", "hit_id").rowsBetween(W.unboundedPreceding, -1))
    df = df.withColumns({"_first": first, "earlier": F.coalesce(earlier, F.lit(0)) == 1})
    status = (
        F.when(F.col("over"), "skipped_budget").when(F.col("future"), "filtered_future").when(F.col("earlier"), "reused").when(F.col("document_id").isNull(), "failed").when(~F.col("good"), "filtered_future")
        .when(F.col("doc_published_at").isNull(), "fetched_undated").when(F.col("doc_date_only"), "fetched_date_only").otherwise("fetched")
    )
    shown = F.when(~F.col("over") & ~F.col("future"), F.col("document_id"))
    return df.select("task_no", "hit_id", status.alias("status"), shown.alias("document_id"))


def status_counts(ledger: DataFrame, statuses: DataFrame) -> DataFrame:
    """(status, n) for all statuses, zeros too."""
    return statuses.join(ledger.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def document_priority(records: DataFrame) -> DataFrame:
    """(document_id, priority): the smallest priority of the tasks that found it, 5 without one."""
    return records.groupBy("document_id").agg(F.coalesce(F.min("priority"), F.lit(5)).alias("priority"))


def ground_quotes(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """Claims with the part of their quote that the document has (J16): as it is, or without a quotation mark on the left, right or both sides; else null."""
    marks = "\"'“”‘’«»"
    q = F.trim("quote")
    options = [F.col("quote"), F.ltrim(q, F.lit(marks)), F.rtrim(q, F.lit(marks)), F.btrim(q, F.lit(marks))]
    df = claims.join(documents.select("document_id", F.col("text").alias("_text")), "document_id", "left")
    hit = F.coalesce(*[F.when((o != "") & F.contains("_text", o), o) for o in options])
    return df.withColumn("grounded", hit).drop("_text")


def ground_claims(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """Grounded claims, each (text, quote) once a document, the first by position, with an id."""
    df = ground_quotes(claims, documents).filter("grounded is not null")
    w = W.partitionBy("document_id", "claim", "grounded").orderBy("position")
    df = df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    ident = F.concat(F.lit("CLAIM-"), F.substring(F.sha1(F.concat_ws("|", F.col("document_id").cast("string"), "claim", "grounded")), 1, 12))
    return df.withColumn("claim_id", ident)


def select_claims(claims: DataFrame, *, per_document: int = 2, most: int = 8) -> DataFrame:
    """Distinct claims in order, at most so many a document and in all for each investigation."""
    norm = F.regexp_replace(F.lower(F.trim("claim")), r"\s+", " ")
    df = claims.withColumn("_norm", norm).withColumn("_n", F.row_number().over(W.partitionBy("investigation_id", norm).orderBy("position"))).filter("_n = 1")
    df = df.withColumn("_d", F.row_number().over(W.partitionBy("investigation_id", "document_id").orderBy("position"))).filter(F.col("_d") <= per_document)
    return df.withColumn("_g", F.row_number().over(W.partitionBy("investigation_id").orderBy("position"))).filter(F.col("_g") <= most).drop("_norm", "_n", "_d", "_g")


def select_arguments(arguments: DataFrame, budgets: dict[str, int], limit: int = 16) -> DataFrame:
    """Best arguments of each kind up to its budget, then the next best of any kind up to the limit (T6). arguments: (question_id, argument_id, kind, score)."""
    share = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n)) for k, n in budgets.items()], F.lit(0))
    df = arguments.withColumn("_k", F.row_number().over(W.partitionBy("question_id", "kind").orderBy(F.col("score").desc(), "argument_id"))).withColumn("_late", (F.col("_k") > share).cast("int"))
    w = W.partitionBy("question_id").orderBy("_late", F.col("score").desc(), "argument_id")
    return df.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit).drop("_k", "_late")


def page_documents(pages: DataFrame, *, least: int = 200, most: int = 5_000_000) -> DataFrame:
    """(page_id, document_id, lineage_id, publisher, title, n_chars, reject) from raw pages."""
    h = F.coalesce("html", F.lit(""))
    body = F.regexp_replace(h, r"(?is)<(script|style|head|nav|footer|aside|form)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.trim(F.regexp_replace(F.regexp_replace(body, r"(?s)<[^>]*>", " "), r"\s+", " "))
    df = pages.select("page_id", "url", F.octet_length(h).alias("size"), F.trim(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title", 1)).alias("title"), text.alias("text"))
    short = lambda c: F.substring(F.sha1(c), 1, 12)
    reject = F.when(F.col("size") > most, "too large").when(F.length("text") < least, "too short")
    host = F.regexp_replace(F.parse_url("url", F.lit("HOST")), r"^www\.", "")
    return df.select("page_id", F.concat_ws("-", F.lit("DOC"), short("url"), short("text")).alias("document_id"), F.concat_ws("-", F.lit("URL"), short("url")).alias("lineage_id"), host.alias("publisher"), "title", F.length("text").alias("n_chars"), reject.alias("reject"))


def normalize_hits(results: DataFrame) -> DataFrame:
    """Provider rows with a URL and a title as hits with ids, the host as publisher, ranks kept (S14). results: (provider, query, rank, url, title)."""
    df = results.filter(F.col("url").rlike("^https?://") & (F.coalesce(F.trim("title"), F.lit("")) != ""))
    return df.withColumns({"hit_id": F.concat(F.lit("HIT-"), F.substring(F.sha1(F.concat_ws("|", "provider", "query", "url")), 1, 12)), "publisher": F.parse_url("url", F.lit("HOST"))})


def plan_research(events: DataFrame, templates: DataFrame) -> DataFrame:
    """Tasks of each event: the templates for each of its entities, and shared ones once (C23, C24). events: (event_id, as_of, entities);
    templates: (kind, shared, lookback_days, priority): a handful of rows."""
    each = events.withColumn("entity", F.explode("entities")).join(F.broadcast(templates.filter("not shared")))
    once = events.withColumn("entity", F.lit("")).join(F.broadcast(templates.filter("shared")))
    df = each.unionByName(once)
    ident = F.concat(F.lit("TASK-"), F.substring(F.sha1(F.concat_ws("|", F.col("event_id").cast("string"), "kind", "entity")), 1, 12))
    return df.select("event_id", ident.alias("task_id"), "kind", "entity", F.date_sub(F.to_date("as_of"), F.col("lookback_days")).alias("since"), "priority")
