"""News: admission window, relevance, one row for each story, ranking; archive search.

Items are (news_id, ticker, title, url, published_at, date_only, summary, source); instants are UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words that a company's short name leaves out, and first words that don't identify one.
LEGAL = "the inc corp corporation company co companies group holdings plc ltd &".split()
GENERIC = "american bank first general home international national united".split()
CONNECTING = "of and the & de for".split()
AGGREGATOR = "finnhub.io"


def publication_bound(published_at: Column, date_only: Column) -> Column:
    """The first instant at which an item counts as public: the end of the UTC day for a bare date."""
    end = F.date_trunc("day", published_at) + F.expr("INTERVAL '0 23:59:59.999999' DAY TO SECOND")
    return F.when(date_only, end).otherwise(published_at)


def company_aliases(ticker: Column, name: Column) -> Column:
    """Ticker, name without legal words, its first two words, and a distinctive first word, sorted."""
    parts = F.transform(F.split(F.trim(name), r"\s+"), lambda w: F.btrim(w, F.lit(",.")))
    words = F.filter(parts, lambda w: (w != "") & ~F.lower(w).isin(LEGAL))
    first, second, n = F.get(words, 0), F.get(words, 1), F.size(words)
    usable = (n > 0) & (name != ticker)
    found = F.array(
        ticker, F.when(usable, F.array_join(words, " ")), F.when(usable & (n >= 2) & ~F.lower(second).isin(CONNECTING), F.concat_ws(" ", first, second)),
        F.when(usable & (F.length(first) >= 5) & ~F.lower(first).isin(GENERIC), first),
    )
    return F.array_sort(F.array_distinct(F.array_compact(found)))


def mentions(text: Column, aliases: Column) -> Column:
    """Whether a text has one of the aliases as whole words, in any case."""
    quoted = lambda a: F.concat(F.lit(r"(?iu)(?<!\w)"), F.regexp_replace(a, r"([^\w\s])", r"\\$1"), F.lit(r"(?!\w)"))
    return F.exists(aliases, lambda a: F.coalesce(F.regexp_like(text, quoted(a)), F.lit(False)))


def with_relevance(items: DataFrame, companies: DataFrame) -> DataFrame:
    """Adds relevance: 2 for the title, 1 for the summary, or 0. companies: (ticker, name)."""
    df = items.join(companies.select("ticker", "name"), "ticker", "left").withColumn("_a", company_aliases(F.col("ticker"), F.coalesce("name", "ticker")))
    relevance = F.when(mentions(F.col("title"), F.col("_a")), 2).when(mentions(F.col("summary"), F.col("_a")), 1).otherwise(0)
    return df.withColumn("relevance", relevance).drop("_a", "name")


def news_window(items: DataFrame, as_of: str, days: int = 180) -> DataFrame:
    """Items from ``days`` before the cutoff to three days after it, with a web address and a title."""
    end = F.lit(as_of).cast("timestamp")
    bound = publication_bound(F.col("published_at"), F.col("date_only"))
    df = items.withColumn("published_at", bound)
    kept = F.col("published_at").between(end - F.make_dt_interval(F.lit(days)), end + F.make_dt_interval(F.lit(3)))
    return df.filter(kept & F.col("url").rlike("^https?://") & (F.coalesce("title", F.lit("")) != ""))


def story_key(title: Column) -> Column:
    return F.regexp_replace(F.lower(title), "[^a-z0-9]", "")


def one_per_story(items: DataFrame) -> DataFrame:
    """One row for each title and day (U3): a page of its own before an aggregator's, then the longest summary, then the first; the latest time,
    the highest relevance, and the number of items behind it."""
    day = F.to_date("published_at")
    quality = F.struct((~F.contains("url", F.lit(AGGREGATOR))).cast("int").alias("own"), F.length(F.coalesce("summary", F.lit(""))).alias("n"), (-F.col("news_id")).alias("i"))
    return items.groupBy(story_key(F.col("title")).alias("story"), day.alias("day")).agg(
        F.max_by("news_id", quality).alias("news_id"), F.max_by("ticker", quality).alias("ticker"), F.max_by("title", quality).alias("title"), F.max("published_at").alias("published_at"),
        F.max("relevance").alias("relevance"), F.bool_or("date_only").alias("date_only"), F.count("*").alias("items"),
    )


def split_admissible(stories: DataFrame, as_of: str, limit: int = 200) -> DataFrame:
    """What was out by the cutoff and what wasn't, each with a limit of its own, best first."""
    known = F.col("published_at") <= F.lit(as_of).cast("timestamp")
    df = stories.withColumn("availability", F.when(known, "published_by_cutoff").otherwise("hindsight"))
    w = W.partitionBy("availability").orderBy(F.col("relevance").desc(), F.col("published_at").desc(), "news_id")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def news_feed(items: DataFrame, companies: DataFrame, as_of: str, *, days: int = 180, limit: int = 200) -> DataFrame:
    """Window, relevance, stories, ranking."""
    return split_admissible(one_per_story(with_relevance(news_window(items, as_of, days), companies)), as_of, limit)


def accumulated(old: DataFrame, new: DataFrame) -> DataFrame:
    """The latest row of each news_id over both tables (U4)."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = W.partitionBy("news_id").orderBy(F.col("_new").desc(), F.col("published_at").desc())
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_new")


def tokens(text: Column) -> Column:
    """The distinct lower-case words of letters, at least three long."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0)))


def archive_search(items: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, news_id, score): twice the words shared with the title and once those with the summary.

    An inverted-word join: only items that share a word with a query are ever looked at. queries: (query_id, query).
    """
    asked = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("word"))
    weigh = lambda c, k: items.select("news_id", F.explode(tokens(F.col(c))).alias("word"), F.lit(k).alias("points"))
    words = weigh("title", 2).unionByName(weigh("summary", 1))
    return words.join(asked, "word").groupBy("query_id", "news_id").agg(F.sum("points").alias("score"))
