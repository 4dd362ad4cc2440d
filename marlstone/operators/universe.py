"""Universes: merging securities, dated membership, peers, search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merge_securities(rows: DataFrame) -> DataFrame:
    """(ticker, name, sector, universes): the first non-empty attribute by input position, universes sorted (A9). rows: (input_pos, ticker, name, sector, universe, mapping_status)."""
    full = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    first = lambda c: F.min_by(c, F.when(full(c), F.col("input_pos")))
    mapped = rows.filter((F.col("mapping_status") == "mapped") & full("ticker"))
    return mapped.groupBy(F.upper(F.trim("ticker")).alias("ticker")).agg(first("name").alias("name"), first("sector").alias("sector"), F.array_join(F.array_sort(F.collect_set("universe")), ",").alias("universes"))


def members_at(membership: DataFrame, cutoff: str) -> DataFrame:
    """Rows valid at the cutoff: valid_from <= cutoff < valid_to, an open end is fine, no start never."""
    day = F.lit(cutoff).cast("date")
    return membership.filter((F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (day < F.col("valid_to"))))


def pit_peers(membership: DataFrame, targets: DataFrame, cutoff: str, limit: int = 3) -> DataFrame:
    """(ticker, peer, rank): valid members of the same universe, currency and sector, and industry if the target has one.

    Of each class only its first ``limit`` + 1 tickers meet the targets: one of them may be the target itself, and no later one can rank.
    """
    valid = members_at(membership, cutoff).filter(F.col("sector").isNotNull())
    key = ["universe", "currency", "sector", "industry"]
    # A class of one industry, or, marked, of all of them: a target is in one of the two.
    each = valid.filter(F.col("industry").isNotNull()).select(*key, "ticker", F.lit(False).alias("every"))
    every = valid.select(*key[:3], F.lit(None).cast("string").alias("industry"), "ticker", F.lit(True).alias("every"))
    members = each.unionByName(every).filter(F.col("ticker").isNotNull()).distinct()
    first = F.row_number().over(W.partitionBy(*key, "every").orderBy("ticker"))
    heads = members.withColumn("_n", first).filter(F.col("_n") <= limit + 1).groupBy(*key, "every").agg(F.collect_list("ticker").alias("peers")).alias("p")
    own = valid.join(targets.select("ticker"), "ticker", "left_semi").select("ticker", *key, F.col("industry").isNull().alias("every")).distinct().alias("t")
    same = reduce(lambda a, b: a & b, [F.col(f"t.{c}").eqNullSafe(F.col(f"p.{c}")) for c in [*key, "every"]])
    both = own.join(heads, same).select("t.ticker", F.explode("p.peers").alias("peer")).filter("ticker <> peer").distinct()
    return both.withColumn("rank", F.row_number().over(W.partitionBy("ticker").orderBy("peer"))).filter(F.col("rank") <= limit)


def search_securities(securities: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Tickers or names that contain the query in any case: exact, then prefix, then ticker (F16)."""
    q, t = F.lit(query.lower()), F.lower("ticker")
    hit = securities.filter(t.contains(query.lower()) | F.lower("name").contains(query.lower()))
    return hit.orderBy((t != q).cast("int"), (~F.startswith(t, q)).cast("int"), "ticker").limit(limit)


def index_members(history: DataFrame, start: str, end: str) -> DataFrame:
    """Distinct tickers of the snapshots inside the window and of the last one at or before its start (S13). history: (date, tickers)."""
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    last = history.filter(F.col("date") <= lo).agg(F.max("date").alias("d0"))
    kept = history.join(F.broadcast(last)).filter(F.col("date").between(lo, hi) | (F.col("date") == F.col("d0")))
    return kept.select(F.explode(F.split("tickers", ",")).alias("t")).select(F.trim("t").alias("ticker")).filter("ticker <> ''").distinct()


def group_summary(bars: DataFrame, fits: DataFrame) -> DataFrame:
    """(grp, tickers, fits) (A10)."""
    return bars.groupBy("grp").agg(F.countDistinct("ticker").alias("tickers")).join(fits.groupBy("grp").agg(F.count("*").alias("fits")), "grp", "left").fillna(0, ["fits"])


def grouped_bars(bars: DataFrame, members: DataFrame) -> DataFrame:
    """Bars with ``grp`` for each mapped membership in a universe and currency; a null currency is one too.

    Groups with fewer than two priced tickers are left out. members: (ticker, universe, currency, mapping_status).
    """
    grp = F.concat_ws("|", "universe", F.coalesce("currency", F.lit("")))
    mine = members.filter("mapping_status = 'mapped'").select("ticker", grp.alias("grp")).distinct()
    priced = bars.select("ticker").distinct().join(mine, "ticker")
    large = priced.groupBy("grp").agg(F.count("*").alias("n")).filter("n >= 2").select("grp")
    return bars.join(priced.join(large, "grp", "left_semi"), "ticker")


def attach_group(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Rows (ticker, ...) with their universe's name, 'unknown' where there is none, the first by name where there are several."""
    one = members.groupBy("ticker").agg(F.min("universe").alias("group"))
    return rows.join(one, "ticker", "left").withColumn("group", F.coalesce("group", F.lit("unknown")))
