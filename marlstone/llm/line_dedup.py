"""Line dedup by frequency within a site.

For each host, the share of its pages that hold a line is the number of those pages over the host's page total. Lines
over ``ratio`` are boilerplate and go from every page of the host, if at least ``min_pages`` pages hold them: what one page alone holds isn't repeated,
however small its host. Lines are compared without white space at their ends, by 128-bit hash; a line counts once a page. Blank lines stay.

Only the boilerplate is kept a host, in an array: at most the average number of lines of a page over ``ratio``. It is
broadcast if it has at most ``broadcast_lines`` lines in all, as counted; beyond that, pages are shuffled by host and one of
``salts`` random parts, so that a host with a third of all pages is spread.

Edge cases: a null text stays null and an empty one empty; a null host is a host of its own; repeated pages count each,
or once for each distinct text of a host if ``copies`` is False; long pages are read whole; lines at exactly the ratio stay. Other columns are
kept whatever their names; columns ``clean_text``, ``n_lines`` and ``n_removed`` of the caller's are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.text import stripped, unused
from marlstone.plans.shared import written


def _key(line: Column) -> Column:
    return F.md5(stripped(line))


def boilerplate(pages: DataFrame, *, ratio: float = 0.1, min_pages: int = 2, copies: bool = True, host: str = "source", text: str = "text") -> DataFrame:
    """(host, key, pages, total) for each line over the ratio."""
    page = pages.select(F.col(host).alias("host"), F.col(text).alias("text"))
    if not copies:
        page = page.groupBy("host", F.unhex(F.md5("text")).alias("same")).agg(F.first("text").alias("text"))
    page = page.select("host", F.split("text", "\n").alias("lines"))
    full = F.filter("lines", lambda x: stripped(x) != "")
    lines = page.select("host", F.explode(F.array_distinct(F.transform(full, _key))).alias("key"))
    held = lines.groupBy("host", "key").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages)
    total = page.groupBy(F.col("host").alias("its_host")).agg(F.count("*").alias("total"))
    over = held.join(total, F.col("host").eqNullSafe(F.col("its_host")))
    return over.filter(F.col("pages") > F.lit(ratio) * F.col("total")).select("host", "key", "pages", "total")


def without_boilerplate(
    pages: DataFrame, *, ratio: float = 0.1, min_pages: int = 2, copies: bool = True, broadcast_lines: int = 200_000, salts: int = 32, host: str = "source", text: str = "text"
) -> DataFrame:
    """The pages with ``clean_text`` (as it was if no line goes), ``n_lines`` (lines that aren't blank) and ``n_removed`` added."""
    lines = written(boilerplate(pages, ratio=ratio, min_pages=min_pages, copies=copies, host=host, text=text), "boilerplate")
    h, drop, part, salt, all_, over = (unused(pages, x) for x in ("host", "drop", "part", "salt", "lines", "over"))
    sets = lines.groupBy(F.col("host").alias(h)).agg(F.collect_list("key").alias(drop))
    if lines.count() <= broadcast_lines:
        df = pages.join(F.broadcast(sets), F.col(host).eqNullSafe(F.col(h)), "left")
    else:
        sets = sets.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        df = pages.withColumn(part, F.pmod(F.xxhash64(text), F.lit(salts)).cast("int"))
        df = df.join(sets, F.col(host).eqNullSafe(F.col(h)) & (F.col(part) == F.col(salt)), "left").drop(part, salt)
    df = df.withColumn(all_, F.split(F.col(text), "\n"))
    # The page's own boilerplate first, through a hash set: few lines, which each line is then compared with.
    df = df.withColumn(over, F.array_intersect(F.transform(all_, _key), drop))
    gone = lambda x: (stripped(x) != "") & F.array_contains(over, _key(x))
    clean = F.when(F.size(over) > 0, F.array_join(F.filter(all_, lambda x: ~gone(x)), "\n")).otherwise(F.col(text))
    removed = F.when(F.size(over) > 0, F.size(F.filter(all_, gone))).otherwise(0)
    count = F.size(F.filter(F.coalesce(all_, F.array().cast("array<string>")), lambda x: stripped(x) != ""))
    df = df.withColumns({"clean_text": clean, "n_lines": count.cast("long"), "n_removed": removed.cast("long")})
    return df.drop(h, drop, all_, over)
