"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words by water-filling: weight times a common level, but at most ``most`` times what the source
has; the sum of targets is the sum of all sizes. Each document then expects target / source size copies, shaped by
``tilt`` (a document of twice the length expects 2 ** tilt as many) and at most ``most``. Its whole part is certain. For the rest, Pareto order
sampling: with the fraction p as inclusion probability and a random u, documents are ranked by
(u / (1 - u)) / (p / (1 - p)), and those of lowest rank are taken until the source's remaining words are reached.

u is a hash of id and seed, so reruns agree. The cut-off rank of a source is found without sorting it in one task: ranks are
binned (``bins`` a source), bins are summed, and only documents of the bin that holds the cut-off are ordered.

Edge cases: a null or empty text has size 0 and is taken 0 times; a null source is a source of its own, the last; documents with
the same id have the same u and are ranked by size, then text hash. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.llm.text import words
from marlstone.plans.shared import written


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, size); one row a source, so this table is small."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    at = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (at % len(weights) + 1).cast("int"))
    per = per.withColumn("w", weight.cast("long")).withColumn("cap", most * F.col("source_size"))
    # Sources in the order in which a rising level meets their caps; the level of a source if all before it are capped.
    order = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    per = per.withColumns(
        {
            "left": F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "heavy": F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)),
        }
    ).withColumn("level", F.col("left") / F.col("heavy"))
    free = F.col("cap") >= F.col("w") * F.col("level")
    per = per.withColumn("final", F.min(F.when(free, F.struct(F.col("cap") / F.col("w"), "left", "heavy"))).over(every))
    share = F.col("final.left") * F.col("w") / F.col("final.heavy")
    return per.select("source", "source_size", F.least(F.col("cap").cast("double"), share).alias("target"))


def _uniform(key: Column, seed: int) -> Column:
    """In (0, 1), from 52 bits of a hash."""
    return (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 12).cast("double") + 0.5) / F.lit(float(2**52))


def mixed(
    docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, tilt: float = 0.25, bins: int = 1024, seed: int = 11,
    doc_id: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken) for each document; taken = copies * size words."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.size(words(F.col(text))).cast("long").alias("size"), F.xxhash64(F.col(text)).alias("hash"))
    rows = written(rows, "sizes")  # a few bytes a document; texts aren't read again
    # Expected copies: level * size ** tilt, at most ``most``. The level is solved on sums by length class, then applied.
    shape = F.when(F.col("size") > 0, F.pow(F.lit(2.0), F.lit(tilt) * F.floor(F.log2(F.col("size").cast("double")))))
    rows = rows.withColumn("shape", shape)
    per = targets(rows, weights=weights, most=most).withColumnRenamed("source", "its_source")
    classes = rows.filter("size > 0").groupBy("source", "shape").agg(F.sum("size").alias("mass"))
    classes = classes.join(per, F.col("source").eqNullSafe(F.col("its_source")))
    order = W.partitionBy("its_source").orderBy(F.col("shape").desc())
    before, every = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy("its_source")
    classes = classes.withColumns(
        {
            "rest": F.col("target") - most * F.coalesce(F.sum("mass").over(before), F.lit(0)),
            "pull": F.sum(F.col("mass") * F.col("shape")).over(every) - F.coalesce(F.sum(F.col("mass") * F.col("shape")).over(before), F.lit(0.0)),
        }
    ).withColumn("level", F.col("rest") / F.col("pull"))
    fits = F.col("level") * F.col("shape") <= most
    solved = classes.groupBy("its_source").agg(F.max_by("level", F.when(fits, F.col("shape"))).alias("level"))
    per = per.join(solved.withColumnRenamed("its_source", "s2"), F.col("its_source").eqNullSafe(F.col("s2")), "left").drop("s2")
    # A row a source, written: its size is known, so it is broadcast if small, and skewed sources stay where they are.
    rows = rows.join(written(per, "sources"), F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")
    rows = rows.withColumn("expected", F.coalesce(F.least(F.lit(float(most)), F.col("level") * F.col("shape")), F.when(F.col("size") > 0, float(most)).otherwise(0.0)))
    rows = rows.withColumn("whole", F.floor(F.col("expected") + 1e-9)).withColumn("p", F.greatest(F.lit(0.0), F.col("expected") - F.col("whole")))
    u = _uniform(F.col("doc_id"), seed)
    odds = u / (1 - u) * (1 - F.col("p")) / F.col("p")
    rows = rows.withColumn("rank", F.when((F.col("p") > 1e-9) & (F.col("size") > 0), odds / (1 + odds)))  # in (0, 1), same order
    rows = written(rows.withColumn("bin", F.least(F.lit(bins - 1), F.floor(F.col("rank") * bins))), "ranks")
    # The bin of each source in which its remaining words run out.
    sums = rows.groupBy("source", "bin").agg(F.sum(F.when(F.col("rank").isNotNull(), F.col("size"))).alias("words"), F.sum(F.col("whole") * F.col("size")).alias("sure"), F.max("target").alias("target"))
    w = W.partitionBy("source").orderBy(F.col("bin").asc_nulls_first())
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    sums = sums.withColumn("wanted", F.col("target") - F.sum("sure").over(W.partitionBy("source")))
    last = sums.filter(F.col("bin").isNotNull() & (F.col("before") < F.col("wanted")) & (F.col("before") + F.col("words") >= F.col("wanted")))
    ends = sums.groupBy(F.col("source").alias("its_source")).agg(F.max("wanted").alias("wanted"))
    last = last.select(F.col("source").alias("s2"), F.col("bin").alias("last"), "before")
    ends = ends.join(last, F.col("its_source").eqNullSafe(F.col("s2")), "left").drop("s2")
    rows = rows.join(written(ends, "ends"), F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")
    # Within that bin alone, documents in order of rank, up to the one that comes nearest to the wanted words.
    edge = rows.filter(F.col("bin") == F.col("last"))
    w = W.partitionBy("source").orderBy("rank", "size", "hash", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    edge = edge.withColumn("sum", F.col("before") + F.sum("size").over(w))
    edge = edge.withColumn("more", (F.col("sum") - F.col("size") / 2.0 <= F.col("wanted")).cast("long"))
    rest = rows.filter(~F.coalesce(F.col("bin") == F.col("last"), F.lit(False)))
    # Without such a bin, rounding left the whole sample below or none wanted.
    whole_bin = F.when(F.col("bin").isNull() | (F.col("wanted") <= 0), 0).when(F.col("last").isNull() | (F.col("bin") < F.col("last")), 1).otherwise(0)
    rest = rest.withColumn("more", whole_bin.cast("long"))
    out = edge.drop("sum").unionByName(rest)
    copies = F.col("whole") + F.col("more")
    return out.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
