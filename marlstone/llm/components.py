"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.plans.shared import written


def components(links: DataFrame) -> DataFrame:
    """(id, component) for each end of a link (a, b); the component is its smallest id.

    Each round puts the ids in a new random order (by hash), hooks each id to its first neighbour if that comes before it, follows hooks
    to their roots, and goes on with the links between different roots, until none is left. An id with a neighbour stays a root with
    odds of a half at most, so rounds grow with the logarithm of the ids, whatever their order along a chain, and tables shrink from
    round to round. Tables are written, not checkpointed: a checkpoint keeps the constraints of its plan, which grow from round to round.
    """
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter(links["a"].isNotNull() & links["b"].isNotNull())
    edges = written(edges.distinct(), "edges")
    hooks: list[DataFrame] = []
    while not edges.isEmpty():
        roots = _roots(edges, len(hooks))
        hooks.append(roots)
        moved = edges.join(roots.select(F.col("id").alias("a"), F.col("to").alias("x")), "a").join(roots.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
        edges = written(moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not hooks:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    last = hooks.pop()
    while hooks:
        later = last.select(F.col("id").alias("to"), F.col("to").alias("next"))
        last = written(hooks.pop().join(later, "to", "left").select("id", F.coalesce("next", "to").alias("to")), "roots")
    return written(last.join(last.groupBy("to").agg(F.min("id").alias("component")), "to").select("id", "component"), "components")


def _roots(edges: DataFrame, seed: int) -> DataFrame:
    """(id, to): the root to which the hooks of a round lead from each end of an edge."""

    def place(c: str) -> Column:
        return F.struct(F.xxhash64(c, F.lit(seed)).alias("h"), F.col(c).alias("id"))

    ends = edges.select(F.col("a").alias("id"), F.col("b").alias("near")).union(edges.select("b", "a"))
    first = ends.groupBy("id").agg(F.min(place("near")).alias("first"))
    hooks = written(first.select("id", F.when(F.col("first") < place("id"), F.col("first.id")).otherwise(F.col("id")).alias("to")), "hooks")
    while True:
        ahead = hooks.select(F.col("id").alias("to"), F.col("to").alias("next"))
        jumped = written(hooks.join(ahead, "to").select("id", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "hooks")
        hooks = jumped.select("id", "to")
        if jumped.filter("moved").isEmpty():
            return hooks
