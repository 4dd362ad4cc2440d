"""Evidence graphs as two tables: nodes (graph_id, node_id, kind, ...) and edges (graph_id, source, target, kind).

Iterative operators keep only the frontier in their joins, cut lineage in the shared folder every round, and stop when nothing changes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.plans.shared import cut, written

#: Edge kinds that lead to what a node was made from.
LINEAGE = ["derived_from", "calculated_from", "observed_in", "inferred_from", "extracted_from"]
#: Edge kinds that lead on from a hypothesis that a requirement bears on.
HOPS = ["supports", "weakens", "contradicts", "context"]


def lineage_closure(edges: DataFrame, roots: DataFrame | None = None, *, kinds: list[str] | None = None) -> DataFrame:
    """(graph_id, root, node): all that a root leads to over lineage edges, itself not included; cycles end."""
    step = edges.filter(F.col("kind").isin(kinds or LINEAGE)).select("graph_id", F.col("source").alias("node"), F.col("target").alias("next")).distinct()
    start = step.select("graph_id", F.col("node").alias("root")).distinct() if roots is None else roots.select("graph_id", F.col("node_id").alias("root"))
    frontier = cut(start.withColumn("node", F.col("root")).join(step, ["graph_id", "node"]).select("graph_id", "root", F.col("next").alias("node")).distinct())
    found = frontier
    while True:
        new = frontier.join(step, ["graph_id", "node"]).select("graph_id", "root", F.col("next").alias("node")).distinct()
        frontier = cut(new.join(found, ["graph_id", "root", "node"], "left_anti"))
        if frontier.isEmpty():
            return found
        found = cut(found.unionByName(frontier))


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """(graph_id, node_id) of calculations that wait for each other, found by peeling off what has no open input."""
    rest = written(edges.select("graph_id", "source", "target").distinct(), "waiting")
    left = rest.count()
    while True:
        heads = rest.select("graph_id", F.col("source").alias("target")).distinct()
        rest = written(rest.join(heads, ["graph_id", "target"], "left_semi"), "waiting")
        before, left = left, rest.count()
        if left in (0, before):
            return rest.select("graph_id", F.col("source").alias("node_id")).distinct()


def temporal_statuses(nodes: DataFrame, edges: DataFrame, cutoff: str) -> DataFrame:
    """(graph_id, node_id, status) at a cutoff (G8). nodes: (graph_id, node_id, role, available_at); edges: to the inputs.

    Hindsight and context nodes by their role; others by their own time if they have one; derived ones when all inputs are decided. What
    stays undecided, as its inputs are missing or circular, has no known date.
    """
    end = F.lit(cutoff).cast("timestamp")
    has = edges.select("graph_id", F.col("source").alias("node_id")).distinct().withColumn("derived", F.lit(True))
    own = F.when(F.col("role") == "hindsight", "hindsight").when(F.col("role") == "context", "context").when(F.col("available_at") > end, "appeared_after_cutoff")
    own = own.otherwise(F.when(F.col("derived").isNull() & F.col("available_at").isNotNull(), "available_at_cutoff"))
    state = nodes.select("graph_id", "node_id", "role", "available_at").join(has, ["graph_id", "node_id"], "left").withColumn("status", own)
    state = cut(state.withColumn("status", F.when(F.col("status").isNull() & F.col("derived").isNull(), "date_unknown").otherwise(F.col("status"))))
    late, fine = ["appeared_after_cutoff", "hindsight"], ["available_at_cutoff", "derived_from_available_evidence", "context"]
    inputs = edges.select("graph_id", F.col("source").alias("node_id"), F.col("target").alias("input")).distinct()
    while True:
        open_ = state.filter("status is null").select("graph_id", "node_id")
        known = state.select("graph_id", F.col("node_id").alias("input"), F.coalesce("status", F.lit("open")).alias("s"))
        per = inputs.join(open_, ["graph_id", "node_id"], "left_semi").join(known, ["graph_id", "input"], "left")
        per = per.groupBy("graph_id", "node_id").agg(F.count_if(F.col("s").isin(late)).alias("late"), F.count_if(F.col("s").isin(fine)).alias("fine"), F.count_if(F.col("s") == "open").alias("open"), F.count("*").alias("n"))
        decided = per.withColumn("new", F.when(F.col("late") > 0, "appeared_after_cutoff").when(F.col("fine") == F.col("n"), "derived_from_available_evidence").when(F.col("open") == 0, "date_unknown"))
        decided = cut(decided.filter("new is not null").select("graph_id", "node_id", "new"))
        if decided.isEmpty():
            break
        state = written(state.join(decided, ["graph_id", "node_id"], "left").withColumn("status", F.coalesce("status", "new")).drop("new"), "statuses")
    return state.select("graph_id", "node_id", F.coalesce("status", F.lit("date_unknown")).alias("status"))


def temporal_view(nodes: DataFrame, statuses: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges to show at the cutoff: edges need both ends."""
    shown = statuses.filter(F.col("status").isin("available_at_cutoff", "derived_from_available_evidence", "context")).select("graph_id", "node_id")
    kept = nodes.join(shown, ["graph_id", "node_id"], "left_semi")
    return kept, filtered_edges(edges, shown)


def filtered_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are among the nodes."""
    ends = nodes.select("graph_id", "node_id")
    df = edges.join(ends.withColumnRenamed("node_id", "source"), ["graph_id", "source"], "left_semi")
    return df.join(ends.withColumnRenamed("node_id", "target"), ["graph_id", "target"], "left_semi")


def timeline_steps(nodes: DataFrame, cutoff: str) -> DataFrame:
    """(graph_id, step): the cutoff and each later time at which something came out."""
    later = nodes.filter(F.col("available_at") > F.lit(cutoff).cast("timestamp")).select("graph_id", F.col("available_at").alias("step")).distinct()
    return nodes.select("graph_id").distinct().withColumn("step", F.lit(cutoff).cast("timestamp")).unionByName(later)


def evidence_roles(edges: DataFrame, statuses: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(graph_id, node_id, role): support, counter or context by edges, and by the kinds of nodes if given, of what was available at the cutoff."""
    kind = F.col("kind")
    of_source = F.when(kind.isin("supports", "strengthens"), "support").when(kind.isin("contradicts", "weakens"), "counter").when(kind.isin("context", "context_for"), "context")
    of_target = F.when(kind == "supported_by", "support").when(kind == "contradicted_by", "counter")
    ends = F.array(F.struct(F.col("source").alias("node_id"), of_source.alias("role")), F.struct(F.col("target").alias("node_id"), of_target.alias("role")))
    found = edges.select("graph_id", F.inline(ends))
    if nodes is not None:
        found = found.unionByName(nodes.select("graph_id", "node_id", F.when(kind == "evidence", "support").when(kind == "counter_evidence", "counter").alias("role")))
    shown = statuses.filter(F.col("status").isin("available_at_cutoff", "derived_from_available_evidence")).select("graph_id", "node_id")
    return found.filter("role is not null").join(shown, ["graph_id", "node_id"], "left_semi").distinct()


#: The kinds of nodes that each count takes.
COUNTED = {"claims": ["claim", "primary_claim", "subclaim"], "hypotheses": ["hypothesis"], "assumptions": ["assumption"], "missing_evidence": ["missing_evidence"], "calculations": ["calculation"], "sources": ["source"]}


def graph_counts(nodes: DataFrame, roles: DataFrame) -> DataFrame:
    """(graph_id, a count for each of COUNTED, evidence, counter_evidence, context) with zeros, for each graph that has nodes."""
    per = nodes.groupBy("graph_id").agg(*[F.count_if(F.col("kind").isin(kinds)).alias(name) for name, kinds in COUNTED.items()])
    by = lambda r: F.countDistinct(F.when(F.col("role") == r, F.col("node_id")))
    held = roles.groupBy("graph_id").agg(by("support").alias("evidence"), by("counter").alias("counter_evidence"), by("context").alias("context"))
    return per.join(held, "graph_id", "left").fillna(0, ["evidence", "counter_evidence", "context"])


def requirement_coverage(requirements: DataFrame) -> DataFrame:
    """(graph_id, total, satisfied, unknown) of requirements (graph_id, status); any other or no status is unknown."""
    known = F.col("status").isin("satisfied", "unsatisfied", "partial")
    return requirements.groupBy("graph_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "satisfied").alias("satisfied"), F.count_if(~F.coalesce(known, F.lit(False))).alias("unknown"))


#: What evidence an assessment can be of, and how it can relate to a hypothesis.
SOURCE_KINDS = ["claim", "observation", "calculation", "inference"]
RELATIONS = ["supports", "contradicts", "weakens", "context_for", "unrelated"]


def relationship_diagnostics(assessed: DataFrame) -> DataFrame:
    """(graph_id, source_kind, relation, n), zeros included; source_kind 'all' is the sum over every kind.

    assessed: (graph_id, source_kind, relation). One aggregation, whose counts then become rows.
    """
    cells = [(k, r, (F.col("relation") == r) & (F.lit(True) if k == "all" else F.col("source_kind") == k)) for k in ["all", *SOURCE_KINDS] for r in RELATIONS]
    wide = assessed.groupBy("graph_id").agg(*[F.count_if(c).alias(f"{k}.{r}") for k, r, c in cells])
    rows = F.array(*[F.struct(F.lit(k).alias("source_kind"), F.lit(r).alias("relation"), F.col(f"`{k}.{r}`").alias("n")) for k, r, _ in cells])
    return wide.select("graph_id", F.inline(rows))


def pair_set_violations(expected: DataFrame, returned: DataFrame) -> DataFrame:
    """(source_kind, source_id, hypothesis_id, violation): pairs that are missing, unexpected or repeated in what was returned (U8)."""
    key = ["source_kind", "source_id", "hypothesis_id"]
    asked = expected.select(*key, F.lit(1).alias("asked"), F.lit(0).alias("given"))
    both = asked.unionByName(returned.select(*key, F.lit(0).alias("asked"), F.lit(1).alias("given"))).groupBy(*key).agg(F.max("asked").alias("asked"), F.sum("given").alias("given"))
    wrong = F.array_compact(F.array(F.when(F.col("given") == 0, "missing"), F.when(F.col("asked") == 0, "unexpected"), F.when(F.col("given") > 1, "repeated")))
    return both.select(*key, F.explode(wrong).alias("violation"))


def temporal_summary(roles: DataFrame) -> DataFrame:
    """(graph_id, evidence, support, counter): distinct nodes by role."""
    by = lambda r: F.countDistinct(F.when(F.col("role") == r, F.col("node_id")))
    return roles.groupBy("graph_id").agg(F.countDistinct("node_id").alias("evidence"), by("support").alias("support"), by("counter").alias("counter"))


def affected_hypotheses(edges: DataFrame, requirements: DataFrame) -> DataFrame:
    """(graph_id, requirement, node): parents by 'requires', and one edge of support, weakening, contradiction or context on."""
    parents = edges.filter("kind = 'requires'").join(requirements.select("graph_id", F.col("node_id").alias("target")), ["graph_id", "target"]).select("graph_id", F.col("target").alias("requirement"), F.col("source").alias("node"))
    hop = edges.filter(F.col("kind").isin(HOPS)).select("graph_id", F.col("source").alias("node"), F.col("target").alias("next"))
    return parents.unionByName(parents.join(hop, ["graph_id", "node"]).select("graph_id", "requirement", F.col("next").alias("node"))).distinct()


def foreign_key_violations(checks: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """(check, graph_id, ref): references (graph_id, ref) that no target (graph_id, id) has, for each named check."""
    found = [refs.select("graph_id", "ref").distinct().join(ids.select("graph_id", F.col("id").alias("ref")), ["graph_id", "ref"], "left_anti").select(F.lit(name).alias("check"), "graph_id", "ref") for name, refs, ids in checks]
    return reduce(DataFrame.unionByName, found)


def duplicate_ids(objects: DataFrame) -> DataFrame:
    """(kind, id, n): ids that occur more than once within a kind."""
    return objects.groupBy("kind", "id").agg(F.count("*").alias("n")).filter("n > 1")


def followup_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(graph_id, relation, added): edges that came with a follow-up, counted by relation."""
    key = ["graph_id", "source", "target", "kind"]
    return after.select(*key).distinct().join(before.select(*key), key, "left_anti").groupBy("graph_id", F.col("kind").alias("relation")).agg(F.count("*").alias("added"))


def merge_followup(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows as they are, and new ones with keys of their own."""
    return old.unionByName(new.join(old, key, "left_anti"), allowMissingColumns=True)


def review_state(events: DataFrame) -> DataFrame:
    """(item_id, decision, owner, status): the last valid decision on each item.

    A decision needs an owner and a note, an approval a purpose too; later events win, then the larger event_id. events: (item_id, event_id, at,
    decision, owner, note, purpose).
    """
    full = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    valid = events.filter(full("owner") & full("note") & ((F.col("decision") != "approved") | full("purpose")))
    last = valid.groupBy("item_id").agg(F.max_by(F.struct("decision", "owner"), F.struct("at", "event_id")).alias("d"))
    status = F.when(F.col("d.decision") == "challenged", "challenged").when(F.col("d.decision") == "approved", "approved").when(F.col("d.decision") == "unresolved", "unresolved").otherwise("needs_review")
    return last.select("item_id", "d.decision", "d.owner", status.alias("status"))


def explanation_graph(assessments: DataFrame, evidence: DataFrame, criteria: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges: a claim for each assessment, a subclaim for each criterion, its evidence, and sources once a lineage."""
    ident = lambda prefix, *cs: F.concat(F.lit(prefix + "-"), F.substring(F.sha1(F.concat_ws("|", *cs)), 1, 12))
    g = F.col("assessment_id").cast("string")
    claim = ident("CLM", g)
    sub = ident("SUB", g, F.col("name"))
    item = ident("EVD", g, F.col("evidence_id").cast("string"))
    origin = ident("SRC", g, F.col("lineage_id").cast("string"))
    row = lambda df, node, kind: df.select(g.alias("graph_id"), node.alias("node_id"), F.lit(kind).alias("kind"))
    nodes = row(assessments, claim, "claim").unionByName(row(criteria, sub, "subclaim")).unionByName(row(evidence, item, "evidence")).unionByName(row(evidence, origin, "source")).dropDuplicates()
    link = lambda df, a, b, kind: df.select(g.alias("graph_id"), a.alias("source"), b.alias("target"), kind.alias("kind"))
    used = criteria.withColumn("evidence_id", F.explode("evidence_ids"))
    edges = link(criteria, sub, claim, F.lit("part_of")).unionByName(link(used, item, sub, F.lit("supports"))).unionByName(link(evidence, item, origin, F.lit("derived_from")))
    edges = edges.unionByName(link(evidence, item, claim, F.col("stance")))
    return nodes, edges.dropDuplicates()


def report_lines(nodes: DataFrame, sections: DataFrame) -> DataFrame:
    """(graph_id, line_no, line): nodes as text in the order of their kinds' sections (C35, S12). sections: (kind, position, title)."""
    df = nodes.join(F.broadcast(sections), "kind")
    w = W.partitionBy("graph_id").orderBy("position", "node_id")
    return df.select("graph_id", F.row_number().over(w).alias("line_no"), F.concat_ws(" ", F.concat(F.col("title"), F.lit(":")), F.col("node_id")).alias("line"))


def claim_summary(edges: DataFrame, claims: DataFrame) -> DataFrame:
    """(graph_id, claim, supporting, counter): distinct neighbours of each claim by the sign of their edge."""
    df = edges.join(claims.select("graph_id", F.col("node_id").alias("target")), ["graph_id", "target"])
    by = lambda *k: F.countDistinct(F.when(F.col("kind").isin(*k), F.col("source")))
    return df.groupBy("graph_id", F.col("target").alias("claim")).agg(by("supports", "strengthens").alias("supporting"), by("contradicts", "weakens").alias("counter"))
