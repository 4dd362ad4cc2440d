"""Evidence-based scoring of candidate explanations, one row for each assessment.

Tables: assessment (assessment_id, as_of_at, anomaly_start_at, anomaly_end_at); evidence (assessment_id, evidence_id, role, stance, lineage_id,
published_at); criterion (assessment_id, name, value, evidence_ids).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The policy's weights, role qualities and thresholds.
WEIGHTS = {
    "temporal_fit": 0.18, "relationship_directness": 0.14, "economic_plausibility": 0.14, "materiality": 0.12, "directional_consistency": 0.10,
    "source_independence": 0.08, "primary_source_support": 0.08, "novelty": 0.06, "market_footprint_fit": 0.10,
}
CORE = ["temporal_fit", "relationship_directness", "economic_plausibility"]
QUALITY = {"primary_source": 1.0, "independent_reporting": 0.8, "secondary_analysis": 0.5, "syndicated_report": 0.35, "market_data": 0.0}
PENALTY, GRACE_HOURS, HALF_LIFE_HOURS, SOURCES = 0.25, 24.0, 48.0, 3
LEAST_COVERAGE, CORE_FLOOR, THIN_CAP, WEAK_CAP, PLAUSIBLE, STRONG = 0.70, 0.25, 60.0, 40.0, 65.0, 85.0
SUPPLIED = [c for c in WEIGHTS if c not in ("temporal_fit", "source_independence", "primary_source_support")]


def _rounded(c: Column, digits: int) -> Column:
    """c to so many digits, halves away from zero, as SQL rounds doubles: 0.53125 is 0.5313."""
    return F.round(c * 10.0**digits) / 10.0**digits


def available_evidence(assessments: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence out by the earlier of cutoff and end of the anomaly."""
    cut = assessments.select("assessment_id", "anomaly_start_at", F.least("as_of_at", "anomaly_end_at").alias("cutoff"))
    return evidence.join(cut, "assessment_id").filter("published_at <= cutoff")


def criterion_values(criteria: DataFrame, available: DataFrame) -> DataFrame:
    """(assessment_id, name, value): null without evidence ids, or with one that wasn't available."""
    ids = criteria.select("assessment_id", "name", "value", F.explode_outer(F.array_distinct("evidence_ids")).alias("evidence_id"))
    known = available.select("assessment_id", "evidence_id", F.lit(1).alias("known")).distinct()
    per = ids.join(known, ["assessment_id", "evidence_id"], "left").groupBy("assessment_id", "name").agg(F.max("value").alias("value"), F.count("evidence_id").alias("n"), F.count("known").alias("ok"))
    return per.select("assessment_id", "name", F.when((F.col("n") > 0) & (F.col("n") == F.col("ok")), F.col("value")).alias("value"))


def lineage_quality(evidence: DataFrame) -> DataFrame:
    """(assessment_id, stance, weight): the best role of each lineage, summed."""
    quality = F.lit(0.0)
    for role, q in QUALITY.items():
        quality = F.when(F.col("role") == role, q).otherwise(quality)
    per = evidence.groupBy("assessment_id", "stance", "lineage_id").agg(F.max(quality).alias("q"))
    return per.groupBy("assessment_id", "stance").agg(F.sum("q").alias("weight"))


def causal_score(assessments: DataFrame, evidence: DataFrame, criteria: DataFrame) -> DataFrame:
    """(assessment_id, eligible, score, classification, coverage, contradiction, ...)."""
    available = available_evidence(assessments, evidence)
    news = available.filter("role <> 'market_data'")
    quality = lineage_quality(news).groupBy("assessment_id").pivot("stance", ["supports", "contradicts"]).agg(F.first("weight"))
    support = news.filter("stance = 'supports'").groupBy("assessment_id").agg(
        F.min("published_at").alias("first_public"), F.countDistinct("lineage_id").alias("lineages"), F.max(F.when(F.col("role") == "primary_source", 1.0).otherwise(0.0)).alias("primary_source_support"))
    given = criterion_values(criteria, available).groupBy("assessment_id").pivot("name", SUPPLIED).agg(F.first("value"))
    df = assessments.join(support, "assessment_id", "left").join(quality, "assessment_id", "left").join(given, "assessment_id", "left")
    hours = F.greatest(F.lit(0.0), (F.unix_micros("anomaly_start_at") - F.unix_micros("first_public")) / 3.6e9)
    fit = F.when(hours <= GRACE_HOURS, F.lit(1.0)).otherwise(F.pow(F.lit(0.5), (hours - GRACE_HOURS) / HALF_LIFE_HOURS))
    eligible = F.col("first_public").isNotNull()
    against = F.least(F.lit(1.0), F.try_divide(F.coalesce("contradicts", F.lit(0.0)), F.col("supports")))
    df = df.withColumns({"eligible": eligible, "temporal_fit": _rounded(fit, 4), "source_independence": _rounded(F.least(F.lit(1.0), F.col("lineages") / SOURCES), 4), "contradiction": _rounded(F.coalesce(F.when(F.col("supports") > 0, against), F.lit(0.0)), 4)})
    coverage = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in WEIGHTS.items()), F.lit(0.0))
    base = sum((w * F.coalesce(F.col(c), F.lit(0.0)) for c, w in WEIGHTS.items()), F.lit(0.0))
    missing = sum((F.col(c).isNull().cast("int") for c in CORE), F.lit(0)) > 0
    weak = sum((F.coalesce(F.col(c) < CORE_FLOOR, F.lit(False)).cast("int") for c in CORE), F.lit(0)) > 0
    df = df.withColumns({"coverage": coverage, "raw": 100 * F.greatest(F.lit(0.0), base - PENALTY * F.col("contradiction")), "missing_core": missing, "weak_core": weak})
    thin = _rounded(F.col("coverage"), 9) < LEAST_COVERAGE
    score = F.least(F.col("raw"), F.when(thin, F.lit(THIN_CAP)).otherwise(F.lit(1e9)), F.when(F.col("weak_core"), F.lit(WEAK_CAP)).otherwise(F.lit(1e9)))
    df = df.withColumn("capped", _rounded(score, 9))
    label = F.when(~F.col("eligible"), "ineligible").when(F.col("missing_core") | thin, "insufficient_evidence").when(F.col("capped") >= STRONG, "strong_candidate").when(F.col("capped") >= PLAUSIBLE, "plausible").otherwise("weak")
    zero = lambda c: F.when(F.col("eligible"), c).otherwise(F.lit(0.0))
    return df.select("assessment_id", "eligible", zero(_rounded(F.col("capped"), 1)).alias("score"), label.alias("classification"), zero(_rounded(F.col("coverage"), 3)).alias("coverage"), zero(F.col("contradiction")).alias("contradiction"))


def assessment_violations(assessments: DataFrame, evidence: DataFrame, criteria: DataFrame) -> DataFrame:
    """(assessment_id, violation): wrong time order, repeated evidence ids, criteria that name unknown evidence."""
    order = assessments.filter("anomaly_end_at < anomaly_start_at or as_of_at < anomaly_start_at").select("assessment_id", F.lit("timeline").alias("violation"))
    twice = evidence.groupBy("assessment_id", "evidence_id").count().filter("count > 1").select("assessment_id", F.lit("repeated evidence").alias("violation"))
    named = criteria.select("assessment_id", F.explode("evidence_ids").alias("evidence_id"))
    unknown = named.join(evidence, ["assessment_id", "evidence_id"], "left_anti").select("assessment_id", F.lit("unknown evidence").alias("violation"))
    return order.unionByName(twice).unionByName(unknown).distinct()
