"""A pipeline over the documents: language, boilerplate lines, near copies, benchmark leaks, then the mix of sources.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of documents; the last gives
what the mix takes of each document. ``run`` writes each stage's rows as Parquet in the shared folder and reads them
for the next one. Stages keep null ids and sources, repeated rows and ties as their operators say (a document without text or
letters goes in the first stage), run on tables without rows, and return the columns of documents alone: extra ones end at the first stage. No SQL states the first stage (a trained classifier) nor the last (a hash-ranked sample), so
ORACLE_SQL is None; tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import decontaminate, jaccard_join, language_id, line_dedup, source_mix
from marlstone.llm.text import unused
from marlstone.plans.shared import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The least score with which a language counts as identified. 0.5 is the boundary between yes and no for a language.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the known languages; those without a letter, or that resemble no language, go."""
    model = language_id.fit(docs.filter(~language_id.held_out()))
    out = language_id.identified(docs, model)
    return out.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines; those that have nothing else stay as they are, for the join to keep one.

    Copies of a text count as one page, so that a group of copies doesn't make its own lines boilerplate.
    """
    out = line_dedup.without_boilerplate(docs, copies=False)
    text = F.when((F.col("n_removed") > 0) & (F.col("n_removed") >= F.col("n_lines")), F.col("text")).otherwise(F.col("clean_text"))
    return out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the Jaccard join, the one with the smallest id. Of rows with one id, all or none stay."""
    groups, other = jaccard_join.joined(docs), unused(docs, "other")
    others = groups.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(other)).distinct()
    return docs.join(others, F.col("doc_id") == F.col(other), "left_anti").select(*COLUMNS)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: (doc_id, source, size, target, copies, taken) of the documents taken at least once."""
    return source_mix.mixed(docs).filter("copies > 0").select("doc_id", "source", "size", "target", "copies", "taken")


STAGES = [("language_id", language), ("line_dedup", lines), ("jaccard_join", copies), ("decontaminate", leaks), ("source_mix", mix)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
