"""The registered queries of the operators in this subpackage, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import chat_format, decontaminate, hard_negatives, html_extract, jaccard_join, language_id, lexical_search, line_dedup, oracles, quality_rules, secret_scan, source_mix, substring_dedup, warc_zip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.without_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "clean_text")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("path"))
    out = secret_scan.scanned(docs)
    return out.select("doc_id", F.col("at").alias("word_index"), F.sha2("value", 256).alias("value_sha256"), F.length("value").cast("long").alias("n_chars"), F.round("score", 6).alias("score"), "is_secret")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.joined(table(spark, sf_dir, "documents"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = source_mix.mixed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat_format.digests(chat_format.formatted(turns.unionByName(more)))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.filter(~language_id.held_out()))
    out = language_id.identified(docs.drop("lang"), model)
    return out.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op9_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc_zip.round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.searched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_line_dedup": op2_line_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_source_mix": op5_source_mix,
    "op6_html_extract": op6_html_extract,
    "op7_chat_format": op7_chat_format,
    "op8_language_id": op8_language_id,
    "op9_warc_zip": op9_warc_zip,
    "op10_decontaminate": op10_decontaminate,
    "op11_lexical_search": op11_lexical_search,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLE: dict[str, str] = {
    "op1_quality_rules": oracles.OP1,
    "op2_line_dedup": oracles.OP2,
    "op10_decontaminate": oracles.OP10,
    "op11_lexical_search": oracles.OP11,
    "op12_substring_dedup": oracles.OP12,
    "op13_hard_negatives": oracles.OP13,
}
