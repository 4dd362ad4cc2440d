"""The pipeline: its stages' contracts, planted cases, and edge cases of each stage."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_llm import DOC, brute_components, prose


def planted(spark):
    rng = random.Random(12)
    letters = {"aa": "abcdefg", "bb": "hijklmn"}
    rows = [(i, "Shared footer line\n" + prose(rng, 70, letters[k]), k, f"s{i % 2}", 1) for i, k in enumerate(rng.choices(list(letters), k=60))]
    item = prose(rng, 30, letters["aa"])
    rows += [(100, rows[3][1], "aa", "s0", 1), (101, prose(rng, 40, "abcdefg") + " " + item, "aa", "s1", 1), (102, "12 34", "aa", "s0", 1), (103, None, "aa", "s0", 0)]
    return spark.createDataFrame(rows, DOC), item


def test_stages_in_order_keep_clean_documents(spark, tmp_path):
    docs, item = planted(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "jaccard_join", "decontaminate", "source_mix"]
    kept, ids = docs, []
    for name, stage in cp.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path)).cache()
        assert kept.columns == cp.COLUMNS, name
        ids.append({r.doc_id for r in kept.select("doc_id").collect()})
    everything = set(range(60)) | {100, 101}
    assert ids[0] == ids[1] == everything and ids[2] == everything - {100} and ids[3] == everything - {100, 101}
    assert kept.filter(F.col("text").contains("footer")).count() == 0
    texts = {r.doc_id: r.text for r in cp.lines(spark, docs.filter("doc_id < 102"), str(tmp_path)).collect()}
    groups = brute_components(texts)
    assert ids[2] == {i for i, c in groups.items() if i == c}
    out = cp.run(spark, str(tmp_path)).toPandas()
    words = sum(len(r.text.split()) for r in kept.collect())
    assert set(out.doc_id) <= ids[3] and (out.copies >= 1).all() and out.taken.sum() == pytest.approx(words, abs=200)


def test_a_third_of_copies_keeps_one(spark):
    rng = random.Random(7)
    copy = "\n".join(prose(rng, 12) for _ in range(6))
    rows = [(i, copy if i < 20 else f"Shared footer line\n{prose(rng, 40)}", "en", "s", 1) for i in range(60)]
    rows += [(100 + i, copy if i < 5 else prose(rng, 40), "en", "small", 1) for i in range(9)]
    cleaned = cp.lines(spark, spark.createDataFrame(rows, DOC), "")
    texts = {r.doc_id: r.text for r in cleaned.collect()}
    assert all(texts[i] == copy for i in [*range(20), *range(100, 105)]) and not any("footer" in t for t in texts.values()) and len(texts) == 69
    only = [(i, f"Menu\n{'' if i % 2 else 'Home'}{' ' * i}", "en", "s", 1) for i in range(30)]
    assert cp.lines(spark, spark.createDataFrame(only, DOC), "").filter("text like 'Menu%'").count() == 30


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES], ids=[n for n, _ in cp.STAGES])
def test_each_stage_takes_anything(spark, tmp_path, stage):
    spark.createDataFrame([(1, "same text here that is long enough"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rng = random.Random(1)
    rows = [(None, "abc def", None, None, None, "k"), (1, None, "aa", None, 0, "k"), (2, "", None, "s", 0, "k"), (3, prose(rng, 20_000), "aa", "s", 1, "k"), (4, "same words", "aa", "s", 1, "k"), (4, "same words", "aa", "s", 1, "k")]
    docs = spark.createDataFrame(rows, DOC + ", _part string")
    assert stage(spark, docs, str(tmp_path)).count() <= len(rows)
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
