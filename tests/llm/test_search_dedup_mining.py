"""Ranked search, substring removal and hard negatives against brute force, with their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import hard_negatives, lexical_search, substring_dedup
from tests.llm.test_llm import prose


def brute_search(docs, items, top=20):
    """The contract in plain Python: documents (id, text) and items (id, text)."""
    found = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words = [(i, found(t)) for i, t in docs]
    n_docs, size = sum(1 for _, w in words if w), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    out = set()
    for item, text in items:
        scores = []
        for i, w in words:
            if w and i is not None:
                tf, m = Counter(w), 75 + 25 * len(w) * n_docs // size
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t in found(text) if t in tf)
                if s > 0:
                    scores.append((-s, i))
        out |= {(item, k, i, -s) for k, (s, i) in enumerate(sorted(scores)[:top], 1)}
    return out


@pytest.mark.parametrize("options", [{}, {"top": 3, "leaf": 2, "cells": 400}, {"top": 5, "leaf": 1, "chunk": 2}])
def test_search_is_the_whole_ranking(spark, options):
    rng = random.Random(8)
    vocabulary = prose(rng, 60).split()
    text = lambda n: " ".join(rng.choice(vocabulary[: rng.choice([5, 20, 60])]) + rng.choice(["", ".", "É", "_x"]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 40)).upper() if i % 9 == 0 else text(rng.randint(0, 40))) for i in range(160)]
    docs += [(200 + i, docs[3][1]) for i in range(30)] + [(300, None), (301, " .,"), (None, docs[5][1]), (7, docs[8][1]), (302, "rare " * 3000)]
    items = [(k, text(rng.randint(1, 25))) for k in range(7)] + [(50, None), (51, "..."), (52, "unknown-words"), (None, docs[3][1]), (53, "rare rare " + vocabulary[0])]
    table = spark.createDataFrame([(i, t, 1.0, "x") for i, t in docs], "doc_id long, text string, score double, item string").repartition(5)
    asked = spark.createDataFrame(items * 2, "item_id long, text string")  # repeated rows count once
    got = {(r.item_id, r["rank"], r.doc_id, r.score) for r in lexical_search.searched(table, asked, **options).collect()}
    assert got == brute_search(docs, items, options.get("top", 20))
    assert lexical_search.searched(table.limit(0), asked).count() == 0 and lexical_search.searched(table, asked.limit(0)).count() == 0


def test_search_of_text_ids(spark):
    docs = spark.createDataFrame([("b", "snow fell"), ("a", "snow fell"), ("c", "rain")], "doc_id string, text string")
    out = lexical_search.searched(docs, spark.createDataFrame([(1, "snow")], "item_id int, text string")).orderBy("rank").collect()
    assert [(r["rank"], r.doc_id) for r in out] == [(1, "a"), (2, "b")]


def brute_kept(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {k + d for k in range(len(w) - window + 1) if count[tuple(w[k : k + window])] > 1 for d in range(window)}
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("options", [{"window": 35}, {"window": 12, "minimiser": 4, "hot": 3}, {"window": 5, "minimiser": 2, "bits": 6, "hot": 2}, {"window": 3, "minimiser": 8}])
def test_repeated_windows_go(spark, options):
    rng = random.Random(21)
    passage, line = prose(rng, 60), prose(rng, 14)
    texts: list[str | None] = [f"{prose(rng, rng.randint(0, 80))} {line}\n{prose(rng, rng.randint(0, 60))}" for _ in range(40)]
    texts += [f"{prose(rng, rng.randint(0, 40))}\t{passage}  {prose(rng, rng.randint(0, 40))}" for _ in range(8)]
    near = prose(rng, 120).split()
    for _ in range(12):
        w = near.copy()
        w[rng.randrange(120)] = prose(rng, 1)
        texts.append(" ".join(w))
    texts += [texts[0], "a " * 100, "a b " * 60 + "c", None, "", " \n", "one", "é\x0bü\x0cz " * 50, prose(rng, 36), "\U0001f600" * 9 + " " + prose(rng, 60), prose(rng, 20_000), "averyverylongword" * 40 + " x"]
    rows = [(None if i % 11 == 0 else i % 30, t, "key", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_text string, _key int").repartition(6)
    got = {r._key: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.deduplicated(docs, **options).collect()}
    want = brute_kept(texts, options["window"])
    assert len(got) == len(texts) and [k for k, w in enumerate(want) if got[k] != w] == []
    assert substring_dedup.deduplicated(docs.limit(0)).count() == 0


def test_super_kmers_cover_each_window_once():
    rng = random.Random(2)
    texts = [prose(rng, n) for n in (0, 5, 35, 36, 300, 34, 90)]
    words = substring_dedup.Words(texts)
    for chunk in (1 << 19, 50):
        at, n, _ = substring_dedup.super_kmers(words, 35, 8, chunk)
        covered = [k for a, c in zip(at.tolist(), n.tolist(), strict=True) for k in range(a, a + c)]
        assert sorted(covered) == [k for low, high in zip(words.first, words.first[1:], strict=False) for k in range(low, high - 34)]
    assert [hashlib.sha256(substring_dedup.Words([t]).packed).hexdigest() for t in ("a  b", None)] == [hashlib.sha256(b).hexdigest() for b in (b"a b", b"")]


def brute_mined(rows, anchors, positives=5, negatives=3):
    good = {}
    for i, label, vec in sorted((r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None), key=lambda r: (r[1], [(-1, 0) if x is None else (0, x) for x in r[2]])):
        if all(x is not None and math.isfinite(x) for x in vec):
            good.setdefault(i, (label, [math.floor(256 * float(x)) for x in vec]))
    out = set()
    for a in anchors & set(good):
        score = lambda j: sum(x * y for x, y in zip(good[a][1], good[j][1], strict=False))  # noqa: B023, E731
        ranked = sorted((j for j in good if j != a), key=lambda j: (-score(j), j))
        for p in [j for j in ranked if good[j][0] == good[a][0]][:positives]:
            fits = [j for j in ranked if good[j][0] != good[a][0] and 50 * score(p) <= 100 * score(j) <= 95 * score(p)]
            out |= {(a, p, k, j, score(p), score(j)) for k, j in enumerate(fits[:negatives], 1)}
    return out


@pytest.mark.parametrize("options", [{}, {"block": 7, "anchor_block": 3}, {"block": 16, "anchor_block": 2, "broadcast_mb": 0}])
def test_negatives_of_each_positive(spark, options):
    rng = random.Random(4)
    vec = lambda: [rng.choice([-0.5, 0.0, 0.25, 0.5, rng.random()]) for _ in range(4)]
    rows = [(i, rng.randrange(3), vec()) for i in range(-40, 120)]
    rows += [(200 + i, rng.randrange(3), [0.5, 0.25, 0.0, 0.5]) for i in range(40)]  # one very common vector
    rows += [(300, None, vec()), (301, 1, None), (302, 1, [None, 1.0, 0.0, 0.0]), (303, 2, [float("nan"), 0.0, 0.0, 0.0]), (304, 2, [float("inf"), 0.0, 0.0, 0.0]), (None, 1, vec()), (10, 2, vec()), (10, 0, vec()), (305, 0, [1.0]), (310, 0, []), (320, 9, [0.5, 0.5, 0.5, 0.5])]
    rows = [(i, label, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows]
    table = spark.createDataFrame([(*r, "s", 1) for r in rows], "vec_id long, label int, embedding array<float>, score string, g int").repartition(4)
    got = {tuple(r) for r in hard_negatives.mined(table, F.col("vec_id") % 10 == 0, **options).collect()}
    assert got == brute_mined(rows, {r[0] for r in rows if r[0] is not None and r[0] % 10 == 0})
    assert hard_negatives.mined(table.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_products_and_keys_are_exact():
    for size in (10.0, 2.0**30, 2.0**60):
        a, b = np.array([[size, -3.0, 1.0], [0.0, size, 2.0]]), np.array([[size, 7.0], [-size, 1.0]])
        want = [[max(-(2**63 - 1), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(p, [*q, 0.0], strict=True)))) for q in b.tolist()] for p in a.tolist()]
        assert hard_negatives.products(a, b).tolist() == want
    rng = np.random.default_rng(1)
    anchor, score, kind, ids = rng.integers(-5, 5, 200), rng.integers(-(2**62), 2**62, 200), rng.random(200) < 0.5, rng.integers(-50, 50, 200)
    keys = hard_negatives.packed_keys(anchor, score, kind, ids)
    back = hard_negatives.unpacked_keys(keys)
    assert all((x == y).all() for x, y in zip(back, (anchor, score, kind, ids), strict=True))
    by_bytes = sorted(range(200), key=lambda k: keys[k].tobytes())
    assert by_bytes == sorted(range(200), key=lambda k: (anchor[k], -int(score[k]), kind[k], ids[k]))
