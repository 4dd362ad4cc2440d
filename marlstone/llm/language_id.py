"""Language identification by string kernels.

The kernel of two texts is the number of character n-grams (all lengths of ``lengths``: a blended spectrum) that occur in
both, however often, over the geometric mean of each text's own number. Texts are lower-cased and runs of white space count
as one space. n-grams are hashed to ``bits`` positions, so a text is a bit vector and kernels of a batch against all landmarks
are one matrix product. Nyström: a text's features are its kernels with the landmarks, times the inverse square root of the
landmarks' own kernel matrix; on these, one-versus-rest kernel ridge regression is solved in closed form.

Fitting takes a bounded sample: at most ``per_language`` labelled texts of each language and ``most_rows`` in all,
those whose hashes of id and text are lowest. Only their bit vectors reach the driver (2 KB each). Prediction reads whole texts.

Edge cases: a null text, or one without a letter (Unicode category L), is ``und`` with score 0; so is every text if no labelled row was
there to learn from. Labels that are null aren't learned; ids may be null or repeat, and rows with the same id and text are learned
once. Equal scores go to the first language in code-point order. Other columns are kept whatever their names; columns ``lang_pred``
and ``score`` of the caller's are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.llm.text import unused

LENGTHS, BITS, BATCH, CHUNK = (1, 2, 3), 14, 256, 1 << 20
_LETTER, _SPACES = regex.compile(r"\p{L}"), re.compile(r"\s+")


def presence(text: str, lengths: tuple[int, ...] = LENGTHS, bits: int = BITS) -> np.ndarray:
    """Which hashed n-grams occur in a text, as a vector of 2 ** bits booleans. Long texts go through in chunks."""
    out = np.zeros(1 << bits, dtype=bool)
    text, overlap = _SPACES.sub(" ", text.lower()), max(lengths) - 1
    for at in range(0, max(1, len(text)), CHUNK):
        points = np.frombuffer(text[at : at + CHUNK + overlap].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        h = np.zeros(len(points), dtype=np.uint64)
        for n in range(1, max(lengths) + 1):
            if len(points) < n:
                break
            h = (h[: len(points) - n + 1] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :] * np.uint64(0xC2B2AE3D27D4EB4F)
            h ^= h >> np.uint64(29)
            if n in lengths:
                out[(h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)] = True
    return out


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # packed bits, a row each
    weights: np.ndarray  # landmarks x languages, the bias below them

    def scores(self, bitmaps: np.ndarray) -> np.ndarray:
        """Decision values of a batch of bit vectors: texts x languages."""
        marks = np.unpackbits(self.landmarks, axis=1).astype(np.float32)
        return _kernel(bitmaps.astype(np.float32), marks) @ self.weights[:-1] + self.weights[-1]


def _kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    own = np.sqrt(np.maximum(a.sum(axis=1), 1))[:, None] * np.sqrt(np.maximum(b.sum(axis=1), 1))[None, :]
    return (a @ b.T) / own


def fit(labelled: DataFrame, *, per_language: int = 150, most_rows: int = 20_000, landmarks: int = 128, ridge: float = 0.01, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """A model from a bounded sample of labelled rows; None if there are none."""
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(doc_id, text).alias("u")).filter("text is not null and lang is not null")
    # Rows of one id and text count once, whatever their number. Languages beyond ``most_rows``, the rarest, aren't learned.
    counts = {r[0]: r[1] for r in rows.select("lang", "u").distinct().groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_rows).collect()}
    if not counts:
        return None
    each = max(1, min(per_language, most_rows // len(counts)))
    # About twice the wanted rows of each language by hash, then the lowest of these: no sort of all rows.
    tops = [F.struct(F.lit(name).alias("name"), F.lit((min(1.0, (2 * each + 20) / n) * 2 - 1) * 2.0**63).alias("top")) for name, n in sorted(counts.items())]
    some = rows.filter(F.exists(F.array(*tops), lambda t: (t["name"] == F.col("lang")) & (F.col("u").cast("double") <= t["top"])))
    some = some.groupBy("lang", "u").agg(F.first("text").alias("text"))
    lowest = some.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("u"))).filter(F.col("r") <= each)
    sample = lowest.select("u", "lang", _packed(F.col("text")).alias("bits")).toPandas().sort_values(["lang", "u"], kind="stable")
    languages = sorted(sample["lang"].unique())
    packed = np.stack([np.frombuffer(b, dtype=np.uint8) for b in sample["bits"]])
    x = np.unpackbits(packed, axis=1).astype(np.float32)
    turn = sample.groupby("lang").cumcount().to_numpy()  # landmarks in turn from each language
    chosen = np.argsort(turn, kind="stable")[:landmarks]
    own, vectors = np.linalg.eigh(_kernel(x[chosen], x[chosen]).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(own, 1e-6)) @ vectors.T
    features = np.hstack([_kernel(x, x[chosen]) @ root, np.ones((len(x), 1))])
    y = np.where(sample["lang"].to_numpy()[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    penalty = ridge * np.eye(features.shape[1])
    penalty[-1, -1] = 1e-9
    solved = np.linalg.solve(features.T @ features + penalty, features.T @ y)
    return Model(languages, packed[chosen], np.vstack([root @ solved[:-1], solved[-1:]]).astype(np.float32))


def _packed(text: Column) -> Column:
    @F.pandas_udf("binary")
    def bits(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: np.packbits(presence(t)).tobytes())

    return bits(text)


def identified(docs: DataFrame, model: Model | None, *, text: str = "text") -> DataFrame:
    """The documents with ``lang_pred`` and ``score`` (0 to 1) added."""
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        marks = np.unpackbits(model.landmarks, axis=1).astype(np.float32)
        own = np.sqrt(np.maximum(marks.sum(axis=1), 1))
        for texts in batches:
            names, scores = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
            full = [i for i, t in enumerate(texts) if t is not None and _LETTER.search(t)]
            for at in range(0, len(full), BATCH):
                part = full[at : at + BATCH]
                x = np.stack([presence(texts.iloc[i]) for i in part]).astype(np.float32)
                k = (x @ marks.T) / (np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None] * own[None, :])
                f = k @ model.weights[:-1] + model.weights[-1]
                best = f.argmax(axis=1)
                names[part] = np.array(model.languages, dtype=object)[best]
                scores[part] = np.clip((f[np.arange(len(part)), best] + 1) / 2, 0, 1)
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    p = unused(docs, "p")
    return docs.withColumn(p, predict(F.col(text))).withColumns({"lang_pred": F.col(p)["lang_pred"], "score": F.col(p)["score"]}).drop(p)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows from which nothing is learned: those with crc32(id as text) mod 4 = 2. A null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2
