"""Ranked lexical search: each item's best documents, found by branch and bound in document FP-trees.

1. Terms are runs of letters, digits and non-ASCII characters, with A-Z lower-cased. Each document becomes a restricted vector: its length and how
   often it holds each term of the items. The vectors are written once; the number of documents, their terms and each term's document
   frequency are aggregated from them over all rows.
2. Each task puts its vectors, in blocks, into FP-trees: a vector's terms are ordered by document frequency, the most frequent first, and
   vectors that begin alike share a path. A path ends where at most ``leaf`` documents are left on it, and small neighbouring
   branches share a leaf, so copies and texts of one language lie together. Each node holds, of all documents below it, the
   largest count of each term and the smallest length factor m.
3. For each item the tree is searched depth first, the child with the highest bound first. Scores grow with a term's count and fall with m, so
   the score of a node's maxima and minimum bounds every document below; a node whose bound is under the item's ``top``-th best so far is left out.
   A task keeps its best from block to block, and the tasks' best are ranked together.

Weights and scores are 64-bit integers, as in ``searched``. Items are taken ``chunk`` at a time (a chunk's terms are what is broadcast);
each further chunk is another pass over the documents.

Edge cases: a null or empty text has no terms; an item without terms, or whose terms no document holds, returns nothing; rows that share an item id
are one item with all their different texts' terms; a row without item id is an item, its id null; documents without doc_id count in the
statistics but can't be named, so they aren't ranked; rows that share a doc_id are ranked each for itself; equal scores go by ascending doc_id; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.plans.shared import written

_SEPARATORS = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_TABLE = bytes(0x20 if b in set(_SEPARATORS) else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts): each document's number of terms, and how often it holds those of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            n, ends, places, counts = [], [0], [], []
            for text in batch.column(1):
                words = terms(text.as_py())
                n.append(len(words))
                for word, count in Counter(words).items():
                    if word in known:
                        places.append(known[word])
                        counts.append(count)
                ends.append(len(places))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (places, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(make, f"doc_id {kind}, n long, terms array<int>, counts array<int>")


def saturated(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a count gives of a term's weight, in millionths: more with the count, less with m."""
    return (1_000_000_000 * counts) // (1000 * counts + 12 * m)


class FPTree:
    """The FP-tree of a block: ``places`` has each document's terms by frequency rank in ascending order, from ``starts[d]`` on."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, starts: np.ndarray, places: np.ndarray, counts: np.ndarray, width: int, leaf: int) -> None:
        lengths = np.diff(starts)
        order = np.arange(len(ids))
        self.first, self.last, self.children = [0], [len(ids)], [[]]
        todo = [(0, 0)]
        while todo:
            node, depth = todo.pop()
            low, high = self.first[node], self.last[node]
            mine = order[low:high]
            while high - low > leaf:  # a level that all share is no branch
                at = np.where(lengths[mine] > depth, places[np.minimum(starts[mine] + depth, len(places) - 1)], -1)
                if at.min() < at.max():
                    break
                if at[0] < 0:
                    low = high
                depth += 1
            if high - low <= leaf:
                continue
            by = np.argsort(at, kind="stable")
            order[low:high], at = mine[by], at[by]
            cuts = np.flatnonzero(np.diff(at)) + 1
            edges = [0, *cuts.tolist(), high - low]
            begin = 0
            for a, b in zip(edges, edges[1:], strict=False):
                if b - begin > leaf:
                    if a > begin:  # the small branches before this one are a leaf together
                        self._add(node, low + begin, low + a)
                        begin = a
                    if b - begin > leaf:
                        todo.append((self._add(node, low + begin, low + b), depth + 1))
                        begin = b
            if begin < high - low:
                self._add(node, low + begin, high)
        row = np.empty(len(ids), dtype=np.int64)
        row[order] = np.arange(len(ids))
        kind = np.min_scalar_type(int(counts.max())) if len(counts) else np.uint8
        self.ids, self.m = ids[order], m[order]
        self.counts = np.zeros((len(ids), width), dtype=kind)
        self.counts[np.repeat(row, lengths), places] = counts
        self.most = np.zeros((len(self.first), width), dtype=kind)
        self.least = np.zeros(len(self.first), dtype=np.int64)
        for node in range(len(self.first) - 1, -1, -1):  # children come after their parents
            if below := self.children[node]:
                self.most[node], self.least[node] = self.most[below].max(axis=0), self.least[below].min()
            else:
                part = slice(self.first[node], self.last[node])
                self.most[node], self.least[node] = self.counts[part].max(axis=0), self.m[part].min()

    def _add(self, parent: int, low: int, high: int) -> int:
        self.first.append(low)
        self.last.append(high)
        self.children.append([])
        self.children[parent].append(len(self.first) - 1)
        return len(self.first) - 1

    def search(self, places: np.ndarray, weights: np.ndarray, top: int, best: list[tuple]) -> list[tuple]:
        """The best ``top`` (-score, id) of ``best`` and this tree's documents, in order. ``best`` is one of its own results, or empty."""
        bound = lambda counts, m: saturated(counts[:, places].astype(np.int64), m[:, None]) @ weights
        every = self.most[:1], self.least[:1]
        stack = [(int(bound(*every)[0]), 0)]
        while stack:
            most, node = stack.pop()
            if most <= 0 or (len(best) == top and most < -best[-1][0]):
                continue
            if below := self.children[node]:
                bounds = bound(self.most[below], self.least[below])
                stack += [(int(bounds[k]), below[k]) for k in np.argsort(bounds, kind="stable")]
                continue
            part = slice(self.first[node], self.last[node])
            scores = bound(self.counts[part], self.m[part])
            good = np.flatnonzero(scores >= (-best[-1][0] if len(best) == top else 1))
            if len(good):
                if len(good) > top:  # the best of this leaf alone
                    good = good[np.lexsort((self.ids[part][good], -scores[good]))[:top]]
                best = sorted([*best, *zip((-scores[good]).tolist(), self.ids[part][good].tolist(), strict=True)])[:top]
        return best


def _found(batches: Iterator[pa.RecordBatch], items: list[tuple[np.ndarray, np.ndarray]], rank: np.ndarray, length: tuple[int, int], top: int, leaf: int, cells: int) -> Iterator[pa.RecordBatch]:
    """(item, doc_id, score): the best of the documents of one task."""
    best: list[list[tuple]] = [[] for _ in items]
    size, kind = max(leaf, cells // max(1, len(rank))), None
    n_docs, n_terms = length
    for batch in batches:
        kind = batch.schema.field("doc_id").type
        for low in range(0, batch.num_rows, size):
            part = batch.slice(low, size)
            held, counts = part.column("terms"), part.column("counts").flatten().to_numpy()
            starts = held.offsets.to_numpy().astype(np.int64)
            starts -= starts[0]
            places = rank[held.flatten().to_numpy()]
            by = np.lexsort((places, np.repeat(np.arange(part.num_rows), np.diff(starts))))
            m = 75 + (25 * part.column("n").to_numpy() * n_docs) // n_terms
            tree = FPTree(part.column("doc_id").to_numpy(zero_copy_only=False), m, starts, places[by], counts[by], len(rank), leaf)
            for k, (where, weights) in enumerate(items):
                best[k] = tree.search(where, weights, top, best[k])
    if kind is not None:
        rows = [(k, i, -s) for k, each in enumerate(best) for s, i in each]
        columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], kind), pa.array(columns[2], pa.int64())], ["item", "doc_id", "score"])


def _chunk(docs: DataFrame, items: list[tuple], top: int, leaf: int, cells: int) -> DataFrame:
    """(item, doc_id, score) for the items (number, their terms) of one chunk, ``top`` a task and item."""
    spark = docs.sparkSession
    vocabulary = {w: k for k, w in enumerate(sorted({w for _, words in items for w in words}))}
    table = written(vectors(docs, vocabulary), "vectors")
    n_docs, n_terms = table.agg(F.sum(F.when(F.col("n") > 0, 1).otherwise(0)), F.sum("n")).first()
    df = np.zeros(len(vocabulary), dtype=np.int64)
    for r in table.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row a term of the items at most
        df[r["t"]] = r["count"]
    by = np.lexsort((np.arange(len(df)), -df))
    rank = np.empty(len(df), dtype=np.int64)
    rank[by] = np.arange(len(df))
    queries = []
    for _, words in items:
        held = sorted((int(rank[vocabulary[w]]), c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df[vocabulary[w]]) + 1)))) for w, c in Counter(words).items() if df[vocabulary[w]])
        queries.append((np.array([p for p, _ in held], dtype=np.int64), np.array([w for _, w in held], dtype=np.int64)))
    known = spark.sparkContext.broadcast((queries, rank))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _found(batches, *known.value, (n_docs, n_terms), top, leaf, cells)

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = table.filter("doc_id is not null and size(terms) > 0").mapInArrow(find, f"item int, doc_id {kind}, score long")
    numbers = F.array(*[F.lit(n) for n, _ in items])
    return out.select(F.get(numbers, F.col("item")).alias("item"), "doc_id", "score")


def searched(docs: DataFrame, items: DataFrame, *, top: int = 20, leaf: int = 64, cells: int = 24_000_000, chunk: int = 500, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` documents with a score above 0, the highest first.

    A document with n terms has m = 75 + 25 n N div L, N being the documents with terms and L all their terms; a term of document frequency df
    weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))); a score is the sum over the item's terms, with repeats, of w (10^9 tf div (1000 tf + 12 m)).
    ``cells`` bounds the counts in a block (documents times the items' terms), so its memory.
    """
    doc = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    each = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).distinct()
    each = written(each.groupBy("item_id").agg(F.sort_array(F.collect_list("text")).alias("texts")).withColumn("number", F.xxhash64("item_id")), "items")
    parts = max(1, -(-each.count() // chunk))
    found = []
    for k in range(parts):
        rows = each.filter(F.pmod("number", F.lit(parts)) == k).select("number", "texts").collect()  # about ``chunk`` items
        mine = [(r["number"], [w for t in r["texts"] for w in terms(t)]) for r in rows]
        if mine := [(n, words) for n, words in mine if words]:
            found.append(_chunk(doc, mine, top, leaf, cells))
    if not found:
        return each.join(doc.select("doc_id").limit(0), F.lit(True)).select("item_id", F.lit(1).alias("rank"), "doc_id", F.lit(0).cast("long").alias("score"))
    # In two steps, so that no task gets what all tasks found of an item.
    out = reduce(DataFrame.unionByName, found)
    order = [F.col("score").desc(), F.col("doc_id")]
    for keys in ([F.col("item"), F.pmod(F.xxhash64("doc_id"), F.lit(64))], [F.col("item")]):
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= top)
    names = each.select(F.col("number").alias("item"), "item_id")
    return out.join(names, "item").select("item_id", "rank", "doc_id", "score")
