"""Hard-negative mining: a secondary-sort shuffle of pair scores, read by an iterator that opens windows at positives.

1. Vectors are turned into integers, packed into blocks, and scored against the anchors' blocks by matrix products. Of a block's scores, a task
   sends on only what can count: the first ``positives`` rows of an anchor's own label and, once its windows are known, the first
   ``negatives`` rows of other labels in each. What is left out comes after as many others in the same block, so nothing is lost.
2. A pair's score is packed into a 25-byte key whose byte order is (anchor, descending score, positive before negative, id). Rows are partitioned by anchor
   and sorted by key within partitions: the shuffle does the grouping, and no anchor's rows are gathered.
3. A streaming iterator reads the sorted keys. Each of an anchor's first positives opens a window [low, high] of scores; each negative is given to
   the open windows that hold its score and aren't full; a new anchor closes all. It keeps one anchor's open windows and nothing else.
The shuffle runs twice: the first finds the windows (no negatives yet), the second mines them.

Anchors are broadcast in blocks only while all of them, as counted, take at most ``broadcast_mb``; beyond, the rows' blocks are dealt to
groups of anchor blocks by an equi-join, one copy a group.

Products are exact: in doubles while every partial sum stays below 2^53, else in 64 bits, else in Python integers (scores beyond 64 bits are given
as the nearest 64-bit value). Edge cases: rows with a null label, a null vector or a null or non-finite component take no part, nor do rows without
an id, which nothing could name; rows that share an id are one row, that with the smallest (label, vector); a vector's missing components count as 0 where lengths
differ; equal scores go by id; an anchor without positives, or whose windows are empty, returns nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.plans.shared import written

BLOCK = "block long, ids binary, labels binary, width long, data binary, lows binary, highs binary"
KEY = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
_TOP = np.uint64(1 << 63)
_MOST = 2**63 - 1


def packed_keys(anchor: np.ndarray, score: np.ndarray, negative: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Keys whose order as bytes is (anchor, score descending, positives first, id)."""
    out = np.empty(len(anchor), dtype=KEY)
    out["anchor"], out["id"] = anchor.view(np.uint64) ^ _TOP, ids.view(np.uint64) ^ _TOP
    out["score"], out["kind"] = ~(score.view(np.uint64) ^ _TOP), negative
    return out


def unpacked_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, score, negative, id) of packed keys."""
    plain = lambda x: (x.astype(np.uint64) ^ _TOP).view(np.int64)
    return plain(keys["anchor"]), plain(~keys["score"].astype(np.uint64)), keys["kind"].astype(bool), plain(keys["id"])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers held in doubles, exactly, as 64-bit integers."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    most = lambda x: int(np.abs(x).max(initial=0))
    bound = most(a) * most(b) * max(1, width)
    if bound < 2**53:
        return (a @ b.T).astype(np.int64)
    if bound < 2**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = [[int(x) for x in row] for row in a.tolist()], [[int(x) for x in row] for row in b.tolist()]
    return np.array([[max(-_MOST, min(_MOST, sum(x * y for x, y in zip(p, q, strict=True)))) for q in exact[1]] for p in exact[0]], dtype=np.int64).reshape(len(a), len(b))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, label, vec, lows, highs) packed by ``size``: one row of bytes a block, its ids in ascending order."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, size):
                part = batch.slice(low, size)
                ids = part.column("id").to_numpy()
                by = np.argsort(ids, kind="stable")
                lists = [part.column(c) for c in ("vec", "lows", "highs")]
                ends = [x.offsets.to_numpy() for x in lists]
                made = []
                for x, at in zip(lists, ends, strict=True):
                    flat = x.flatten().to_numpy(zero_copy_only=False)
                    wide = np.zeros((len(ids), int(np.diff(at).max(initial=0))), dtype=flat.dtype)
                    place = np.arange(len(flat)) - np.repeat(at[:-1] - at[0], np.diff(at))
                    wide[np.repeat(np.arange(len(ids)), np.diff(at)), place] = flat
                    made.append(wide[by])
                # A window that an anchor hasn't got is (1, 0): empty.
                for x, at, none in zip(made[1:], ends[1:], (1, 0), strict=True):
                    x[np.arange(x.shape[1])[None, :] >= np.diff(at)[by][:, None]] = none
                labels = part.column("label").to_numpy()[by]
                row = [int(ids.min()), ids[by].tobytes(), labels.tobytes(), made[0].shape[1], made[0].tobytes(), made[1].tobytes(), made[2].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary()], strict=True)], ["block", "ids", "labels", "width", "data", "lows", "highs"])

    return rows.select("id", "label", "vec", "lows", "highs").mapInArrow(pack, BLOCK)


def _first(scores: np.ndarray, allowed: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's ``most`` best allowed scores, by score and then column. Columns are in order of ids."""
    n = scores.shape[1]
    low, high = int(scores.min(initial=0)), int(scores.max(initial=0))
    if max(abs(low), abs(high)) < 2**62 // max(1, n):
        key = np.where(allowed, scores * n + (n - 1 - np.arange(n)), -_MOST)
        at = np.argpartition(key, -most, axis=1)[:, -most:] if n > most else np.broadcast_to(np.arange(n), scores.shape)
    else:
        at = np.argsort(np.where(allowed, -scores, _MOST), axis=1, kind="stable")
        keep = np.take_along_axis(allowed, at, axis=1)
        at, n = np.where(keep, at, -1)[:, :most], min(n, most)
        row, col = np.nonzero(at >= 0)
        return row, at[row, col]
    row, col = np.nonzero(np.take_along_axis(allowed, at, axis=1))
    return row, at[row, col]


def _scored(pairs: DataFrame, positives: int, negatives: int) -> DataFrame:
    """(anchor, key) for what can count of each pair of blocks: an anchor's best positives, and the best negatives of each of its windows."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                read = lambda name, kind=np.int64, row=row: np.frombuffer(row[name], dtype=kind)
                ids, others = read("a_ids"), read("ids")
                left, right = read("a_data", np.float64).reshape(len(ids), -1), read("data", np.float64).reshape(len(others), -1)
                s = products(left, right)
                same = read("a_labels")[:, None] == read("labels")[None, :]
                r, c = _first(s, same & (ids[:, None] != others[None, :]), positives)
                found = [(r, c, np.zeros(len(r), dtype=bool))]
                lows, highs = read("a_lows").reshape(len(ids), -1), read("a_highs").reshape(len(ids), -1)
                for k in range(lows.shape[1]):
                    inside = ~same & (s >= lows[:, k : k + 1]) & (s <= highs[:, k : k + 1])
                    if inside.any():
                        r, c = _first(s, inside, negatives)
                        found.append((r, c, np.ones(len(r), dtype=bool)))
                r, c, kind = (np.concatenate(x) for x in zip(*found, strict=True))
                keys = packed_keys(ids[r], s[r, c], kind, others[c])
                whole = list(dict.fromkeys(keys.tobytes()[i : i + KEY.itemsize] for i in range(0, keys.nbytes, KEY.itemsize)))
                anchors, _, _, _ = unpacked_keys(np.frombuffer(b"".join(whole), dtype=KEY))
                yield pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(whole, pa.binary())], ["anchor", "key"])

    return pairs.mapInArrow(score, "anchor long, key binary")


def _paired(rows: DataFrame, anchors: DataFrame, broadcast_mb: int, group: int) -> DataFrame:
    """Each block of rows beside each block of anchors (columns a_...)."""
    renamed = anchors.select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns])
    mb = (anchors.agg(F.sum(F.length("data") + F.length("ids") + F.length("labels") + F.length("lows") + F.length("highs"))).first()[0] or 0) / 1e6
    # Anchor blocks in groups: one that is broadcast, or groups of about ``group`` MB, to each of which each block of rows travels once.
    groups = 1 if mb <= broadcast_mb else max(2, round(mb / group))
    dealt = renamed.withColumn("g", F.pmod(F.xxhash64("a_block"), F.lit(groups)))
    copies = rows.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    return copies.join(F.broadcast(dealt) if groups == 1 else dealt, "g").drop("g")


def _sorted(keys: DataFrame) -> DataFrame:
    """Keys partitioned by anchor and sorted within partitions."""
    return keys.repartition("anchor").sortWithinPartitions("key")


def _windows(keys: DataFrame, positives: int, low: int, high: int) -> DataFrame:
    """(anchor, lows, highs) of each anchor's first positives, from sorted keys."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, scores = None, []
        for batch in batches:
            out = []
            for a, s, _, _ in zip(*(x.tolist() for x in unpacked_keys(_keys(batch))), strict=True):
                if a != anchor:
                    if anchor is not None:
                        out.append((anchor, scores))
                    anchor, scores = a, []
                if len(scores) < positives:
                    scores.append(s)
            yield _window_rows(out, low, high)
        if anchor is not None:
            yield _window_rows([(anchor, scores)], low, high)

    return _sorted(keys).mapInArrow(read, "anchor long, lows array<long>, highs array<long>")


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("key").to_pylist()), dtype=KEY)


def _clipped(x: int) -> int:
    return max(-_MOST, min(_MOST, x))


def _window_rows(rows: list[tuple[int, list[int]]], low: int, high: int) -> pa.RecordBatch:
    """A window holds the scores s with low p <= 100 s <= high p, p the positive's score."""
    edges = [[(_clipped(-(-low * p // 100)), _clipped(high * p // 100)) for p in scores] for _, scores in rows]
    lows, highs = [[a for a, _ in x] for x in edges], [[b for _, b in x] for x in edges]
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.int64()), pa.array(lows, pa.list_(pa.int64())), pa.array(highs, pa.list_(pa.int64()))], ["anchor", "lows", "highs"])


def _mined(keys: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """What the windows of each anchor hold, from sorted keys."""
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, seen, open_ = None, 0, []
        for batch in batches:
            out = []
            for a, s, negative, i in zip(*(x.tolist() for x in unpacked_keys(_keys(batch))), strict=True):
                if a != anchor:
                    anchor, seen, open_ = a, 0, []
                if not negative:
                    if seen < positives:
                        seen += 1
                        open_.append([i, s, 0])
                    continue
                for window in open_:
                    if low * window[1] <= 100 * s <= high * window[1]:
                        window[2] += 1
                        out.append((a, window[0], window[2], i, window[1], s))
                # Scores only fall: a window is closed once it is full or its lower end is passed.
                open_ = [w for w in open_ if w[2] < negatives and 100 * s >= low * w[1]]
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "rank" else pa.int64()) for n, c in zip(names, columns, strict=True)], names)

    return _sorted(keys).mapInArrow(read, ", ".join(f"{n} {'int' if n == 'rank' else 'long'}" for n in names))


def usable(rows: DataFrame, factor: int = 256) -> DataFrame:
    """(id, label, vec) of the rows that take part; components are floor(factor x), whole numbers in doubles."""
    # floor() gives 64-bit integers: beyond them a component is a whole number as it is.
    large = F.transform("vec", lambda x: F.when(F.abs(x.cast("double")) < 2.0**44, F.floor(F.lit(float(factor)) * x.cast("double")).cast("double")).otherwise(F.lit(float(factor)) * x.cast("double")))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    kept = rows.filter("id is not null and label is not null and vec is not null").filter(fine)
    one = kept.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("r")).select("id", "r.label", "r.vec")
    return one.select("id", "label", large.alias("vec"))


def mined(
    rows: DataFrame, anchor: Column, *, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, factor: int = 256,
    block: int = 2048, anchor_block: int = 256, broadcast_mb: int = 64, group: int = 32, vec_id: str = "vec_id", label: str | Column = "label", vec: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows for which ``anchor`` (a condition on ``rows``' columns) holds. An anchor's positives are its first ``positives`` other rows of the same label, by integer
    inner product and then id. For each, the first ``negatives`` rows of other labels with low p <= 100 s <= high p are given, ranked from 1.
    """
    label = F.col(label) if isinstance(label, str) else label
    named = rows.select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vec).alias("vec"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    which = named.filter("is_anchor and id is not null").select("id").distinct()
    table = written(usable(named, factor), "vectors")
    none = F.array().cast("array<long>")
    blocks = written(_blocks(table.withColumns({"lows": none, "highs": none}), block).drop("lows", "highs"), "blocks")
    chosen = written(table.join(which, "id", "left_semi"), "anchors")
    plain = written(_blocks(chosen.withColumns({"lows": none, "highs": none}), anchor_block), "anchor_blocks")
    opened = written(_windows(_scored(_paired(blocks, plain, broadcast_mb, group), positives, negatives), positives, low, high), "windows")
    ready = written(_blocks(chosen.join(opened.withColumnRenamed("anchor", "id"), "id"), anchor_block), "window_blocks")
    return _mined(_scored(_paired(blocks, ready, broadcast_mb, group), positives, negatives), positives, negatives, low, high)
