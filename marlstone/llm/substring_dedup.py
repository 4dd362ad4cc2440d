"""Exact removal of repeated word windows by super-k-mer partitioning.

1. A window is ``window`` consecutive words. Its minimiser is its run of ``minimiser`` words with the smallest hash, the first of equals. Consecutive windows
   with the same minimiser (the same place, not just the same words) are a super-k-mer: their words travel once, as one packed
   string, where each window by itself would travel 35 times over. Equal windows have equal minimisers, so all of them meet in one bucket.
2. How often each minimiser occurs is counted over all documents. Two bitmaps of fixed size (2^``bits`` bits each) hold what occurs twice or more, and what
   occurs ``hot`` times or more. A super-k-mer whose minimiser occurs once can't repeat, so it doesn't travel. A bitmap errs by saying
   yes too often, which costs time and changes no result.
3. A minimiser that is hot gets its bucket split: each of its windows takes all its words as the minimiser and travels alone. Tasks count
   equal strings before they send them, so a passage that a third of all documents hold arrives about once a task.
4. Within a bucket (strings sorted by minimiser), the windows' hashes are sorted; equal ones of different strings are compared word by word
   before they count. Within one super-k-mer no two windows can be equal, as their minimiser stands at different places.
5. The windows found go back to the documents by the string's 128-bit digest, and the words they cover are removed. A third bitmap, of the texts that
   have any, lets the others be finished where they are.

Edge cases: a null or empty text has no words, nothing to remove and an empty kept text; a text of fewer words than a window keeps all; rows are told apart by text, so a null or repeated doc_id
changes nothing, and of two equal texts both lose their windows; overlapping windows of one text (``a a a ...``) count as repeats of each other; very long texts
are one row and one task's work; columns of the names that are added are replaced, others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.hashing import MIX, Words, bitmap, grams, held, least, mixed, parts
from marlstone.llm.text import unused
from marlstone.plans.shared import arrow_rows, written

_PLACE = np.uint64((1 << 20) - 1)


def super_kmers(words: Words, window: int, minimiser: int, chunk: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, n, minimiser's hash): the runs of windows within a text, by first window and their number, that share a minimiser's place.

    The order of minimisers is that of the upper 44 bits of their hashes, then of their places, which are the lower 20: ``chunk`` windows are taken at a time.
    """
    hashes, text = words.hashes(), np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    found = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64))]
    for low in range(0, len(hashes) - window + 1, chunk):
        part = slice(low, low + chunk + window - 1)
        g = grams(hashes[part], minimiser)
        place = (least((g & ~_PLACE) | np.arange(len(g), dtype=np.uint64), window - minimiser + 1) & _PLACE).astype(np.int64)
        owner = text[part]
        place[owner[: len(place)] != owner[window - 1 :]] = -1  # windows over two texts
        at = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        n = np.diff(np.concatenate([at, [len(place)]]))
        keep = place[at] >= 0
        found.append((at[keep] + low, n[keep], g[place[at[keep]]]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _width(window: int, minimiser: int) -> int:
    """The minimiser's words: at least so many that a super-k-mer's windows fit the bits of a mask."""
    return min(window, max(minimiser, window - 61))


def _bitmaps(docs: DataFrame, window: int, minimiser: int, bits: int, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """The bitmaps of the minimisers that occur twice or more, and ``hot`` times or more: each of 2^bits bits whatever the input."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [super_kmers(Words(some), window, minimiser)[2] for _, some in parts(batch.column(0).to_pylist())] or [np.empty(0, dtype=np.uint64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["h"])

    counts = docs.select("text").mapInArrow(make, "h long").groupBy("h").count().filter("count > 1")
    some, many = bitmap(counts, {"some": F.lit(True), "hot": F.col("count") >= hot}, bits)
    return some, many


def _marked(marks: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of the texts that have marks, by the first eight bytes of their keys."""
    h = F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("long")
    return bitmap(marks.select(h.alias("h")), {"some": F.lit(True)}, bits)[0]


def travelling(words: Words, bitmaps: tuple[np.ndarray, np.ndarray], window: int, minimiser: int, bits: int) -> list[tuple[int, int, int, int]]:
    """(text, first window within it, number of windows, minimiser's hash) of the strings that travel; windows by their words from the text's first on."""
    at, n, h = super_kmers(words, window, minimiser)
    keep = held(bitmaps[0], h, bits)
    at, n, h = at[keep], n[keep], h[keep]
    hot = held(bitmaps[1], h, bits)
    if hot.any():
        alone = np.concatenate([np.arange(a, a + k) for a, k in zip(at[hot].tolist(), n[hot].tolist(), strict=True)])
        own = grams(words.hashes(), window)
        at, n, h = np.concatenate([at[~hot], alone]), np.concatenate([n[~hot], np.ones(len(alone), dtype=np.int64)]), np.concatenate([h[~hot], own[alone]])
    text = np.searchsorted(words.first, at, side="right") - 1
    return list(zip(text.tolist(), (at - words.first[text]).tolist(), n.tolist(), h.view(np.int64).tolist(), strict=True))


def _key(text: str) -> bytes:
    return xxhash.xxh128_digest(text.encode("utf-8", "surrogatepass"))


def repeated_in(groups: np.ndarray, strings: list[bytes], copies: np.ndarray, window: int) -> list[int]:
    """For each string of super-k-mers, the bits of its windows that occur twice or more in its bucket. ``groups`` are the buckets, sorted."""
    masks = [0] * len(strings)
    sizes = [s.count(b" ") + 2 - window for s in strings]
    for k in np.flatnonzero(copies > 1).tolist():
        masks[k] = (1 << sizes[k]) - 1
    alone = np.concatenate([[True], groups[1:] != groups[:-1]]) & np.concatenate([groups[1:] != groups[:-1], [True]])
    many = np.flatnonzero(~alone).tolist()
    if not many:
        return masks
    words = Words([strings[k] for k in many])
    h = grams(words.hashes(), window)
    n = np.array([sizes[k] for k in many])
    owner = np.repeat(np.arange(len(many)), n)
    bit = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    place = words.first[owner] + bit
    h = mixed(h[place] ^ groups[np.array(many)][owner].view(np.uint64) * MIX[2])
    by = np.argsort(h, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], h[by][1:] != h[by][:-1], [True]]))
    for a in np.flatnonzero(np.diff(edges) > 1).tolist():
        mine = by[edges[a] : edges[a + 1]].tolist()
        texts: dict[bytes, list[int]] = {}
        for x in mine:
            texts.setdefault(words.part(int(place[x]), window), []).append(x)
        for equal in texts.values():
            if len(equal) > 1:
                for x in equal:
                    masks[many[owner[x]]] |= 1 << int(bit[x])
    return masks


def _repeats(docs: DataFrame, bitmaps: Broadcast, window: int, minimiser: int, bits: int, buffer: int = 48_000_000) -> DataFrame:
    """(run, mask): the strings that hold windows which occur again, by digest, and which of their windows those are.

    A task counts equal strings in ``buffer`` bytes before it sends them, so one that occurs everywhere arrives about once a task.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, size = {}, 0

        def flushed() -> pa.RecordBatch:
            rows = list(known.items())
            columns = [pa.array([h for (h, _), _ in rows], pa.int64()), pa.array([s for (_, s), _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["h", "packed", "copies"])

        for batch in batches:
            for _, some in parts(batch.column(0).to_pylist()):
                words = Words(some)
                for text, at, n, h in travelling(words, bitmaps.value, window, minimiser, bits):
                    string = words.part(int(words.first[text]) + at, n + window - 1)
                    if (h, string) not in known:
                        known[h, string], size = 0, size + len(string) + 200
                    known[h, string] += 1
                if size > buffer:
                    yield flushed()
                    known, size = {}, 0
        yield flushed()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settled(rows: dict[tuple[int, bytes], int]) -> pa.RecordBatch:
            h, strings = np.array([h for h, _ in rows], dtype=np.int64), [s for _, s in rows]
            masks = repeated_in(h, strings, np.array(list(rows.values()), dtype=np.int64), window) if rows else []
            kept = [(xxhash.xxh128_digest(s), m) for s, m in zip(strings, masks, strict=True) if m]
            return pa.RecordBatch.from_arrays([pa.array([r for r, _ in kept], pa.binary()), pa.array([m for _, m in kept], pa.int64())], ["run", "mask"])

        rows: dict[tuple[int, bytes], int] = {}
        last = None
        for batch in batches:
            ready = len(rows) > 50_000
            for h, string, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ready and h != last:  # whole buckets only
                    yield settled(rows)
                    rows, ready = {}, False
                last = h
                rows[h, string] = rows.get((h, string), 0) + copies
        yield settled(rows)

    sent = docs.select("text").mapInArrow(send, "h long, packed binary, copies long")
    return sent.repartition("h").sortWithinPartitions("h").mapInArrow(count, "run binary, mask long")


def _places(docs: DataFrame, bitmaps: Broadcast, window: int, minimiser: int, bits: int) -> DataFrame:
    """(key, at, run): where in which text each travelling string begins. Equal texts are one."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # texts that this task has had
        for batch in batches:
            keys, ats, runs = [], [], []
            seen = set() if len(seen) > 500_000 else seen
            for _, every in parts(batch.column(0).to_pylist()):
                some = [t for t in every if t and (k := _key(t)) not in seen and not seen.add(k)]
                words, known = Words(some), {}
                for text, at, n, _ in travelling(words, bitmaps.value, window, minimiser, bits):
                    if text not in known:
                        known[text] = _key(some[text])
                    keys.append(known[text])
                    ats.append(at)
                    runs.append(xxhash.xxh128_digest(words.part(int(words.first[text]) + at, n + window - 1)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ats, pa.int32()), pa.array(runs, pa.binary())], ["key", "at", "run"])

    return docs.select("text").mapInArrow(make, "key binary, at int, run binary")


def _kept(words: Words, marks: list[dict] | None, window: int) -> tuple[int, int, str]:
    """(n_words, n_removed, kept text) of a text whose windows at ``marks`` (at, mask) repeat."""
    n, change = len(words), np.zeros(len(words) + 1, dtype=np.int64)
    for mark in marks or []:
        bits = np.flatnonzero([(mark["mask"] >> k) & 1 for k in range(mark["mask"].bit_length())]) + mark["at"]
        np.add.at(change, bits, 1)
        np.add.at(change, bits + window, -1)
    gone = np.cumsum(change)[:n] > 0
    if not gone.any():
        return n, 0, words.packed.decode("utf-8", "surrogatepass")
    kept = [words.packed[a:b] for a, b in zip(words.starts[~gone].tolist(), words.ends[~gone].tolist(), strict=True)]
    return n, int(gone.sum()), b" ".join(kept).decode("utf-8", "surrogatepass")


ADDED = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]


def deduplicated(docs: DataFrame, *, window: int = 35, minimiser: int = 8, bits: int = 26, hot: int = 4096, text: str = "text") -> DataFrame:
    """docs with ``n_words``, ``n_removed`` and ``kept_text``: the words that no repeated window covers, joined by one space."""
    with arrow_rows(docs.sparkSession, 2000):
        return _deduplicated(docs, window, _width(window, minimiser), bits, hot, text)


def _deduplicated(docs: DataFrame, window: int, minimiser: int, bits: int, hot: int, text: str) -> DataFrame:
    docs = docs.drop("n_words", "n_removed", "kept_text")
    texts = docs.select(F.col(text).alias("text"))
    bitmaps = docs.sparkSession.sparkContext.broadcast(_bitmaps(texts, window, minimiser, bits, hot))
    repeats = written(_repeats(texts, bitmaps, window, minimiser, bits), "repeats")
    found = _places(texts, bitmaps, window, minimiser, bits).join(repeats, "run")
    marks = found.groupBy("key").agg(F.collect_set(F.struct("at", "mask")).alias("marks"))
    marks = written(marks, "marks")
    shared = docs.sparkSession.sparkContext.broadcast(_marked(marks, bits))
    key, name = unused(docs, "key"), unused(docs, "marks")
    names = docs.columns
    plain = T.StructType([*docs.schema, *ADDED])

    def finished(batch: pa.RecordBatch, marks_of: list) -> pa.RecordBatch:
        rows = [_kept(Words([t.as_py()]), m, window) for t, m in zip(batch.column(text), marks_of, strict=True)]
        columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        added = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *added], [*names, "n_words", "n_removed", "kept_text"])

    def split(keys: list[bytes | None]) -> np.ndarray:
        """Which texts can have marks."""
        return held(shared.value, np.frombuffer(b"".join(k[:8] if k else bytes(8) for k in keys), dtype=">u8").astype(np.uint64), bits) & np.array([k is not None for k in keys], dtype=bool)

    def keys_of(batch: pa.RecordBatch) -> list[bytes | None]:
        return [_key(t) if t else None for t in batch.column(text).to_pylist()]

    def unmarked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.filter(pa.array(~split(keys_of(batch))))
            yield finished(part, [None] * part.num_rows)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = keys_of(batch)
            some = pa.array(split(keys))
            part = batch.filter(some)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.binary()).filter(some)], [*part.schema.names, key])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield finished(batch, batch.column(name).to_pylist())

    # Texts without marks are done where they are; the others are dealt to their marks.
    own = docs.mapInArrow(keyed, T.StructType([*docs.schema, T.StructField(key, T.BinaryType())]))
    theirs = own.join(marks.select(F.col("key").alias(key), F.col("marks").alias(name)), key, "left")
    return docs.mapInArrow(unmarked, plain).unionByName(theirs.mapInArrow(marked, plain))
