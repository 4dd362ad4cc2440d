"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

A benchmark item leaks into a document if an item-sized window of the document (shorter where the document ends) has a
weighted Jaccard similarity of at least ``threshold`` with it: shingles of ``shingle`` words (all words as one shingle if the
item has fewer), each weighted by how often it occurs. Texts are lower-cased and words split at ASCII white space.

1. Windows. Items of n words are compared with windows of n words, at every word of a document. A window can only pass if
   nearly all of its shingles are shingles of items of n words (8 of 9 at a threshold of 0.8), so these are counted first in
   a bitmap, and only windows with enough hits go on. Documents without a hit at every few words are done before that. This drops nothing: a bitmap says yes too often, never too seldom.
2. Fingerprints. Equal windows of all documents are one. The SimHash of a window is the bitwise majority of its words'
   64-bit hashes, each word as often as it stands there, whatever the order; bits are counted in four lanes of a long at once.
3. Candidates. Fingerprints are cut into ``blocks`` blocks. Two that differ in at most ``radius`` bits differ in at most
   radius // blocks bits of one block, and the index holds each block of an item with all flips of so many bits: so the
   join on (window length, block, bits) finds all items within the radius, and the Hamming distance filters the rest.
4. Check. Shingles of window and item are counted and their weighted similarity is computed exactly.

Of a window with a similarity of 0.8, at least 8 of 9 shingles are shared, so its words' counts have a cosine of about 0.9 with
the item's: its fingerprint differs in 9.2 bits of 64 on average with a standard deviation of 2.8. The radius of 19 is 3.5
of these away; what is missed was measured (README). Equal words in any order have distance 0.

Edge cases: null or empty texts and items never match and give no row. Repeated doc_ids and item_ids are matched
each and reported once with the best similarity, null ids too. Ties give the same similarity. Long texts and items take time in
proportion to their words. Other columns of either table are ignored by ``contaminated`` and kept by ``decontaminated``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.text import let, unused, words
from marlstone.plans.shared import written

#: Bits of the bitmap for each shingle of the items, and its largest size as a power of two (8 MB).
BITS_EACH, MOST_BITS = 64, 26
#: The bits of a shingle's hash from which its two places in the bitmap are taken.
PROBES = (0, 32)
#: A lane counts up to 32767 words; longer windows are counted in 32-bit lanes.
LANES = {16: 0x0001000100010001, 32: 0x0000000100000001}


def _hashed(text: Column) -> Column:
    return F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))


def _grams(hashes: Column, width: int) -> Column:
    """The hashes of an array's shingles of ``width`` word hashes, in order; none if it has fewer."""
    n = F.size(hashes)
    one = lambda x, i: F.xxhash64(x, *[F.get(hashes, i + k) for k in range(1, width)])
    return F.when(n >= width, F.transform(F.slice(hashes, 1, n - (width - 1)), one)).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: Column) -> Column:
    """The bitwise majority of an array of 64-bit hashes; a tie counts as 0."""

    def majority(bits: int) -> Column:
        lanes, mask = 64 // bits, F.lit(LANES[bits])
        shifts = range(bits)
        zero = F.struct(*[F.lit(0).cast("long").alias(f"s{k}") for k in shifts])
        add = lambda acc, h: F.struct(*[(acc[f"s{k}"] + F.shiftrightunsigned(h, k).bitwiseAND(mask)).alias(f"s{k}") for k in shifts])
        half = F.floor(F.size(hashes) / 2)
        one = (1 << bits) - 1

        def planes(acc: Column) -> Column:
            found = [F.when(F.shiftrightunsigned(acc[f"s{k}"], bits * j).bitwiseAND(F.lit(one)) > half, F.lit((1 << (bits * j + k)) - (1 << 64 if bits * j + k == 63 else 0))).otherwise(F.lit(0)) for k in shifts for j in range(lanes)]
            return reduce(Column.bitwiseOR, found)

        return F.aggregate(hashes, zero, add, planes)

    return F.when(F.size(hashes) < 1 << 15, majority(16)).otherwise(majority(32))


def _edges(blocks: int) -> list[tuple[int, int]]:
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def _part(fingerprint: Column, a: int, b: int) -> Column:
    return F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 64 else -1))


def block_keys(fingerprint: Column, n: Column, blocks: int, flips: int = 0) -> Column:
    """An array of hashes of (window length, block, its bits): one for each block and each change of at most ``flips`` of its bits."""

    def keys(i: int, a: int, b: int) -> Column:
        none = F.array(F.lit(0).cast("long"))
        masks = F.filter(F.sequence(F.lit(0).cast("long"), F.lit((1 << (b - a)) - 1)), lambda m: F.bit_count(m) <= flips) if flips else none
        return F.transform(masks, lambda m: F.xxhash64(n, F.lit(i), _part(fingerprint, a, b).bitwiseXOR(m)))

    return F.concat(*[keys(i, a, b) for i, (a, b) in enumerate(_edges(blocks))])


def _bitmap(known: DataFrame, count: int) -> tuple[DataFrame, int]:
    """A one-row table of the bitmap of shingles, as an array of longs, and its size as a power of two. At most 8 MB."""
    power = min(MOST_BITS, max(12, (BITS_EACH * max(1, count) - 1).bit_length()))
    place = F.explode(F.array(*[F.shiftrightunsigned("g", k).bitwiseAND(F.lit((1 << power) - 1)) for k in PROBES]))
    held = known.select(place.alias("place"))
    place = F.col("place")
    held = held.select(F.shiftright(place, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    held = held.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    every = known.sparkSession.range(1 << (power - 6)).join(held, F.col("id") == F.col("word"), "left")
    row = every.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("a"))
    return row.select(F.col("a.bits").alias("bits")), power


def _stride(least: int, threshold: float) -> int:
    """A step so that every window of ``least`` shingles or more that can pass holds a hit at a multiple of it."""
    missing = 1 - 2 * threshold / (1 + threshold)  # the largest share of a window's shingles that aren't the item's
    fits = lambda k: all(x // k > int(x * missing + 1e-9) for x in range(max(1, least), max(1, least) + 64 * k))
    return next((k for k in (8, 7, 6, 5, 4, 3, 2) if k * missing < 1 and fits(k)), 1)


def _starts(at: Column, total: Column, n: Column, width: int, threshold: float) -> Column:
    """The starts of n-word windows that hold enough of the shingle positions ``at`` (in order) of a document with ``total`` shingles.

    For each position, the windows whose first hit it is: those that also reach the hit which makes up the number, or, at the
    document's end, those that are short enough for the hits that are left.
    """
    m = n - (width - 1)
    share = threshold / (1 + threshold)
    need = F.ceil(2 * m * F.lit(share) - 1e-9).cast("int")
    between = lambda low, high: F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    def of(p: Column, j: Column) -> Column:
        after = F.coalesce(F.get(at, j - 1) + 1, F.lit(0))
        last = F.get(at, j + need - 1)
        full = F.when(last.isNotNull(), between(F.greatest(after, last - m + 1), F.least(p, total - m))).otherwise(F.array().cast("array<int>"))
        left = F.size(at) - j  # a window that begins at s ends short with total - s shingles
        shortest = F.ceil(m + total - left / F.lit(share) - 1e-9).cast("int")
        return F.concat(full, between(F.greatest(after, shortest, total - m + 1), p))

    return F.flatten(F.transform(at, of))


def _windows(doc: DataFrame, item: DataFrame, width: int, threshold: float) -> DataFrame:
    """(doc_id, n, part): the windows of n words that can pass, as word hashes."""
    mine = item.filter(F.col("width") == width)
    each = mine.select("n", F.explode("bag").alias("g"))
    known = each.select("g").union(each.select(F.xxhash64("g", "n"))).distinct()
    bitmap, power = _bitmap(known, known.count())
    lengths = mine.agg(F.sort_array(F.collect_set("n")).alias("lengths"))
    word = lambda g, k: F.shiftrightunsigned(g, k).bitwiseAND(F.lit((1 << (power - 6)) - 1)).cast("int")
    probe = lambda g, k: F.call_function("shiftright", F.get("bits", word(g, k + 6)), F.shiftrightunsigned(g, k).bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
    held = lambda g: probe(g, PROBES[0]) & probe(g, PROBES[1])
    step = _stride(math.ceil(threshold * (mine.agg(F.min("n")).first()[0] - width + 1) - 1e-9), threshold)

    def hits(grams: Column) -> Column:
        """The places of the shingles of items, and what they are."""
        return F.filter(F.transform(grams, lambda g, i: F.when(held(g), F.struct(i.alias("i"), g.alias("g")))), lambda h: h.isNotNull())

    def found(hashes: Column) -> Column:
        total = F.greatest(F.size(hashes) - (width - 1), F.lit(0))
        of = lambda at, n: F.transform(F.filter(at, lambda h: held(F.xxhash64(h["g"], n))), lambda h: h["i"])  # noqa: E731  those of items of n words
        cut = lambda starts, n: F.transform(starts, lambda s: F.struct(n.alias("n"), F.slice(hashes, s + 1, n).alias("part")))
        at_n = lambda at, n: let(of(at, n), lambda places: cut(_starts(places, total, n, width, threshold), n))
        starts = let(let(_grams(hashes, width), hits), lambda at: F.flatten(F.transform("lengths", lambda n: at_n(at, n))))
        some = F.exists(F.sequence(F.lit(0), total - 1, F.lit(step)), lambda i: held(F.xxhash64(*[F.get(hashes, i + k) for k in range(width)])))
        return F.when(total > 0, F.when(some, starts))

    df = doc.select("doc_id", "dt", bitmap.scalar().alias("bits"), lengths.scalar().alias("lengths"))
    return df.select("doc_id", F.explode(let(_hashed(F.col("dt")), found)).alias("w")).select("doc_id", "w.n", "w.part", F.lit(width).alias("width"))


def _counted(df: DataFrame, keys: list[str], hashes: str, width: str) -> DataFrame:
    """How often each shingle of an array of word hashes occurs, and how many there are."""
    shingle = lambda h, w: F.when(F.size(h) >= w, F.transform(F.sequence(F.lit(1), F.size(h) - w + 1), lambda i: F.xxhash64(F.slice(h, i, w))))
    return df.select(*keys, F.explode(shingle(F.col(hashes), F.col(width))).alias("g")).groupBy(*keys, "g").agg(F.count("*").alias("c"))


def contaminated(
    docs: DataFrame, items: DataFrame, *, shingle: int = 5, threshold: float = 0.8, radius: int = 19, blocks: int = 5,
    broadcast_rows: int = 500_000, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, similarity) for each pair of document and item that leaks, with its best window.

    The items' index is broadcast only up to ``broadcast_rows`` rows, as counted; beyond that both sides are shuffled.
    """
    spark = docs.sparkSession
    doc = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("dt"))
    item = items.select(F.col(item_id).alias("item_id"), _hashed(F.col(item_text)).alias("ih")).filter(F.size("ih") > 0)
    item = written(item.distinct().withColumns({"k": F.xxhash64("item_id", "ih"), "n": F.size("ih"), "width": F.least(F.size("ih"), F.lit(shingle))}), "words")
    widths = sorted(r[0] for r in item.select("width").distinct().collect())  # at most ``shingle`` of them
    if not widths:
        kinds = {f.name: f.dataType for f in [*doc.schema, *item.schema]}
        return spark.createDataFrame([], "similarity double").select(
            F.lit(None).cast(kinds["doc_id"]).alias("doc_id"), F.lit(None).cast(kinds["item_id"]).alias("item_id"), "similarity"
        )
    bags = [item.filter(F.col("width") == w).withColumn("bag", _grams(F.col("ih"), w)) for w in widths]
    item = written(reduce(DataFrame.unionByName, bags), "items")
    rows = reduce(DataFrame.unionByName, [_windows(doc, item, w, threshold) for w in widths])
    # 128 bits stand for a window.
    keys = ["n", "k1", "k2"]
    rows = written(rows.select("doc_id", "n", "width", "part", F.xxhash64("part").alias("k1"), F.xxhash64("part", F.lit(1)).alias("k2")).distinct(), "windows")
    window = written(rows.groupBy(*keys).agg(F.first("part").alias("part"), F.first("width").alias("width")).withColumn("f", simhash(F.col("part"))), "fingerprints")
    prints = written(item.select("k", "n", simhash(F.col("ih")).alias("g")), "prints")
    index = prints.select("k", "g", F.explode(block_keys(F.col("g"), F.col("n"), blocks, radius // blocks)).alias("block"))
    index = written(index, "index")
    index = F.broadcast(index) if index.count() <= broadcast_rows else index
    near = window.select(*keys, "f", F.explode(block_keys(F.col("f"), F.col("n"), blocks)).alias("block")).join(index, "block")
    near = written(near.filter(F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= radius).select(*keys, "k").distinct(), "candidates")
    # The exact check: the sum over shingles of the smaller count, over that of the larger.
    theirs = _counted(item, ["k"], "ih", "width").withColumnRenamed("c", "c2")
    shared = near.join(_counted(window, keys, "part", "width"), keys).join(theirs, ["k", "g"]).groupBy(*keys, "k").agg(F.sum(F.least("c", "c2")).alias("both"))
    sizes = window.select(*keys, F.greatest(F.size("part") - F.col("width") + 1, F.lit(0)).alias("m1"))
    shared = shared.join(sizes, keys).join(item.select("k", "item_id", F.size("bag").alias("m2")), "k")
    shared = shared.withColumn("similarity", F.col("both") / (F.col("m1") + F.col("m2") - F.col("both"))).filter(F.col("similarity") >= threshold)
    leaks = written(shared.select(*keys, "item_id", "similarity"), "leaks")
    return rows.select("doc_id", *keys).join(leaks, keys).groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


def decontaminated(docs: DataFrame, items: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The documents into which no item leaks, with all their columns. Rows are told apart by their texts, whatever their ids."""
    key = docs.select(F.md5(F.col(text)).alias("k"), F.col(text).alias("text"))
    leak = unused(docs, "leak")
    leaks = contaminated(key, items, doc_id="k", text="text", **options).select(F.col("doc_id").alias(leak)).distinct()
    return docs.join(leaks, F.md5(docs[text]) == leaks[leak], "left_anti")
