"""Exact Jaccard self-join of documents' word shingles, as a join in a metric space.

Jaccard distance d = 1 - |x and y| / |x or y| is a metric, so what is far from a pivot on one side and near it on the other
can't be close. Two documents link when 100 * |x and y| >= percent * |x or y|; eps is the largest distance of a link.

1. Copies. Documents with the same shingle set are one point, the smallest id; a group of copies costs one row a copy.
2. Zones. Nearly all documents of a corpus are at a distance of about 1 from each other, and from any pivots chosen among them, so windows
   of 2 eps around document pivots of the whole corpus would hold everything. Pivots of one shingle come first: against {t} a set has distance
   1 - 1/|x| if it holds t and 1 otherwise, so its nearest pivots are its own shingles; pivots are ordered, those that occur least first. If two
   sets link, the first k shingles that both have are among the first |x| - ceil(percent/100 |x|) + k of each: that is a set's window.
   Sets whose windows meet k times (``MEET``; fewer where a link needs fewer) at places that leave enough for a link, directly or through others, are a zone; no link leaves a zone.
   Unlike texts meet once by chance, the more of them the more often, and would chain ever larger zones; they hardly meet k times.
3. Voronoi regions. Within a zone, pivots are its own sets. Each set goes to its nearest pivot's region and, as far as the triangle inequality asks, to
   those of pivots at most 2 eps further away; sets within eps of a pivot link to it. Regions are split again in the same
   way until each holds one component. A region that doesn't shrink is one of sets about equally far from each other: there each set is a pivot
   in its turn. Sets of one component aren't compared again, so near copies of a text cost a row each, not one for each pair.
4. A zone of up to ``room`` shingles is joined so in one task (zones are dealt to tasks, sets read as a stream). A larger one is cut into Voronoi regions
   in the same way, but with tables: distances to ``pivots`` pivots a region, ``rounds`` rounds at most, each region within ``room`` going on as in step 3.
   What doesn't shrink is cut by the shingles of its windows (step 2) and goes through the rounds again, and what is too large even then is joined in pairs of blocks of half the room.
Links are decided on whole shingle sets (64-bit hashes of the words). All steps are exact; the counts behind the order of shingles come from a sketch of
fixed size over all documents, and any order gives the same result.

Edge cases: null or wordless texts have an empty set, link with nothing and are their own component; a text of fewer words than
a shingle is one shingle; a row without doc_id gets the component of its equals, null if they have no id; rows that share an id are
one document with several texts; very long texts are one row of their zone, alone beyond ``room`` if need be; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.components import components
from marlstone.llm.hashing import Words, bitmap, grams, held, mixed, parts
from marlstone.plans.shared import arrow_rows, cut, written

SKETCH_BITS = 22  # 16 MB of counts; a bucket then has 25 shingles or so for each 100 million
BITS = 26  # 8 MB each for which window shingles several sets have, and which ids have a zone: they say yes too often at most
MEET = 3  # the shingles that windows of linked sets share at least
SET = 512  # what a set counts besides its shingles, so that many small ones don't share a task either
_UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_NONE = np.empty(0, dtype=np.int64)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles."""
    out: list[np.ndarray] = []
    for _, some in parts(texts):
        words = Words([t.encode("utf-8", "surrogatepass").translate(_UPPER) if t else None for t in some])
        h = words.hashes() if len(words) else np.empty(0, dtype=np.uint64)
        g = grams(h, width) if len(h) >= width else h
        for low, high in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            n = high - low
            own = g[low : high - width + 1] if n >= width else mixed(grams(h[low:high], n) + np.uint64(n)) if n else h[:0]
            out.append(np.unique(own.view(np.int64)))
    return out


def _bucket(sets: np.ndarray) -> np.ndarray:
    return (sets.view(np.uint64) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _sketch(docs: DataFrame, width: int) -> np.ndarray:
    """How many shingles of all documents fall to each of 2 ** SKETCH_BITS buckets: of one size, whatever the input."""
    step = 1 << 16

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << SKETCH_BITS, dtype=np.int32)
        for batch in batches:
            for grams_ in shingle_sets(batch["text"].tolist(), width):
                places, counts = np.unique(_bucket(grams_), return_counts=True)
                total[places] += counts.astype(np.int32)
        yield pd.DataFrame({"part": range(0, len(total), step), "counts": [zlib.compress(total[i : i + step].tobytes(), 1) for i in range(0, len(total), step)]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(step, dtype=np.int64)
        for c in rows["counts"]:
            total += np.frombuffer(zlib.decompress(c), dtype=np.int32)
        return pd.DataFrame({"part": rows["part"][:1], "counts": [zlib.compress(np.minimum(total, 2**31 - 1).astype(np.int32).tobytes(), 1)]})

    schema = "part long, counts binary"
    rows = docs.select("text").mapInPandas(count, schema).groupBy("part").applyInPandas(add, schema).orderBy("part").collect()
    return np.concatenate([np.frombuffer(zlib.decompress(r["counts"]), dtype=np.int32) for r in rows]) if rows else np.zeros(1 << SKETCH_BITS, dtype=np.int32)


def _points(docs: DataFrame, width: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """(doc_id, n_shingles, same, window): set size, 128-bit hash of the set, and the shingles of its window in order."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), width)
            first = [x[np.argsort(shared.value[_bucket(x)], kind="stable")[: len(x) - -(-percent * len(x) // 100) + MEET]] if len(x) else _NONE for x in sets]
            same = [xxhash.xxh128_digest(x.tobytes()) if len(x) else None for x in sets]
            windows = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, first)]), pa.int32()), pa.array(np.concatenate([_NONE, *first])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(same, pa.binary()), windows], ["doc_id", "n_shingles", "same", "window"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(make, f"doc_id {kind}, n_shingles long, same binary, window array<long>")


def _met(points: DataFrame, copies: DataFrame) -> DataFrame:
    """(t, x): the shingles of each set's window that other windows have too, x with its id, its size n and the shingle's position p. Which those are is counted over all windows; only they are dealt out.

    Windows stay where they are: a bitmap tells the points that stand for their copies. A few others pass as well; what they meet is met by the point of their set, too.
    Bits are those of the shingles' hashes mixed again, as windows are of few buckets of the sketch, which are upper bits.
    """
    sc = points.sparkSession.sparkContext
    first = sc.broadcast(bitmap(copies.select(F.xxhash64("same", "id").alias("h")), {"some": F.lit(True)}, BITS)[0])
    named = points.filter("same is not null and doc_id is not null").select("doc_id", F.col("n_shingles").cast("int").alias("n"), "window", F.xxhash64("same", "doc_id").alias("h"))

    def ours(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(held(first.value, batch.column(3).to_numpy().view(np.uint64), BITS)))

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(mixed(ours(batch).column(2).flatten().to_numpy().view(np.uint64)).view(np.int64))], ["h"])

    # Nearly all are there once: dealt out first, they need no map of counts on either side.
    often = named.mapInArrow(every, "h long").repartition("h").groupBy("h").count().filter("count > 1")
    shared = sc.broadcast(bitmap(often, {"some": F.lit(True)}, BITS)[0])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(ours, batches):
            lists = batch.column(2)
            t, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            keep = held(shared.value, mixed(t.view(np.uint64)), BITS)
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            place = np.arange(len(t)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            at = pa.array(owner[keep])
            yield pa.RecordBatch.from_arrays([pa.array(t[keep]), batch.column(0).take(at), batch.column(1).take(at), pa.array(place[keep].astype(np.int32))], ["t", "id", "n", "p"])

    kind = points.schema["doc_id"].dataType.simpleString()
    return named.mapInArrow(make, f"t long, id {kind}, n int, p int").select("t", F.struct("id", "n", "p").alias("x"))


def _possible(x: Column, y: Column, percent: int) -> Column:
    """Whether sizes, and the positions p of a shingle that is one of the first ``MEET`` shared ones of both windows, leave enough for a link."""
    rest = F.least(x["n"] - x["p"], y["n"] - y["p"]) + MEET - 1
    return (100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"])) & ((100 + percent) * rest >= percent * (x["n"] + y["n"]))


def _class(n: Column, percent: int) -> Column:
    """The size class; linked sizes differ by one class at most."""
    return F.floor(F.log(n.cast("double")) / -math.log(percent / 100) + 1e-9)


def _zones(rows: DataFrame, percent: int, leaf: int) -> DataFrame:
    """(id, component): sets that can be linked, directly or through others. Where up to ``leaf`` sets have a window shingle, two of them meet if their sizes and its positions allow a link,
    and belong together if they meet ``MEET`` times, or as often as a link of small sets needs. Where more have it, this goes by size class (a set counts for its own class and the next, and two sets meet
    in the class of the larger one); where more than ``leaf`` of about one size have it, all of them belong together."""
    size = rows.groupBy("t").agg(F.count("*").alias("size")).filter("size > 1")
    mine = written(rows.join(size, "t"), "regions")

    def meetings(groups: DataFrame, where: Callable[[Column, Column], Column]) -> DataFrame:
        pair = F.flatten(F.transform("xs", lambda x, i: F.transform(F.slice("xs", i + 2, leaf), lambda y: F.struct(x.alias("x"), y.alias("y")))))
        q = groups.withColumn("q", F.explode(pair)).filter(_possible(F.col("q.x"), F.col("q.y"), percent) & where(F.col("q.x"), F.col("q.y")))
        need = F.least(F.lit(MEET), F.ceil(percent * F.greatest("q.x.n", "q.y.n") / 100))
        return q.select(F.col("q.x.id").alias("a"), F.col("q.y.id").alias("b"), need.cast("int").alias("need"))

    grouped = F.sort_array(F.collect_list("x")).alias("xs")
    few = meetings(mine.filter(F.col("size") <= leaf).groupBy("t").agg(grouped), lambda x, y: F.lit(True))
    class_ = _class(F.col("x.n"), percent)
    many = written(mine.filter(F.col("size") > leaf).select("t", "x", F.explode(F.array(class_, class_ + 1)).alias("c")), "crowds")
    crowd = many.groupBy("t", "c").agg(F.count("*").alias("size"), F.min("x.id").alias("low"))
    many = written(many.join(crowd, ["t", "c"]), "crowds")
    part = many.filter(F.col("size").between(2, leaf)).groupBy("t", "c").agg(grouped)
    few = few.unionByName(meetings(part, lambda x, y: F.col("c") == _class(F.greatest(x["n"], y["n"]), percent)))
    few = few.filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("met"), F.min("need").alias("need")).filter("met >= need").select("a", "b")
    many = many.filter(F.col("size") > leaf).select(F.col("low").alias("a"), F.col("x.id").alias("b"))
    return components(few.unionByName(many.filter("a <> b").distinct()))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (id, same, ...) with ``text``: texts of ids that a bitmap of the wanted ones doesn't have stay where they are. A repeated id brings all its texts."""
    marks = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64("id").alias("h")), {"some": F.lit(True)}, BITS)[0])

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.filter(pa.array(held(marks.value, batch.column(2).to_numpy().view(np.uint64), BITS)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["id", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    mine = docs.filter("doc_id is not null and text is not null").select("doc_id", "text", F.xxhash64("doc_id").alias("h")).mapInArrow(some, f"id {kind}, text string")
    return wanted.join(mine, "id")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(id, grams): the sets of texts (id, same, text), as bytes, each once."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x.tobytes() for x in shingle_sets(batch.column(2).to_pylist(), width)]
            mine = pa.array([bool(x) and xxhash.xxh128_digest(x) == same for x, same in zip(sets, batch.column(1).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mine), pa.array(sets, pa.binary()).filter(mine)], ["id", "grams"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "same", "text").mapInArrow(make, f"id {kind}, grams binary").distinct()


def voronoi(sets: list[np.ndarray], percent: int, pivots: int = 8, least: int = 3) -> tuple[list[int], dict[str, int]]:
    """The component of each set (its smallest member), and what was done: regions, distances, links found at pivots, and those of regions that don't shrink.

    ``least``: a region of so few sets has each as a pivot, as no cell could be smaller.
    """
    eps = 1 - percent / 100
    parent = list(range(len(sets)))
    did = dict.fromkeys(("regions", "distances", "pivot_links", "other_links"), 0)
    sizes = np.array([len(s) for s in sets])

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    def distances(a: int, others: np.ndarray, how: str) -> np.ndarray:
        """d(a, each of others); whatever is within eps is linked."""
        whole = np.concatenate([sets[k] for k in others])
        place = np.minimum(np.searchsorted(sets[a], whole), len(sets[a]) - 1)
        starts = np.concatenate([[0], np.cumsum(sizes[others])[:-1]])
        both = np.add.reduceat((sets[a][place] == whole).astype(np.int64), starts)
        union = sizes[a] + sizes[others] - both
        did["distances"] += len(others)
        for k in others[100 * both >= percent * union].tolist():
            x, y = find(a), find(k)
            if x != y:
                parent[max(x, y)] = min(x, y)
                did[how] += 1
        return 1 - both / union

    todo = [np.arange(len(sets))]
    while todo:
        region = todo.pop()
        roots = np.array([find(k) for k in region.tolist()])
        if len(region) < 2 or (roots == roots[0]).all():
            continue
        did["regions"] += 1
        # Pivots of different components, spread over the region.
        _, firsts = np.unique(roots, return_index=True)
        chosen = region[firsts[:: -(-len(firsts) // pivots)][:pivots]]
        if len(region) > least:
            d = np.stack([distances(int(p), region, "pivot_links") for p in chosen])
            near = d <= d.min(axis=0) + 2 * eps + 1e-9
            cells = [region[row] for row in near]
            if 4 * sum(len(c) ** 2 for c in cells) <= 3 * len(region) ** 2 and max(map(len, cells)) < len(region):  # fewer pairs are left than there were
                todo += cells
                continue
        # Each set as a pivot in its turn, against those of other components of a size that allows a link.
        for i, a in enumerate(region.tolist()):
            rest = region[i + 1 :]
            rest = rest[(100 * np.minimum(sizes[rest], sizes[a]) >= percent * np.maximum(sizes[rest], sizes[a])) & (np.array([find(k) for k in rest.tolist()], dtype=np.int64) != find(a))]
            if len(rest):
                distances(a, rest, "pivot_links" if len(region) <= least else "other_links")
    return [find(k) for k in range(len(sets))], did


def _joined_regions(rows: DataFrame, percent: int, width: int = 0) -> DataFrame:
    """(id, component) of rows (r, id, grams), or (r, id, same, text) with a ``width``: each region r joined by Voronoi regions of its own sets. Regions are read one after the other."""
    kind = rows.schema["id"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, ids, sets = None, [], []

        def done() -> list[tuple]:
            if len(ids) < 2:
                return []
            roots, _ = voronoi(sets, percent)
            least: dict[int, object] = {}
            for i, root in zip(ids, roots, strict=True):
                least[root] = min(i, least[root]) if root in least else i
            return [(i, least[root]) for i, root in zip(ids, roots, strict=True)]

        def given(out: list[tuple], type_: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], type_), pa.array([x for _, x in out], type_)], ["id", "component"])

        type_ = None
        for batch in batches:
            type_, out = batch.schema.field("id").type, []
            rs, names = batch.column("r").to_pylist(), batch.column("id").to_pylist()
            if width:
                mine = shingle_sets(batch.column("text").to_pylist(), width)
                fits = [len(x) > 0 and xxhash.xxh128_digest(x.tobytes()) == same for x, same in zip(mine, batch.column("same").to_pylist(), strict=True)]
            else:
                mine, fits = [np.frombuffer(g, dtype=np.int64) for g in batch.column("grams").to_pylist()], [True] * len(rs)
            for r, i, x, fit in zip(rs, names, mine, fits, strict=True):
                if r != region:
                    out += done()
                    region, ids, sets = r, [], []
                if fit:
                    ids.append(i)
                    sets.append(x)
            yield given(out, type_)
        if type_ is not None:
            yield given(done(), type_)

    columns = ["r", "id", "same", "text"] if width else ["r", "id", "grams"]
    return rows.select(*columns).repartition("r").sortWithinPartitions("r").mapInArrow(make, f"id {kind}, component {kind}")


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _distances(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, both, n_a, n_b) for distinct pairs of ids: the sizes of both sets and of what they share."""
    pairs = written(pairs.filter("a <> b").distinct(), "pairs")
    out = pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("grams").alias("y")), "b")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = lambda c, batch=batch: [np.frombuffer(g, dtype=np.int64) for g in batch.column(c).to_pylist()]
            xs, ys = read("x"), read("y")
            both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(xs, ys, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(both, pa.int64()), pa.array([len(x) for x in xs], pa.int64()), pa.array([len(y) for y in ys], pa.int64())], ["a", "b", "both", "n_a", "n_b"])

    kind = sets.schema["id"].dataType.simpleString()
    return out.select("a", "b", "x", "y").mapInArrow(make, f"a {kind}, b {kind}, both long, n_a long, n_b long")


def _link(percent: int) -> Column:
    return 100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (id, component) with new links taken in: only links between different components are gone through again."""
    for end in ("a", "b"):
        mine = labels.select(F.col("id").alias(end), F.col("component").alias(f"c_{end}"))
        links = links.join(mine, end, "left").withColumn(f"c_{end}", F.coalesce(f"c_{end}", end))
    apart = written(links.filter("c_a <> c_b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).distinct(), "apart")
    if apart.isEmpty():
        return labels
    later = components(apart).select(F.col("id").alias("component"), F.col("component").alias("whole"))
    known = labels.join(later, "component", "left").select("id", F.coalesce("whole", "component").alias("component"))
    fresh = later.select(F.col("component").alias("id"), F.col("whole").alias("component")).join(labels.select("id"), "id", "left_anti")
    return written(known.unionByName(fresh), "labels")


def joined(docs: DataFrame, *, width: int = 4, percent: int = 85, room: int = 1 << 21, leaf: int = 16, pivots: int = 6, rounds: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each document; the component is the smallest doc_id reachable by links. ``room``: the shingles that a task holds at once (a set counts ``SET`` more)."""
    with arrow_rows(docs.sparkSession, 1000):  # all but the last, small joins run in here
        return _joined(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), width, percent, room, leaf, pivots, rounds)


def _joined(docs: DataFrame, width: int, percent: int, room: int, leaf: int, pivots: int, rounds: int) -> DataFrame:
    points = written(_points(docs, width, percent, _sketch(docs, width)), "points")
    copies = points.filter("same is not null and doc_id is not null").groupBy("same").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"))
    copies = written(copies, "copies")
    # 2. The windows of one point for each set; sets whose windows meet are a zone.
    rows = written(_met(points, copies), "windows")
    zones = _zones(rows, percent, leaf)
    sized = zones.join(copies.select("id", "n"), "id").groupBy(F.col("component").alias("zone")).agg(F.sum(F.col("n") + SET).alias("size"))
    wanted = zones.join(copies.select("id", "same"), "id").join(sized.withColumnRenamed("zone", "component"), "component").select("id", "same", F.col("component").alias("zone"), "size")
    wanted = written(wanted, "wanted")
    # 3. Zones that a task can hold. An id with several sets is named once a set: its labels are merged below.
    small = _texts(docs, wanted.filter(F.col("size") <= room)).withColumnRenamed("zone", "r")
    found = _joined_regions(small, percent, width)
    found = written(found.groupBy("id").agg(F.min("component").alias("component"), F.max("component").alias("other")), "found")
    labels = found.select("id", "component")
    # 4. Larger ones, as tables: by Voronoi regions, then what doesn't shrink by the shingles of its windows.
    large = wanted.filter(F.col("size") > room)
    if not large.isEmpty():
        sets = written(_sets(_texts(docs, large), width), "sets")
        crowd = large.join(sets.select("id"), "id", "left_semi").select(F.xxhash64("zone").alias("r"), "id", F.lit(False).alias("stuck")).distinct()
        labels, left = _split(sets, crowd, labels, percent=percent, room=room, pivots=pivots, rounds=rounds, last=False)
        if not left.isEmpty():
            crowd = rows.select("t", F.col("x.id").alias("id")).join(left.distinct(), "id", "left_semi").select(F.xxhash64("t").alias("r"), "id", F.lit(False).alias("stuck")).distinct()
            labels, _ = _split(sets, crowd, labels, percent=percent, room=room, pivots=pivots, rounds=rounds, last=True)
    # Rows of one id with different sets make these sets' points one document.
    many = points.filter("same is not null").groupBy("doc_id").agg(F.min("same").alias("s1"), F.max("same").alias("s2")).filter("s1 <> s2").select("doc_id")
    alike = points.join(many, "doc_id").join(copies, "same").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    alike = alike.unionByName(found.select(F.col("component").alias("a"), F.col("other").alias("b")))
    labels = _merged(labels, alike.filter("a <> b"))
    whole = points.select("doc_id", "n_shingles", "same").join(copies.select("same", F.col("id").alias("point")), "same", "left")
    whole = whole.join(labels.withColumnRenamed("id", "point"), "point", "left")
    own = F.coalesce("component", "point", "doc_id")
    return whole.select("doc_id", "n_shingles", own.alias("component_id"))


def _open_regions(sets: DataFrame, crowd: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the regions that still hold more than one component, with their components and the region's number of shingles."""
    crowd = crowd.select("r", "id", "stuck").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    crowd = crowd.join(sets.select("id", ((F.length("grams") / 8).cast("long") + SET).alias("n")), "id")
    held = crowd.groupBy("r").agg(F.sum("n").alias("size"), F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 <> c2").select("r", "size")
    return written(crowd.join(held, "r"), "crowd")


def _split(sets: DataFrame, crowd: DataFrame, labels: DataFrame, *, percent: int, room: int, pivots: int, rounds: int, last: bool) -> tuple[DataFrame, DataFrame]:
    """The labels with the links found in large regions taken in, and the ids (id) of regions that are left: too large and not shrinking. With ``last`` none is left:
    these are joined in pairs of blocks of half the room. sets: (id, grams); crowd: (r, id, stuck)."""
    eps = 1 - percent / 100
    none = sets.select("id").limit(0)
    left = none
    for step in range(rounds + 1):
        crowd = _open_regions(sets, crowd, labels)
        if crowd.isEmpty():
            return labels, left
        # Regions with room in a task go there.
        fits = F.col("size") <= room
        if not last:
            left = left.unionByName(crowd.filter(~fits & (F.col("stuck") | F.lit(step == rounds))).select("id"))
        done = crowd if step == rounds else crowd.filter(fits | F.col("stuck"))
        done = done if last else done.filter(fits)
        blocks = F.greatest(F.lit(1), F.ceil(2 * F.col("size") / room)).cast("int")
        blocks = F.when(F.col("size") <= room, 1).otherwise(blocks)
        spread = done.withColumn("i", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), blocks - 1)))
        spread = spread.select(F.xxhash64("r", F.least("i", "j"), F.greatest("i", "j")).alias("r"), "id").distinct()
        inside = _joined_regions(spread.join(sets, "id"), percent).select(*_ordered(F.col("id"), F.col("component")))
        if step == rounds:
            return _merged(labels, cut(inside.filter("a <> b"))), left
        # Pivots: sets of different components where there are some, by hash; a fixed number for each region.
        crowd = crowd.filter((F.col("size") > room) & ~F.col("stuck"))
        slot = F.pmod(F.xxhash64("component", F.lit(step)), F.lit(pivots))
        chosen = crowd.groupBy("r", slot.alias("slot")).agg(F.min(F.struct(F.xxhash64("id", F.lit(step)).alias("h"), "id")).alias("c"))
        against = crowd.join(chosen.select("r", F.col("c.id").alias("pivot")), "r")
        dist = cut(_distances(sets, against.select(*_ordered(F.col("id"), F.col("pivot")))))
        labels = _merged(labels, cut(dist.filter(_link(percent)).select("a", "b").unionByName(inside.filter("a <> b"))))
        d = dist.select("a", "b", (1 - F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))).alias("d"))
        d = d.union(d.select("b", "a", "d")).select(F.col("a").alias("id"), F.col("b").alias("pivot"), "d")
        known = against.join(d, ["id", "pivot"], "left").withColumn("d", F.when(F.col("id") == F.col("pivot"), 0.0).otherwise(F.coalesce("d", F.lit(1.0))))
        at = known.groupBy("r", "id").agg(F.collect_list(F.struct("d", "pivot")).alias("ds")).withColumn("least", F.array_min("ds"))  # one for each pivot
        at = cut(at.withColumn("near", F.filter("ds", lambda s: s["d"] <= F.col("least.d") + 2 * eps + 1e-9)))
        # Where cells would hold more than twice the region's sets, its sets are too alike in distance: it goes on as it is.
        stuck = at.groupBy(F.col("r").alias("its")).agg((F.sum(F.size("near")) > 2 * F.count("*")).alias("stuck"))
        at = at.join(stuck, F.col("r") == F.col("its")).withColumn("s", F.explode(F.when(F.col("stuck"), F.slice("near", 1, 1)).otherwise(F.col("near"))))
        crowd = at.select(F.when(F.col("stuck"), F.col("r")).otherwise(F.xxhash64("r", "s.pivot")).alias("r"), "id", "stuck")
    return labels, left
