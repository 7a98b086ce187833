"""N-gram Jaccard self-join of documents: a size-aware heavy-light join.

The set of a document is its distinct five-word shingles (see shingles.py). Documents link
when 100 * |A & B| >= 75 * |A | B|. With that threshold a partner of a set of n shingles
shares at least c = ceil(0.75 n) of them, so among the first n - c + k shingles in any
common order both sets have k in common.

* Light sets (n at most a boundary) enumerate the subsets of fixed size two of their first
  n - c + 2 shingles; two light sets that link share a subset.
* Heavy sets scan inverted lists: an entry for each of the first n - c + k shingles, with k half
  of n - c + 1. Light sets large enough to link with a heavy set are entered in these lists as well.
* The boundary is the one of least cost, from the measured sizes of the sets and of the
  inverted lists of short texts.

The common order is by hash, with hot shingles last: a sketch of fixed size tells which shingles
stand out of the mean load of its counters. The scan of the lists counts each shingle exactly.
Entries of one set alone vanish there, and a set with fewer than k shared entries links with
nothing and vanishes too; of the others' m shared entries, the m - k + 1 rarest are kept, for
two sets that link have one of these in common. Equal sets are one class from the start, so
copies of a document are never paired. blocks.py makes pairs of what is left, and all pairs are
verified exactly.

Defined results: null and empty texts, and texts of spaces only, have 0 shingles and are their
own component. Repeated rows are one row each in the result, in the same class. An empty table
gives an empty table. Extra columns are ignored. Sets are compared by 64-bit hashes of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .blocks import class_sets, link_classes, shared_keys
from .idfilter import semi_join
from .shingles import mix, set_id, shingle_sets

#: Counters of the frequency sketch: 4 MB, whatever the input.
LOG2_COUNTERS = 20
CHUNK = 1 << 12
#: Sets of more shingles than this are never light; it bounds the subsets of one set.
MOST_LIGHT = 24
#: A shingle is hot where its counter has so many times the mean load; it is dealt in pieces of half of that.
HOT = 8
#: Sets that a task remembers, so that copies of a document are entered once, before it starts anew.
REMEMBERED = 200_000
PERCENT = 75


def least_overlap(n: int) -> int:
    """The fewest shingles that a set of n shares with a set that it links with."""
    return -(-PERCENT * n // 100)


def _counter(values: np.ndarray) -> np.ndarray:
    return (mix(values) >> np.uint64(64 - LOG2_COUNTERS)).astype(np.int64)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, then the task's frequencies in chunks."""
    counts = np.zeros(1 << LOG2_COUNTERS, dtype=np.int64)
    for batch in batches:
        ids, sizes, seen, many = [], [], [], 0
        for _, values in shingle_sets(batch.column("text")):
            ids.append(set_id(values))
            sizes.append(len(values))
            seen.append(values)
            many += len(values)
            if many > 1 << 18:
                counts += np.bincount(_counter(np.concatenate(seen)), minlength=len(counts))
                seen, many = [], 0
        if many:
            counts += np.bincount(_counter(np.concatenate(seen)), minlength=len(counts))
        n = len(ids)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
            ["doc_id", "class", "n_shingles", "chunk", "counts"],
        )
    parts = [(k, counts[k * CHUNK : (k + 1) * CHUNK]) for k in range(len(counts) // CHUNK)]
    parts = [(k, p.astype(np.int64).tobytes()) for k, p in parts if p.any()]
    n = len(parts)
    yield pa.RecordBatch.from_arrays(
        [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([k for k, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())],
        ["doc_id", "class", "n_shingles", "chunk", "counts"],
    )


def profile(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, class, n_shingles) of every document, and the frequency sketch by chunk and task."""
    table = scratch.save(
        docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
            _profile, "doc_id bigint, class bigint, n_shingles bigint, chunk int, counts binary"
        ),
        "profile",
    )
    return (
        table.filter("chunk is null").select("doc_id", "class", "n_shingles"),
        table.filter("chunk is not null").select("chunk", "counts"),
    )


def _sum_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts"), strict=True):
            values = np.frombuffer(counts.as_buffer(), dtype=np.int64)
            if chunk in total:
                total[chunk] += values
            else:
                total[chunk] = values.copy()
    keys = sorted(total)
    # saturated, for the order of shingles needs no more
    packed = [np.minimum(total[k], (1 << 32) - 1).astype(np.uint32).tobytes() for k in keys]
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(packed, pa.binary())], ["chunk", "counts"])


def frequency_sketch(chunks: DataFrame) -> np.ndarray:
    """The summed sketch; 2**LOG2_COUNTERS counters of 32 bits reach the driver."""
    out = np.zeros(1 << LOG2_COUNTERS, dtype=np.uint32)
    summed = chunks.repartition("chunk").mapInArrow(_sum_chunks, "chunk int, counts binary")
    for chunk, counts in summed.collect():
        out[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(counts, dtype=np.uint32)
    return out


def light_rows(n: int) -> int:
    """Subset keys of a light set of n shingles."""
    p = n - least_overlap(n) + 2
    return p * (p - 1) // 2 if n >= 2 else 0


def choose_boundary(sizes: dict[int, tuple[int, float]]) -> int:
    """The size up to which sets are light, of least cost.

    sizes: for each size up to MOST_LIGHT the number of sets and the mean number of entries
    in the inverted list of one of their list keys. A list key costs itself and the entries it meets; a subset
    key costs itself. Light sets larger than 0.75 of the boundary pay for both.
    """

    def cost(boundary: int) -> float:
        total = 0.0
        for n, (many, met) in sizes.items():
            if n <= boundary:
                total += many * light_rows(n)
            if n * 100 > PERCENT * boundary:
                total += many * (n - least_overlap(n) + 1) * (1 + max(0.0, met - 1))
        return total

    return min(range(MOST_LIGHT + 1), key=lambda b: (cost(b), b))


def _short_costs(sketch) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        many, met = np.zeros(MOST_LIGHT + 1), np.zeros(MOST_LIGHT + 1)
        seen: set[int] = set()
        for batch in batches:
            for _, values in shingle_sets(batch.column("text")):
                n = len(values)
                if 2 <= n <= MOST_LIGHT and (key := set_id(values)) not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(key)
                    many[n] += 1
                    p = n - least_overlap(n) + 1
                    met[n] += np.sort(counts[_counter(values)])[:p].mean()
        sizes = np.flatnonzero(many)
        yield pa.RecordBatch.from_arrays(
            [pa.array(sizes, pa.int32()), pa.array(many[sizes], pa.float64()), pa.array(met[sizes], pa.float64())], ["n", "many", "met"]
        )

    return run


def boundary_of(docs: DataFrame, sketch) -> int:
    """The boundary for these documents; only texts of few words are read for it."""
    short = docs.select("text").filter(F.regexp_count("text", F.lit(r"[^ \t-\r]+")) <= 8 * MOST_LIGHT)
    rows = (
        short.mapInArrow(_short_costs(sketch), "n int, many double, met double")
        .groupBy("n").agg(F.sum("many").alias("many"), F.sum("met").alias("met")).collect()
    )
    return choose_boundary({r["n"]: (r["many"], r["met"] / r["many"]) for r in rows})


def more_entries(n: int) -> int:
    """k of a set of n shingles: half as many entries as it needs at least."""
    return max(1, (n - least_overlap(n) + 1) // 2)


def _keys(sketch, boundary: int, mean: int) -> object:
    """(key, class, place, hot) of each class; place is twice the set's size, and one more for subsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        seen: set[int] = set()

        def flush(keys, classes, places, hots):
            arrays = [pa.array(np.concatenate(keys).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (classes, places, hots))]
            return pa.RecordBatch.from_arrays(arrays, ["key", "class", "place", "hot"])

        for batch in batches:
            keys, classes, places, hots, many = [], [], [], [], 0
            for _, values in shingle_sets(batch.column("text")):
                n = len(values)
                if n < 2 or (key := set_id(values)) in seen:
                    continue  # a set of one shingle links with equal sets only
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(key)
                met = counts[_counter(values)].astype(np.int64)
                met[met <= HOT * mean] = 0
                order = np.lexsort((mix(values), met)) if met.any() else np.argsort(mix(values), kind="stable")
                listed = n * 100 > PERCENT * boundary
                if n <= boundary:
                    ranked = values[order[: min(n - least_overlap(n) + 2, n)]]
                    left, right = np.array(list(combinations(range(len(ranked)), 2)), dtype=np.int64).T
                    # a subset is a set: combine its members in the common order, under another seed than single shingles
                    keys.append(mix(ranked[left] * np.uint64(0x9E3779B97F4A7C15) + mix(ranked[right]) + np.uint64(2)))
                    hots.append(np.zeros(len(left), np.int32))
                if listed:
                    first = order[: min(n - least_overlap(n) + more_entries(n), n)]
                    keys.append(mix(values[first] + np.uint64(1)))
                    hots.append((met[first] * 2 // max(1, HOT * mean)).astype(np.int32))
                for x, subset in zip(keys[-((n <= boundary) + listed) :], [True] * (n <= boundary) + [False] * listed, strict=True):
                    places.append(np.full(len(x), 2 * n + subset, dtype=np.int64))
                    classes.append(np.full(len(x), key, dtype=np.int64))
                    many += len(x)
                if many > 1 << 16:
                    yield flush(keys, classes, places, hots)
                    keys, classes, places, hots, many = [], [], [], [], 0
            if many:
                yield flush(keys, classes, places, hots)

    return run


def _kept(shared: DataFrame) -> DataFrame:
    """(key, class, place): the entries that matter, of sets that have enough shared ones.

    A partner may be smaller by a quarter and have fewer entries, so k is that of the smallest partner.
    """
    least = lambda n: f"({n} - ({PERCENT} * {n} + 99) DIV 100)"
    size = f"(({PERCENT} * (place DIV 2) + 99) DIV 100)"
    need = F.expr(f"if(place % 2 = 1, 1L, greatest(1L, ({least(size)} + 1) DIV 2))")
    own = Window.partitionBy("class", "place")
    ranked = shared.withColumns({
        "_m": F.count("*").over(own), "_k": need, "_rank": F.row_number().over(own.orderBy("often", "key")),
    })
    return ranked.filter("_m >= _k AND _rank <= _m - _k + 1").select("key", "class", "place")


def _may_link(x: str, y: str) -> str:
    """Can the places x and y of a shared key belong to sets that link, by size?"""
    return f"100 * least({x} DIV 2, {y} DIV 2) >= {PERCENT} * greatest({x} DIV 2, {y} DIV 2)"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from class_sets((set_id(values), values) for _, values in shingle_sets(batch.column("text")))


def jaccard_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, class, n_shingles) of every document; (class, component) of the classes that link with others.

    component is the smallest class id of the component, not a document id.
    """
    spark = docs.sparkSession
    members, chunks = profile(docs)
    counts = frequency_sketch(chunks)
    mean = max(1, int(counts.sum(dtype=np.int64)) >> LOG2_COUNTERS)
    sketch = spark.sparkContext.broadcast(counts)
    boundary = boundary_of(docs, sketch)
    keys = docs.select("text").mapInArrow(_keys(sketch, boundary, mean), "key bigint, class bigint, place bigint, hot int")
    shared = scratch.save(shared_keys(keys), "shared")
    lists = scratch.save(_kept(shared), "lists")
    scratch.drop(shared)
    sketch.unpersist()

    # the sets of the classes that are left, each read from one of its documents
    classes = scratch.save(lists.select("class").distinct(), "classes")
    homes = scratch.save(members.join(classes, "class", "left_semi").groupBy("class").agg(F.min("doc_id").alias("doc_id")), "homes")
    chosen = semi_join(docs.select(F.col("doc_id").cast("bigint"), "text"), homes, "doc_id")
    # repeated and null ids bring other classes too, or one class twice
    nameless = docs.filter("doc_id is null").select(F.col("doc_id").cast("bigint"), "text")
    found = chosen.unionAll(nameless).mapInArrow(_sets, "class bigint, shingles array<bigint>")
    sets = scratch.save(found.join(classes, "class", "left_semi").groupBy("class").agg(F.first("shingles").alias("shingles")), "sets")
    linked = link_classes(lists, sets, PERCENT, _may_link("{0}", "{1}"))
    for table in (classes, homes, sets):
        scratch.drop(table)
    return members, linked


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; component_id is the smallest doc_id of its component."""
    members, found = jaccard_links(docs)
    placed = scratch.save(
        members.join(found, "class", "left").select("doc_id", "n_shingles", F.coalesce("component", "class").alias("component")), "placed"
    )
    scratch.drop(members)
    # documents of no shingle link with nothing, not even with each other
    least = scratch.save(placed.filter("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    return placed.join(least, "component", "left").select(
        "doc_id", "n_shingles", F.expr("if(n_shingles = 0, doc_id, component_id)").alias("component_id")
    )
