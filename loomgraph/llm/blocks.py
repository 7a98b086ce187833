"""Links between classes that share keys, without the pairs of a crowded key.

A key's rows are scanned in sorted order as a stream, so a key of any size needs no memory; keys
that are known to be hot are dealt in pieces. Keys of one class alone vanish in that scan.

Pairs come in waves. Each pairs every class with one centre of its keys in another component:
first the class that shares the most keys, as an original does with its copies, then one by
hash. Once those links are verified and merged into components, only pairs of a key that lie in
two components can still change anything. Where these are few for the rows of their keys, all of
them are verified, each made at the first keys that it shares and not at all of them. Pairs inside
the largest component of a key are never made. No pair is verified where the parities of the two
sets rule the link out: sets differ in no fewer shingles than their parity bits differ, so that
test is exact.

Keys that stay crowded are left, and their classes are joined anew by their whole sets: shingles are
counted exactly among these classes, rarest first, and a class is entered once for each range of
sizes that a partner can have, with just the shingles of which such a partner must have one. Many
texts that share a core and do not link meet nowhere then, because the core comes after what
is rarer, and what such a partner must have lies before it. The core itself is counted and put in order inside tasks.
A group of many alike classes thus costs its size, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .components import connected_components
from .shingles import mix

#: Frequencies of keys are told apart up to so many classes.
MOST = 4096
LISTED = "key bigint, class bigint, place bigint, often int"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, class, place, hot) sorted by key and class: those of keys that two classes have, once each, with the number of classes.

    From MOST classes on a key is given out as it comes, as one of MOST; so is a hot one, as one of MOST + hot.
    """

    def packed(cols: list[np.ndarray], often: np.ndarray) -> pa.RecordBatch:
        arrays = [pa.array(c, pa.int64()) for c in cols[:3]] + [pa.array(often, pa.int32())]
        return pa.RecordBatch.from_arrays(arrays, ["key", "class", "place", "often"])

    held: list[np.ndarray] | None = None  # the rows of the last key
    flowing: tuple[int, int] | None = None  # a key of MOST classes or more and its last class
    for batch in batches:
        cols = [batch.column(c).to_numpy() for c in ("key", "class", "place", "hot")]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            held = None
        if not len(cols[0]):
            continue
        fresh = np.ones(len(cols[0]), dtype=bool)
        fresh[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
        if flowing and (cols[0][0], cols[1][0]) == flowing:
            fresh[0] = False
        cols = [c[fresh] for c in cols]
        if flowing and len(cols[0]):
            m = int(np.searchsorted(cols[0], flowing[0], "right"))
            if m:
                yield packed([c[:m] for c in cols], np.maximum(MOST, MOST + cols[3][:m]))
                flowing = (flowing[0], int(cols[1][m - 1]))
            cols = [c[m:] for c in cols]
        if not len(cols[0]):
            continue
        flowing = None
        new = np.flatnonzero(np.append(True, cols[0][1:] != cols[0][:-1]))
        last = int(new[-1])
        often = np.repeat(np.diff(new), np.diff(new))  # of all keys but the last
        hot = cols[3][:last]
        pick = np.flatnonzero((often > 1) | (hot > 0))
        if len(pick):
            yield packed([c[pick] for c in cols], np.where(hot > 0, MOST + hot, np.minimum(often, MOST))[pick])
        held = [c[last:] for c in cols]
        if len(held[0]) >= MOST:
            yield packed(held, MOST + held[3])
            flowing, held = (int(held[0][0]), int(held[1][-1])), None
    if held is not None and len(held[0]) and (len(held[0]) > 1 or held[3][0] > 0):
        n = len(held[0])
        yield packed(held, np.where(held[3] > 0, MOST + held[3], np.full(n, n)))


def shared_keys(keys: DataFrame) -> DataFrame:
    """LISTED rows of the keys that more than one class has. keys: (key, class, place, hot), repeats allowed.

    hot is 0, or the number of pieces that a frequent key is dealt in; it is the same in all rows of a key.
    """
    dealt = F.when(F.col("hot") > 0, F.xxhash64("key", F.pmod("class", F.greatest("hot", F.lit(1))))).otherwise(F.col("key"))
    return keys.repartition(dealt).sortWithinPartitions("key", "class").mapInArrow(_shared, LISTED)


def verified_jaccard(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes with 100 * |A & B| >= percent * |A | B|; sets: (class, shingles), one row each.

    The set of b is joined last and moves once, however many pairs b has.
    """
    one = sets.select(F.col("class").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("class").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y")).cast("bigint")
    return (
        pairs.join(one, "a").join(two, "b")
        .select("a", "b", both.alias("both"), (F.size("x").cast("bigint") + F.size("y")).alias("sum"))
        .filter(100 * F.col("both") >= percent * (F.col("sum") - F.col("both")))
        .select("a", "b")
    )


def class_sets(found: Iterable[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Batches of (class, shingles) of bounded size."""

    def pack():
        ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
        values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), values], ["class", "shingles"])

    ids, sets, many = [], [], 0
    for key, values in found:
        ids.append(key)
        sets.append(values.view(np.int64))
        many += len(values)
        if many > 1 << 17:
            yield pack()
            ids, sets, many = [], [], 0
    if ids:
        yield pack()


#: Waves at most, and how many pairs for each row of the keys are few enough to end them.
WAVES, FEW = 6, 2
#: A wave after the first is worth its while if more than one in so many of its pairs links.
WORTH = 4
#: A key with more pairs across components for each of its rows is crowded.
CROWDED = 16
#: Keys before one, in the order of a class, that are asked whether a pair met there already.
BEFORE = 6


def _open(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """(key, class, place, component) of the keys that more than one component has. found: (id, component) of components."""
    if found is not None:
        moved = found.select(F.col("id").alias("component"), F.col("component").alias("_to"))
        rows = scratch.save(rows.join(moved, "component", "left").select("key", "class", "place", F.coalesce("_to", "component").alias("component")), "placed")
    mixed = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    kept = scratch.save(rows.join(mixed, "key", "left_semi"), "open")
    scratch.drop(rows)
    return kept


def _sizes(rows: DataFrame) -> DataFrame:
    """(key, rows, main, pairs) of (key, component): its rows, its largest component, and its pairs across components."""
    of = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    return of.groupBy("key").agg(
        F.sum("n").alias("rows"), F.max(F.struct("n", "component"))["component"].alias("main"),
        F.expr("(sum(double(n)) * sum(double(n)) - sum(double(n) * n)) / 2").alias("pairs"),
    )


def _few(rows: DataFrame) -> bool:
    """Are the pairs across components few for the rows that they come from?"""
    total = _sizes(rows).agg(F.sum("rows").alias("rows"), F.sum("pairs").alias("pairs")).first()
    return (total["pairs"] or 0) <= FEW * (total["rows"] or 0)


#: Words of 64 parity bits of a set.
PARITY = 8


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, n, odd) of (class, shingles): for each of 64 * PARITY bins, has the set an odd number of shingles in it?"""
    for batch in batches:
        lists = batch.column("shingles")
        ends = np.asarray(lists.offsets)
        values = lists.values.to_numpy().view(np.uint64)
        bins = (mix(values ^ np.uint64(0x5DEECE66D)) % np.uint64(64 * PARITY)).astype(np.int64)
        words = [
            np.packbits((np.bincount(bins[a:b], minlength=64 * PARITY) & 1).astype(np.uint8)).view(np.int64) for a, b in zip(ends[:-1], ends[1:], strict=True)
        ]
        flat = np.concatenate(words) if words else np.zeros(0, np.int64)
        odd = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * PARITY), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(np.diff(ends).astype(np.int64)), odd], ["class", "n", "odd"])


def _near(one: str, two: str, percent: int) -> str:
    """SQL: can sets with these suffixes of n and odd link?"""
    apart = " + ".join(f"bit_count(odd_{one}[{k}] ^ odd_{two}[{k}])" for k in range(PARITY))
    return f"{100 + percent} * ({apart}) <= {100 - percent} * (n_{one} + n_{two})"


def _centred(rows: DataFrame, wave: int, may_link: str, parities: DataFrame, percent: int) -> DataFrame:
    """(a, b): each class with the centre that it meets most, of the centres of its keys that are in another component and may link with it."""
    if wave:
        ranked = rows.withColumn("rank", F.xxhash64(F.lit(wave), "component", "class"))
    else:
        shared = rows.groupBy("class").agg((-F.count("*")).alias("rank"))
        ranked = rows.join(shared, "class")
    centre = ranked.groupBy("key").agg(F.min(F.struct("rank", "class", "place", "component")).alias("c"))
    met = (
        rows.join(centre, "key").filter(f"component <> c.component AND {may_link.format('place', 'c.place')}")
        .select("class", F.col("c.class").alias("other")).groupBy("class", "other").count()
    )
    side = lambda key, name: parities.select(F.col("class").alias(key), F.col("n").alias(f"n_{name}"), F.col("odd").alias(f"odd_{name}"))
    able = met.join(side("other", "b"), "other").join(side("class", "a"), "class").filter(_near("a", "b", percent))
    top = able.groupBy("class").agg(F.max(F.struct("count", "other")).alias("best"))
    return top.select(F.col("class").alias("a"), F.col("best.other").alias("b"))


def _across(rows: DataFrame, sizes: DataFrame, may_link: str, parities: DataFrame, percent: int) -> DataFrame:
    """(a, b) of all pairs that share a key of sizes, lie in two components and may link by the parities of their sets.

    A pair is left out at a key where one of the BEFORE keys ahead of it is the same in both
    classes: it is made there. One of a pair is always outside the largest component of the key.
    """
    by = Window.partitionBy("class").orderBy("key")
    calm = rows.join(sizes.select("key", "main"), "key")
    seen = calm.withColumn("seen", F.array(*(F.lag("key", k).over(by) for k in range(1, BEFORE + 1)))).join(parities, "class")

    def side(of: DataFrame, name: str) -> DataFrame:
        return of.select("key", F.col("class").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("main", "place", "component", "seen", "n", "odd")))

    again = "coalesce(arrays_overlap(seen_a, seen_b), false)"
    near = _near("a", "b", percent)
    met = side(seen.filter("component <> main"), "a").join(side(seen, "b"), "key").filter(
        f"component_a <> component_b AND (component_b = main_b OR a < b) AND {may_link.format('place_a', 'place_b')} AND {near} AND NOT {again}"
    )
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _steps() -> np.ndarray:
    """The least sizes of the ranges that sizes fall into: each size alone at first, then ranges of a twentieth."""
    steps = [0]
    while steps[-1] < 1 << 32:
        steps.append(max(steps[-1] + 1, steps[-1] * 21 // 20))
    return np.array(steps, dtype=np.int64)


_STEPS = _steps()


def _entries(percent: int) -> object:
    """Entries of (class, component, n, shingles): shingles are those that other sets have too, in the common order; n is the size of the whole set.

    A partner of m shingles shares at least o = percent * (n + m) / (100 + percent), so it has one of the first n - o + 1.
    The shingles of no other set come first in the order. role tells which of the two is in the range of smaller sizes (1), and 0 where both are in one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack() -> pa.RecordBatch:
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "role", "class", "component", "n", "place"])

        for batch in batches:
            lists = batch.column("shingles")
            ends, values = np.asarray(lists.offsets), lists.values.to_numpy().view(np.uint64)
            held: list[tuple[np.ndarray, ...]] = []
            total = 0
            for i, (name, component, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("class", "component", "n")), strict=True)):
                shared = values[ends[i] : ends[i + 1]]
                alone = n - len(shared)
                least, most = -(-percent * n // 100), 100 * n // percent
                low, own, high = (np.searchsorted(_STEPS, [least, n, most], "right") - 1).tolist()
                for g in range(low, high + 1):
                    smallest = max(int(_STEPS[g]), least)
                    many = n + 1 - alone + (-percent * (n + smallest) // (100 + percent))
                    if many <= 0:
                        continue
                    between = mix(np.array([min(own, g) * len(_STEPS) + max(own, g) + 1], dtype=np.uint64))
                    key = mix(shared[:many] * np.uint64(0x9E3779B97F4A7C15) + between)
                    role = 0 if g == own else 1 if g > own else 2
                    held.append((
                        key.view(np.int64), np.full(len(key), role, np.int32), np.full(len(key), name, np.int64), np.full(len(key), component, np.int64),
                        np.full(len(key), n, np.int64), alone + np.arange(len(key), dtype=np.int64),
                    ))
                    total += len(key)
                    if total > 1 << 17:
                        yield pack()
                        held, total = [], 0
            if held:
                yield pack()

    return run


#: Shingles of a crowd that each hold more than one in so many of its shared ones; so there are fewer of them than this.
HEAVY = 1 << 16


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, n) of (shingles): how many sets of a batch have each."""
    for batch in batches:
        values, n = np.unique(batch.column("shingles").flatten().to_numpy(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], ["shingle", "n"])


def _parted(heavy) -> object:
    """(class, component, n, rare, common) of (class, component, shingles): common are the shingles of heavy, in its order; rare the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = heavy.value
        for batch in batches:
            lists = batch.column("shingles")
            values, size = lists.flatten().to_numpy(), np.diff(np.asarray(lists.offsets))
            row = np.repeat(np.arange(len(size)), size)
            at = np.minimum(np.searchsorted(known, values), max(0, len(known) - 1))
            held = known[at] == values if len(known) else np.zeros(len(values), dtype=bool)
            order = np.lexsort((rank[at[held]], row[held]))
            cols = []
            for of, rows in ((values[~held], row[~held]), (values[held][order], row[held][order])):
                ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(size)))]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(of)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("class"), batch.column("component"), pa.array(size.astype(np.int64)), *cols], ["class", "component", "n", "rare", "common"]
            )

    return run


def _crowd_shared(own: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sets of a crowd as _entries wants them, (class, component, n, shingles); the rows (class, shingle) dealt for it, and a saved table of counts.

    own: a saved table (class, component, shingles). The shingles that a crowd has in common are few. They are counted inside tasks and
    put in order there, so that what is dealt by shingle is no more than what the sets have besides.
    """
    often = own.select("shingles").mapInArrow(_counted, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("often"))
    often = scratch.save(often.filter("often > 1"), "often")
    total = often.agg(F.sum("often")).first()[0] or 0
    heavy = sorted((r["often"], r["shingle"]) for r in often.filter(F.col("often") * HEAVY > total).collect())
    known = np.array([x for _, x in heavy], dtype=np.int64)
    rank = np.argsort(known)
    order = own.sparkSession.sparkContext.broadcast((known[rank], rank))
    parted = own.mapInArrow(_parted(order), "class bigint, component bigint, n bigint, rare array<bigint>, common array<bigint>")
    each = parted.select("class", F.explode("rare").alias("shingle"))
    listed = each.join(often, "shingle").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("often", "shingle")))["shingle"].alias("shared"))
    ordered = (
        parted.select("class", "component", "n", "common").join(listed, "class", "left")
        .select("class", "component", "n", F.concat(F.coalesce("shared", F.expr("array()")), "common").alias("shingles")).filter("size(shingles) > 0")
    )
    return ordered, each, often


def _crowd_entries(classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(key, role, class, component, n, place, main) of the classes (class, component), at the keys that more than one component has."""
    own = scratch.save(sets.join(classes, "class").select("class", "component", "shingles"), "crowd")
    ordered, _, often = _crowd_shared(own)
    made = ordered.mapInArrow(_entries(percent), "key bigint, role int, class bigint, component bigint, n bigint, place bigint")
    entries = scratch.save(made, "entries")
    for table in (own, often):
        scratch.drop(table)
    kept = scratch.save(entries.join(_sizes(entries).filter("pairs > 0").select("key", "main"), "key"), "kept")
    scratch.drop(entries)
    return kept


def _crowd_meetings(entries: DataFrame) -> DataFrame:
    """What meets at the keys of entries, each pair with one that is outside the key's largest component."""

    def side(of: DataFrame, name: str, role: str) -> DataFrame:
        return of.select("key", F.expr(role).alias("role"), F.col("class").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("main", "component", "n", "place")))

    return side(entries.filter("component <> main"), "a", "if(role = 0, 0, 3 - role)").join(side(entries, "b", "role"), ["key", "role"])


def _crowd_pairs(entries: DataFrame, parities: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs across components that may link: at the first key that they share, enough of both sets must follow."""
    follow = f"{100 + percent} * least(n_a - place_a, n_b - place_b) >= {percent} * (n_a + n_b)"
    met = (
        _crowd_meetings(entries).filter(f"component_a <> component_b AND (component_b = main_b OR a < b) AND {follow}")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    side = lambda name: parities.select(F.col("class").alias(name), F.col("n").alias(f"n_{name}"), F.col("odd").alias(f"odd_{name}"))
    return met.join(side("a"), "a").join(side("b"), "b").filter(_near("a", "b", percent)).select("a", "b")


def link_classes(lists: DataFrame, sets: DataFrame, percent: int, may_link: str = "true") -> DataFrame:
    """(class, component) of the classes that link with others; component is its smallest class.

    lists: a saved table (key, class, place), a row for each key of each class, each once; it is dropped.
    sets: a saved table (class, shingles) of all these classes, each once. may_link: a condition
    on two places, as a format string, that all linked pairs meet.
    """
    found: DataFrame | None = None  # (id, component) of the classes that are linked so far

    def merge(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Components after these links too; and what the components of before have become."""
        if found is None:
            moved = connected_components(links)
            return moved, moved
        of = lambda x: found.select(F.col("id").alias(x), F.col("component").alias(f"c{x}"))
        joined = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        moved = connected_components(joined)
        to = moved.select(F.col("id").alias("component"), F.col("component").alias("_to"))
        old = found.join(to, "component", "left").select("id", F.coalesce("_to", "component").alias("component"))
        alone = moved.join(found.select("id"), "id", "left_anti").select("id", "component")
        return scratch.save(old.unionAll(alone), "found"), moved

    def some_sets(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("class")).unionAll(pairs.select(F.col("b").alias("class"))).distinct()
        return scratch.save(sets.join(wanted, "class", "left_semi"), "some")

    rows = _open(lists.select("key", "class", "place", F.col("class").alias("component")), None)
    scratch.drop(lists)
    parities = scratch.save(sets.mapInArrow(_parities, "class bigint, n bigint, odd array<bigint>"), "parities")
    for wave in range(WAVES):
        if _few(rows):
            break
        pairs = scratch.save(_centred(rows, wave, may_link, parities, percent), "stars")
        chosen = some_sets(pairs)
        links = scratch.save(verified_jaccard(pairs, chosen, percent), "links")
        merged, asked = links.count(), pairs.count()
        if merged:
            found, moved = merge(links)
            rows = _open(rows, moved)
        scratch.drop(pairs)
        scratch.drop(links)
        scratch.drop(chosen)
        if wave and merged * WORTH <= asked:
            break  # what is left does not link, or by few pairs only
    sizes = scratch.save(_sizes(rows), "sizes")
    # few pairs in all are made as they are; of many, those of crowded keys are made by the whole sets
    crowded = "false" if _few(rows) else f"pairs > {CROWDED} * rows"
    pairs = _across(rows, sizes.filter(f"NOT ({crowded})"), may_link, parities, percent)
    members = scratch.save(rows.join(sizes.filter(crowded), "key", "left_semi").select("class", "component").distinct(), "crowded")
    temporary = [rows, sizes, members, parities]
    if not members.isEmpty():
        temporary.append(_crowd_entries(members, sets, percent))
        pairs = pairs.unionAll(_crowd_pairs(temporary[-1], parities, percent)).distinct()
    across = scratch.save(pairs, "across")
    if not across.isEmpty():
        links = scratch.save(verified_jaccard(across, some_sets(across), percent), "links")
        if not links.isEmpty():
            found, _ = merge(links)
    for table in (*temporary, across):
        scratch.drop(table)
    if found is None:
        found = sets.sparkSession.createDataFrame([], "id bigint, component bigint")
    return found.withColumnRenamed("id", "class")
