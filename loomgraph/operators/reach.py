"""Reachability of asked pairs, strongly connected components and simple cycles, as rounds of joins over written tables.

Edges are (src, dst); an edge with a null end is none, and repeated edges count once. Every round reads what the
round before has written, so lineage stays short and a lost executor costs one round. Nothing is gathered: rounds are
equi-joins, pre-aggregated minima and anti joins, which adaptive execution splits where a vertex is crowded. None of them is
a broadcast, which would go through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import drop, save

#: Tables of rows seen before they are written as one, without the rows of pairs that are settled.
PARTS = 6
#: Steps between two written tables while the rows to go on from are at most FEW; with more of them each step is written.
STEPS, FEW = 3, 200_000
#: Arcs up to which the components of a class are found inside one task.
SMALL = 1000
#: The graph is condensed before the search where it has less than so many arcs for each asked pair.
CONDENSED = 16


def _with(one: DataFrame, other: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """The join of two tables that both grow with the graph: shuffled, never broadcast."""
    return one.join(other.hint("merge"), on, how)


def _arcs(edges: DataFrame) -> DataFrame:
    return save(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct(), "arcs")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


class _Side:
    """One side of the search: from the asked vertices of column `key`, all (key, at) found so far and the last of them."""

    def __init__(self, key: str, start: DataFrame, arcs: DataFrame, forwards: bool):
        self.key = key
        near, far = ("src", "dst") if forwards else ("dst", "src")
        self.arcs = arcs.select(F.col(near).alias("at"), F.col(far).alias("_to"))
        self.front = save(start, "front")
        self.seen = [self.front]
        self.size = self.front.count()

    def grow(self, pairs: DataFrame) -> None:
        """Goes on from the rows of the pairs that are open."""
        mine = pairs.select(self.key).distinct()
        if len(self.seen) > PARTS:
            whole = save(_with(_union(self.seen), mine, self.key, "left_semi"), "seen")
            for part in self.seen:
                if part is not self.front:
                    drop(part)
            if self.seen[-1] is not self.front:
                raise AssertionError("the last rows seen are those in front")
            self.seen = [whole]
        steps = [_with(self.front, mine, self.key, "left_semi")]
        for _ in range(STEPS if self.size <= FEW else 1):
            steps.append(_with(steps[-1], self.arcs, "at").select(self.key, F.col("_to").alias("at")).distinct())
        fresh = save(_with(_union(steps[1:]).distinct(), _union(self.seen), [self.key, "at"], "left_anti"), "seen")
        if all(self.front is not part for part in self.seen):
            drop(self.front)
        self.front, self.size = fresh, fresh.count()
        self.seen.append(fresh)


def reachable(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst): the asked pairs with a path of one step or more.

    Where many pairs are asked, each strong component becomes one vertex first: pairs inside one are settled at once, and those of the same two
    components are one pair of a graph without cycles, whose cones are smaller by the size of the components; what cannot be reached by the
    order of what both ends reach is not searched for. A few pairs are searched
    for in the graph as it is, of which only their cones are read. Pairs with a null end are left out.
    """
    arcs = _arcs(edges)
    left = save(pairs.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct(), "asked")
    if left.count() * CONDENSED < arcs.count():
        return _searched(arcs, left)
    home = save(strong_components(arcs), "home")
    of = lambda end: home.select(F.col("id").alias(end), F.col("component").alias(f"_{end}"))

    def placed(rows: DataFrame) -> DataFrame:
        both = _with(_with(rows, of("src"), "src", "left"), of("dst"), "dst", "left")
        return both.select("src", "dst", F.coalesce("_src", "src").alias("_from"), F.coalesce("_dst", "dst").alias("_to"), (F.col("_src") == F.col("_dst")).alias("_within"))

    asked = save(placed(left), "asked")
    between = lambda rows: save(rows.filter("_from <> _to").select(F.col("_from").alias("src"), F.col("_to").alias("dst")).distinct(), "between")
    condensed = between(placed(arcs))
    for table in (arcs, left, home):
        drop(table)
    found = _searched(condensed, _possible(condensed, between(asked))).select(F.col("src").alias("_from"), F.col("dst").alias("_to"))
    return asked.filter("_within").select("src", "dst").unionAll(_with(asked, found, ["_from", "_to"]).select("src", "dst"))


def _possible(arcs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that can have a path: whoever reaches another reaches all that this one reaches, so the greatest vertex of it is no less. Consumes pairs.

    That takes tables of the size of the graph, and spares the cones of most pairs without a path, which would have to be walked to their ends.
    """
    top = _colours(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst")), greatest=True)
    of = lambda end: top.select(F.col("id").alias(end), F.col("colour").alias(f"_{end}"))
    left = save(_with(_with(pairs, of("src"), "src"), of("dst"), "dst").filter("_dst <= _src").select("src", "dst"), "possible")
    for table in (top, pairs):
        drop(table)
    return left


def _searched(arcs: DataFrame, left: DataFrame) -> DataFrame:
    """The pairs of `left` with a path. Both are saved tables of distinct rows without nulls; arcs is dropped.

    The search starts at the asked vertices alone and goes both ways: forwards from the sources and backwards from the
    targets, each round on the side with the smaller frontier. A pair is settled once its two sides meet, or once one of them has nothing
    left to add. So no more than the cones of pairs that are open are visited, and never all pairs of the graph.
    """
    ahead = _with(left.select("src").distinct(), arcs, "src").select("src", F.col("dst").alias("at"))
    sides = [_Side("src", ahead, arcs, True), _Side("dst", left.select("dst").distinct().withColumn("at", F.col("dst")), arcs, False)]
    judged, grown = [], 0
    while True:
        one, other = sides[grown], sides[1 - grown]
        met = _with(_with(left, one.front, one.key), _union(other.seen), [other.key, "at"], "left_semi").select("src", "dst").distinct().withColumn("met", F.lit(True))
        more = one.front.select(one.key).distinct().withColumn("more", F.lit(True))  # whoever has no new rows has seen all there is
        judged.append(save(_with(_with(left, met, ["src", "dst"], "left"), more, one.key, "left").select("src", "dst", "met", "more"), "judged"))
        left = judged[-1].filter("met IS NULL AND more").select("src", "dst")
        if left.isEmpty():
            break
        grown = min((0, 1), key=lambda k: sides[k].size)
        sides[grown].grow(left)
    for table in {id(x): x for side in sides for x in (side.front, *side.seen)}.values():
        drop(table)
    drop(arcs)
    return _union([x.filter("met").select("src", "dst") for x in judged])


def _trimmed(arcs: DataFrame) -> DataFrame:
    """The arcs between vertices that have arcs both in and out, again and again, as long as a tenth of them goes. Consumes arcs."""
    before = arcs.count()
    while before:
        left = arcs
        for _ in range(2 if before <= FEW else 1):
            heads, tails = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
            left = _with(_with(left, heads, "src", "left_semi"), tails, "dst", "left_semi").select("src", "dst")
        left = save(left, "arcs")
        drop(arcs)
        arcs, after = left, left.count()
        if after * 10 > before * 9:
            break
        before = after
    return arcs


def _colours(arcs: DataFrame, greatest: bool = False) -> DataFrame:
    """(id, colour): the least, or greatest, vertex from which each vertex can be reached, itself included."""
    first, best = (F.greatest, F.max) if greatest else (F.least, F.min)
    ids = arcs.select(F.col("src").alias("id")).unionAll(arcs.select("dst")).distinct()
    colours = save(ids.withColumn("colour", F.col("id")).withColumn("moved", F.lit(True)), "colours")
    while True:
        told = _with(colours.filter("moved").select(F.col("id").alias("src"), "colour"), arcs, "src").groupBy(F.col("dst").alias("id")).agg(best("colour").alias("told"))
        # the colour of one's colour reaches as far
        jump = colours.filter("id <> colour").select(F.col("id").alias("colour"), F.col("colour").alias("beyond"))
        better = first("colour", F.coalesce("told", "colour"), F.coalesce("beyond", "colour"))
        joined = _with(_with(colours, told, "id", "left"), jump, "colour", "left")
        after = save(joined.select("id", better.alias("colour"), (better != F.col("colour")).alias("moved")), "colours")
        drop(colours)
        colours = after
        if colours.filter("moved").isEmpty():
            return colours.select("id", "colour")


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of the batches, cut so that equal keys, which stand together, are in one table."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
        if len(table):
            cut = pc.index(table[key], table[key][-1]).as_py()
            if cut:
                yield table.slice(0, cut)
            rest = table.slice(cut)
    if rest is not None:
        yield rest


def _rings(out: dict[str, list[str]]) -> Iterator[list[str]]:
    """The strongly connected components of two vertices or more, depth first."""
    at, low, open_, inside = {}, {}, [], set()
    for root in out:
        path = [] if root in at else [(root, iter(out[root]))]
        fresh = root
        while path:
            v, ahead = path[-1]
            if v == fresh:
                at[v] = low[v] = len(at)
                open_.append(v)
                inside.add(v)
            fresh = None
            for w in ahead:
                if w not in at:
                    path.append((w, iter(out.get(w, ()))))
                    fresh = w
                    break
                if w in inside:
                    low[v] = min(low[v], at[w])
            if fresh is None:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[v])
                if low[v] == at[v]:
                    cut = len(open_) - 1
                    while open_[cut] != v:
                        cut -= 1
                    ring = open_[cut:]
                    del open_[cut:]
                    inside.difference_update(ring)
                    if len(ring) > 1:
                        yield ring


def _small_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, component) of arcs (src, dst, colour) that stand by colour; ends of an arc have one colour."""
    for table in _grouped(batches, "colour"):
        out: dict[str, list[str]] = {}
        for a, b in zip(table["src"].to_pylist(), table["dst"].to_pylist(), strict=True):
            out.setdefault(a, []).append(b)
        found = [(v, least) for ring in _rings(out) for least in [min(ring)] for v in ring]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], ["id", "component"])


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) of all vertices on a cycle, a self-loop included; component is the least vertex of its strongly connected component.

    Vertices without arcs in or out are trimmed away first. Then colours go forwards: each vertex takes the least vertex that reaches it. A component
    has one colour, so arcs between colours go. Colours of at most SMALL arcs are settled one by one inside tasks, many to a task. In larger ones
    colours go backwards as well: who reaches his own colour's root is of its component; what is left starts anew,
    without arcs between different colours of either kind. All tables are of the size of the graph that is left.
    """
    whole = _arcs(edges)
    loops = whole.filter("src = dst").select(F.col("src").alias("id"))
    arcs = _trimmed(save(whole.filter("src <> dst"), "arcs"))
    found: list[DataFrame] = []
    while not arcs.isEmpty():
        colours = _colours(arcs)
        of = lambda table, end: table.select(F.col("id").alias(end), F.col("colour").alias(f"_{end}"))
        own = save(_with(_with(arcs, of(colours, "src"), "src"), of(colours, "dst"), "dst").filter("_src = _dst").select("src", "dst", F.col("_src").alias("colour")), "own")
        large = save(own.groupBy("colour").count().filter(F.col("count") > SMALL).select("colour"), "large")
        small = _with(own, large, "colour", "left_anti").repartition("colour").sortWithinPartitions("colour").select("src", "dst", "colour")
        found.append(save(small.mapInArrow(_small_components, "id string, component string"), "members"))
        left = save(_with(own, large, "colour", "left_semi").select("src", "dst", "colour"), "own")
        for table in (arcs, colours, own, large):
            drop(table)
        back = _colours(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        met = save(_with(_with(left, of(back, "src"), "src"), of(back, "dst"), "dst"), "met")
        ends = [met.filter(f"_{end} = colour").select(F.col(end).alias("id"), F.col("colour").alias("component")) for end in ("src", "dst")]
        found.append(save(_union(ends).distinct(), "members"))
        rest = save(met.filter("_src = _dst AND _src <> colour").select("src", "dst"), "arcs")
        for table in (left, back, met):
            drop(table)
        arcs = _trimmed(rest)
    drop(arcs)
    alone = loops.withColumn("component", F.col("id"))
    if not found:
        return alone
    members = _union(found)
    several = members.groupBy("component").count().filter("count > 1").select("component")
    kept = _with(members, several, "component", "left_semi").select("id", "component")
    return kept.unionAll(_with(alone, kept, "id", "left_anti"))


def simple_cycles(edges: DataFrame, longest: int = 50) -> DataFrame:
    """(cycle): every simple cycle once, from its least member on, as an array; longer paths than `longest` raise an error.

    Cycles lie inside strongly connected components, so only arcs inside one take part. A path starts at its least member and
    goes on only to vertices that still reach the start through vertices behind it in order: these (start, vertex) are found first, going
    backwards, and a join with them blocks all other ways. That is a row for each pair of a component at most; the number of cycles
    itself can be exponential, and every one is a row.
    """
    whole = _arcs(edges)
    home = save(strong_components(whole), "home")
    of = lambda end: home.select(F.col("id").alias(end), F.col("component").alias(f"_{end}"))
    inner = save(_with(_with(whole.filter("src <> dst"), of("src"), "src"), of("dst"), "dst").filter("_src = _dst").select("src", "dst"), "inner")
    found = whole.filter("src = dst").select(F.array("src").alias("cycle"))
    front = save(inner.filter("src > dst").select(F.col("dst").alias("start"), F.col("src").alias("at")), "back")
    back = [front]
    while size := front.count():
        steps = [front]
        for _ in range(STEPS if size <= FEW else 1):
            steps.append(_with(steps[-1], inner.withColumnRenamed("dst", "at"), "at").filter("src > start").select("start", F.col("src").alias("at")).distinct())
        front = save(_with(_union(steps[1:]).distinct(), _union(back), ["start", "at"], "left_anti"), "back")
        back.append(front)
    ways = save(_union(back), "back")
    for part in back:
        drop(part)
    paths = save(_with(inner, ways.select(F.col("start").alias("src"), F.col("at").alias("dst")), ["src", "dst"], "left_semi").select("src", F.col("dst").alias("last"), F.array("src", "dst").alias("path")), "paths")
    for _ in range(longest):
        if paths.isEmpty():
            break
        ends = _with(paths.withColumnRenamed("src", "start"), inner.withColumnRenamed("src", "last"), "last")
        found = found.unionAll(ends.filter("dst = start").select(F.col("path").alias("cycle")))
        further = _with(ends.filter("dst > start AND NOT array_contains(path, dst)"), ways.withColumnRenamed("at", "dst"), ["start", "dst"], "left_semi")
        paths = save(further.select(F.col("start").alias("src"), F.col("dst").alias("last"), F.array_append("path", F.col("dst")).alias("path")), "paths")
    if not paths.isEmpty():
        raise ValueError(f"a path is longer than {longest}")
    drop(ways)
    drop(home)
    return found
