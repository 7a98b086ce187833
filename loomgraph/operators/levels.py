"""Levels of detail of a nested view: what each container shows, so that a view of any size is read a bounded piece at a time.

elements: (id, kind, name, label, parent), each id once, nested at most three deep as graph.compound() makes them; edges:
(src, dst, rel, ...). An edge is shown by one container, the innermost that holds both its ends, between the two parts in which
they lie. So all levels together have no more rows than the view has elements and edges, and the numbers of all levels add
up to the edges. Tables are joined by id and by parent and counts are added up before they are sent, so a container with a third
of all elements is dealt to many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import CROWDED, numbered

#: Elements, and edges, of a container that stand on one page.
PAGE = 1000


def paths(elements: DataFrame) -> DataFrame:
    """(id, path): the containers of an element from the outermost on, and the element itself. A parent that is no element counts for nothing."""
    up = elements.select("id", "parent")
    one = up.alias("e").join(up.alias("p"), F.col("e.parent") == F.col("p.id"), "left").select(
        F.col("e.id").alias("id"), F.col("p.id").alias("_in"), F.col("p.parent").alias("_above")
    )
    two = one.join(up.select(F.col("id").alias("_top")), F.col("_above") == F.col("_top"), "left")
    return two.select("id", F.array_compact(F.array("_top", "_in", "id")).alias("path"))


def level_elements(elements: DataFrame) -> DataFrame:
    """(container, id, kind, name, label, inside): the elements by what they lie in, null at the top, and how many elements lie in them at any depth."""
    placed = paths(elements)
    above = placed.select(F.explode(F.expr("slice(path, 1, size(path) - 1)")).alias("id"))
    inside = above.groupBy("id").agg(F.count("*").alias("inside"))
    container = placed.select("id", F.get("path", F.size("path") - 2).alias("container"))
    return elements.join(container, "id").join(inside, "id", "left").select(
        "container", "id", "kind", "name", "label", F.coalesce("inside", F.lit(0)).cast("bigint").alias("inside")
    )


def level_edges(elements: DataFrame, edges: DataFrame) -> DataFrame:
    """(container, src, dst, rel, n): the edges by the innermost container of both ends, null at the top.

    src and dst are parts of the container, or the container itself where it is an end of the edge. n edges of the view run between them.
    An element with an edge to itself shows it beside itself. Edges with an end that is no element are left out.
    """
    placed = paths(elements)
    one = placed.select(F.col("id").alias("src"), F.col("path").alias("_a"))
    two = placed.select(F.col("id").alias("dst"), F.col("path").alias("_b"))
    parts = lambda k: f"coalesce(get(_a, {k}) <> get(_b, {k}), true)"
    depth = F.expr(f"CASE WHEN src = dst THEN size(_a) - 1 WHEN {parts(0)} THEN 0 WHEN {parts(1)} THEN 1 ELSE 2 END")
    met = edges.select("src", "dst", "rel").join(one, "src").join(two, "dst").withColumn("_depth", depth)
    shown = met.select(
        F.get("_a", F.col("_depth") - 1).alias("container"), F.coalesce(F.get("_a", "_depth"), "src").alias("src"),
        F.coalesce(F.get("_b", "_depth"), "dst").alias("dst"), "rel",
    )
    return shown.groupBy("container", "src", "dst", "rel").agg(F.count("*").alias("n"))


def pages(elements: DataFrame, edges: DataFrame, size: int = PAGE, crowded: int = CROWDED) -> DataFrame:
    """(container, part, page, nth, line): what each container shows, as JSON lines, in pages of `size` elements and `size` edges.

    elements, edges: as level_elements() and level_edges() give them. Elements are in the order of kind, name and id, edges of src, dst and rel; the pages
    of a crowded container are numbered by many tasks.
    """
    order = ["_one", "_two", "_three"]
    key = lambda *c: [F.col(x).alias(o) for x, o in zip(c, order, strict=True)]
    said = elements.select(
        "container", F.lit("elements").alias("part"), *key("kind", "name", "id"), F.to_json(F.struct("id", "kind", "label", "container", "inside")).alias("line")
    )
    drawn = edges.select("container", F.lit("edges").alias("part"), *key("src", "dst", "rel"), F.to_json(F.struct("src", "dst", "rel", "n")).alias("line"))
    rows = numbered(said.unionByName(drawn), ["container", "part"], order, "nth", crowded)
    return rows.select("container", "part", F.floor((F.col("nth") - 1) / size).alias("page"), "nth", "line")
