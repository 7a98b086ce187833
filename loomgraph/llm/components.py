"""Connected components of an edge table, by min-label hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of edges(a, b); component is its smallest reachable id.

    Each round contracts the graph: a vertex hooks to the smallest of itself and its
    neighbours, labels are followed to their own labels, and edges are rewritten between
    labels. Edges inside one label vanish, so what is left shrinks fast; every round is
    joins and pre-aggregated minima of written tables, so a hub is split by adaptive
    execution and nothing is collected. No edges give no rows; self-loops and repeated
    edges change nothing.
    """
    spark = edges.sparkSession
    labels: DataFrame | None = None
    work = scratch.save(_canonical(edges.select("a", "b")), "edges")
    first = True
    while first or not work.isEmpty():
        first = False
        if labels is None and work.isEmpty():
            return spark.createDataFrame([], "id bigint, component bigint")
        hooks = scratch.save(
            work.select(F.col("b").alias("id"), F.col("a").alias("to"))
            .unionAll(work.select(F.col("a").alias("id"), F.col("a").alias("to")))
            .groupBy("id").agg(F.min("to").alias("to")),
            "hooks",
        )
        hooks = _jump(_jump(hooks))
        rewritten = (
            work.join(hooks.select(F.col("id").alias("a"), F.col("to").alias("x")), "a")
            .join(hooks.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
            .select(F.col("x").alias("a"), F.col("y").alias("b"))
        )
        later = scratch.save(_canonical(rewritten), "edges")
        if labels is None:
            merged = hooks.select("id", F.col("to").alias("component"))
        else:
            known = labels.join(hooks.select(F.col("id").alias("component"), "to"), "component", "left")
            merged = known.select("id", F.coalesce("to", "component").alias("component"))
        saved = scratch.save(merged, "labels")
        if labels is not None:
            scratch.drop(labels)
        scratch.drop(work)
        scratch.drop(hooks)
        labels, work = saved, later
    return labels


def _canonical(edges: DataFrame) -> DataFrame:
    return (
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .filter("a < b").distinct()
    )


def _jump(hooks: DataFrame) -> DataFrame:
    further = hooks.select(F.col("id").alias("to"), F.col("to").alias("root"))
    jumped = scratch.save(
        hooks.join(further, "to", "left").select("id", F.coalesce("root", "to").alias("to")), "hooks"
    )
    scratch.drop(hooks)
    return jumped
