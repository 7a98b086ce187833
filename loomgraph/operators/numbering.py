"""Numbers and lists of rows within groups, for groups of any size.

A group's rows are numbered by a window, which one task does, as long as groups are small. Rows of a crowded group
are numbered in two passes: they are range-partitioned by group and order, so that many tasks share a group, each row's place
in its partition is written, and the counts of the partitions before give the offsets. A partition adds one row for each
group that it holds, so offsets are few. Both ways give the same numbers; ties within the order are as good as each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import save

#: Rows from which on a group is crowded.
CROWDED = 100_000


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "nth", crowded: int = CROWDED) -> DataFrame:
    """rows with a column of that name: 1, 2, ... within the group of keys in the given order. Keys that are null make a group like others."""
    heavy = rows.groupBy(*keys).count().filter(F.col("count") > crowded).select(*keys)
    heavy = save(heavy, "crowded")
    plain = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")
    if heavy.isEmpty():
        return rows.withColumn(name, plain)
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys]
    few = rows.alias("r").join(heavy.alias("h"), same, "left_anti").withColumn(name, plain)
    many = rows.alias("r").join(heavy.alias("h"), same, "left_semi")
    return few.unionByName(_in_two_passes(many, keys, order, name).select(few.columns))


def _in_two_passes(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    taken = {c.lower() for c in rows.columns}
    part, at, first, many, before = (next(x for x in (f"_{c}{k or ''}" for k in range(len(taken) + 1)) if x not in taken) for c in ("part", "at", "first", "many", "before"))
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    placed = save(dealt.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id()}), "placed")
    held = placed.groupBy(part, *keys).agg(F.min(at).alias(first), F.count("*").alias(many))
    ahead = F.sum(many).over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    offsets = held.select(part, *keys, first, F.coalesce(ahead, F.lit(0)).alias(before))
    same = [F.col(f"p.{part}") == F.col(f"o.{part}"), *(F.col(f"p.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys)]
    joined = placed.alias("p").join(offsets.alias("o"), same)
    nth = (F.col(f"p.{at}") - F.col(f"o.{first}") + F.col(f"o.{before}") + 1).alias(name)
    return joined.select(*(F.col(f"p.`{c}`") for c in rows.columns), nth)


def chunked(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, size: int = 1000, crowded: int = CROWDED) -> DataFrame:
    """(keys, chunk, first, items): the values of each group in order, in lists of `size` at most; first is the number of a list's first item, from 1."""
    own = rows.select(*keys, *(F.col(o).alias(f"_o{k}") for k, o in enumerate(order)), value.alias("_value"))
    nth = numbered(own, keys, [f"_o{k}" for k in range(len(order))], "_nth", crowded)
    lists = nth.groupBy(*keys, F.floor((F.col("_nth") - 1) / size).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("_nth", "_value"))).alias("l"))
    return lists.select(*keys, "chunk", (F.col("chunk") * size + 1).alias("first"), F.col("l._value").alias("items"))


def tree_digests(digests: DataFrame, keys: Sequence[str], order: str, line: Column, fan: int = 64, crowded: int = CROWDED) -> DataFrame:
    """(keys, fingerprint): a SHA-256 tree over the lines of each group in order.

    The lowest nodes are digests of the lines of up to `fan` rows, higher ones of up to `fan` nodes below, until a
    group has one node, its fingerprint. Nodes are told by number, so the digest is the same for any partitioning, and
    all nodes of a level are made in parallel, however large a group is.
    """
    joined = lambda c: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_nth", c))), lambda r: r[c]), "\n"), 256)
    rows = numbered(digests.select(*keys, F.col(order).alias("_order"), line.alias("_line")), keys, ["_order", "_line"], "_nth", crowded)
    node = F.floor((F.col("_nth") - 1) / fan) + 1
    level = save(rows.groupBy(*keys, node.alias("_node")).agg(joined("_line").alias("_line")).withColumnRenamed("_node", "_nth"), "nodes")
    while not level.filter("_nth > 1").isEmpty():
        # a group with one node is done and stays as it is
        up = level.groupBy(*keys, node.alias("_node")).agg(F.when(F.max("_nth") == 1, F.max("_line")).otherwise(joined("_line")).alias("_line"))
        level = save(up.withColumnRenamed("_node", "_nth"), "nodes")
    return level.select(*keys, F.col("_line").alias("fingerprint"))
