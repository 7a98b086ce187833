"""Package and component tables: filters by build type, and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = {"cpp": ("ament_cmake", "cmake"), "python": ("ament_python", "python"), "meta": ("meta",)}
SORTS = ("name", "health", "version")


def listed(packages: DataFrame, kind: str | None = None, order: str = "name") -> DataFrame:
    """Packages of a kind by name, by health score (highest first, none as 0) or by version, as text; ties by name."""
    if kind is not None and kind not in FILTERS:
        raise ValueError(f"unknown filter {kind}")
    if order not in SORTS:
        raise ValueError(f"unknown order {order}")
    kept = packages.filter(F.col("package_type").isin(*FILTERS[kind])) if kind else packages
    first = {"health": [F.coalesce("health_score", F.lit(0)).desc()], "version": [F.col("version")]}.get(order, [])
    return kept.orderBy(*first, "name")


ROLES = ("publishes", "subscribes", "provides", "calls", "serves", "requests")
NONE = "—"


def node_table(components: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(name, package, language, a list of names for each role), by package and name. A name that is not known before a run is marked.

    components: (package, name, language, has_dynamic_names). A component's own endpoints make one row.
    """
    of = lambda role: F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("seq", "name"))))
    listed = lambda role: F.array_join(F.transform(of(role), lambda e: e["name"]), ", ")
    lists = endpoints.groupBy("package", F.col("component").alias("_of")).agg(*(listed(r).alias(r) for r in ROLES))
    rows = components.withColumnRenamed("name", "_of").join(lists, ["package", "_of"], "left")
    shown = F.concat("_of", F.when(F.col("has_dynamic_names"), " (dynamic)").otherwise("")).alias("name")
    return rows.orderBy("package", "_of").select(shown, "package", "language", *(F.coalesce(F.nullif(r, F.lit("")), F.lit(NONE)).alias(r) for r in ROLES))
