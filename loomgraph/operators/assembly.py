"""From extracted records to the vertices and edges of the architecture graph.

components: (package, name, language, file_path, line, has_dynamic_names, seq)
endpoints: (package, component, role, name, msg_type, file_path, line, evidence, seq)
launch_nodes: (owner_package, executable, package, name, remaps, namespace, source_file, seq)
interfaces: (package, name, kind, fields, file_path, seq)
packages: (name, version, package_type, health_score, seq); deps: (src, dst, dep_type, seq)

Whatever comes first decides, and seq says what comes first, so no result depends on partitioning.
Each step is an equi-join or a pre-aggregated grouping; none gathers rows that are not output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import DYNAMIC, UNKNOWN, in_namespace, last_segment, remapped, snake_symbol
from .graph import ROLES, keyed, node_id


class WorkspaceError(ValueError):
    """The workspace has no packages, or two of one name."""


def duplicate_packages(packages: DataFrame) -> DataFrame:
    """(name, paths): package names that more than one directory claims."""
    return (
        packages.groupBy("name").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("path")).alias("paths"))
        .filter("n > 1").select("name", "paths")
    )


def checked(packages: DataFrame) -> DataFrame:
    """The packages, or a WorkspaceError."""
    if packages.isEmpty():
        raise WorkspaceError("no packages found")
    twice = duplicate_packages(packages).orderBy("name").limit(20).collect()  # a report, not the data
    if twice:
        raise WorkspaceError("; ".join(f"{r['name']} in {', '.join(r['paths'])}" for r in twice))
    return packages


def match_launch(components: DataFrame, launch_nodes: DataFrame) -> DataFrame:
    """(package, component, deployment_name, namespace, remaps): the first launch node that names a component.

    A launch node belongs to the package that owns its launch file. It fits a component when its
    name, or its executable as it is or in snake case, is the component's name or the snake case of it.
    """
    spellings = F.array_distinct(F.array("name", snake_symbol(F.col("name"))))
    wanted = components.select("package", F.col("name").alias("component"), F.explode(spellings).alias("spelling")).distinct()
    offers = launch_nodes.select(
        F.col("owner_package").alias("package"), F.struct("seq", "name", "executable", "namespace", "remaps").alias("launch"),
        F.explode(F.array_distinct(F.array_compact(F.array("name", "executable", snake_symbol(F.col("executable")))))).alias("spelling"),
    )
    return (
        wanted.join(offers, ["package", "spelling"]).groupBy("package", "component").agg(F.min_by("launch", "launch.seq").alias("l"))
        .select("package", "component", F.coalesce(F.nullif("l.name", F.lit("")), F.col("l.executable")).alias("deployment_name"), "l.namespace", "l.remaps")
    )


def with_confidence(endpoints: DataFrame) -> DataFrame:
    """Adds type_source, explicit where a type is known, and confidence, high where the type and the name are."""
    typed = F.col("msg_type") != UNKNOWN
    return endpoints.withColumns({
        "type_source": F.when(typed, "explicit").otherwise(UNKNOWN),
        "confidence": F.when(typed & (F.col("name") != DYNAMIC), "high").otherwise("low"),
    })


def launch_remaps(launch_nodes: DataFrame) -> DataFrame:
    """(owner_package, executable, name, remap_from, remap_to, seq): each launch node's remaps, or one row with nulls; a missing name is empty."""
    return launch_nodes.select(
        "owner_package", "executable", F.coalesce("name", F.lit("")).alias("name"), F.explode_outer("remaps").alias("remap_from", "remap_to"), "seq"
    )


def effective_endpoints(endpoints: DataFrame, launched: DataFrame) -> DataFrame:
    """The endpoints under the names they have once launched; adds original_name and remapped."""
    known = launched.select("package", "component", "namespace", "remaps")
    none = F.create_map().cast("map<string,string>")
    name = in_namespace(remapped(F.col("original_name"), F.coalesce("remaps", none)), F.col("namespace"))
    return (
        endpoints.withColumnRenamed("name", "original_name").join(known, ["package", "component"], "left")
        .withColumn("name", name).withColumn("remapped", F.col("name") != F.col("original_name")).drop("namespace", "remaps")
    )


def infer_types(vertices: DataFrame, interfaces: DataFrame) -> DataFrame:
    """(id, kind, name, msg_type, observed_types, type_source, confidence): untyped ones take the only interface of their last name part."""
    single = (
        interfaces.groupBy(F.lower("name").alias("_bare")).agg(F.count("*").alias("_n"), F.min(F.concat("package", F.lit("/"), "name")).alias("_type"))
        .filter("_n = 1").drop("_n")
    )
    untyped = F.col("msg_type") == UNKNOWN
    joined = vertices.withColumn("_bare", F.when(untyped, last_segment(F.col("name")))).join(single, "_bare", "left")
    guessed = untyped & F.col("_type").isNotNull()
    return joined.select(
        "id", "kind", "name", F.when(guessed, F.col("_type")).otherwise(F.col("msg_type")).alias("msg_type"), "observed_types",
        F.when(guessed, "inferred_name_match").when(untyped, UNKNOWN).otherwise("explicit").alias("type_source"),
        F.when(untyped, "low").otherwise("high").alias("confidence"),
    )


def uses_interface(edges: DataFrame, typed: DataFrame, interfaces: DataFrame) -> DataFrame:
    """(src, dst, rel, key, seq): from each component to the interfaces of the vertices that it talks to, once each."""
    known = interfaces.select(F.concat(F.lit("iface:"), "package", F.lit("/"), "name").alias("iface")).distinct()
    target = typed.select(F.col("id").alias("dst"), F.concat(F.lit("iface:"), "msg_type").alias("iface")).join(known, "iface")
    return (
        edges.join(target, "dst").groupBy("src", "iface").agg(F.min("seq").alias("seq"))
        .select("src", F.col("iface").alias("dst"), F.lit("uses_interface").alias("rel"), F.lit("uses_interface").alias("key"), "seq")
    )


def model_vertices(packages: DataFrame, components: DataFrame, typed: DataFrame, interfaces: DataFrame) -> DataFrame:
    """(id, kind, name, package, msg_type, detail) of all six kinds; a later component of one id replaces an earlier one."""
    none = F.lit(None).cast("string")
    pkg = packages.select(F.concat(F.lit("pkg:"), "name").alias("id"), F.lit("Package").alias("kind"), "name", F.col("name").alias("package"), none.alias("msg_type"), F.col("version").alias("detail"))
    nodes = components.groupBy("package", F.col("name").alias("component")).agg(F.max_by("language", "seq").alias("detail")).select(
        node_id().alias("id"), F.lit("Node").alias("kind"), F.col("component").alias("name"), "package", none.alias("msg_type"), "detail"
    )
    comm = typed.select("id", "kind", "name", none.alias("package"), "msg_type", F.col("type_source").alias("detail"))
    iface = interfaces.groupBy("package", "name").agg(F.max_by("kind", "seq").alias("detail")).select(
        F.concat(F.lit("iface:"), "package", F.lit("/"), "name").alias("id"), F.lit("Interface").alias("kind"), "name", "package", none.alias("msg_type"), "detail"
    )
    return pkg.unionByName(nodes).unionByName(comm).unionByName(iface)


def model_edges(deps: DataFrame, packages: DataFrame, components: DataFrame, comm: DataFrame, uses: DataFrame) -> DataFrame:
    """(src, dst, rel, key) of all seven relations. deps: (src, dst, dep_type, seq)."""
    own = packages.select(F.col("name").alias("dst"))
    depends = keyed(
        deps.join(own, "dst", "left_semi").select(
            F.concat(F.lit("pkg:"), "src").alias("src"), F.concat(F.lit("pkg:"), "dst").alias("dst"), F.lit("depends_on").alias("rel"), "seq"
        )
    )
    defined = keyed(
        components.join(packages.select(F.col("name").alias("package")), "package", "left_semi")
        .select(F.concat(F.lit("node:"), "package", F.lit("/"), "name").alias("src"), F.concat(F.lit("pkg:"), "package").alias("dst"), F.lit("defined_in").alias("rel"), "seq")
    )
    parts = [x.select("src", "dst", "rel", "key") for x in (depends, defined, comm, uses)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


def role_rank() -> Column:
    """The place of a role in the order in which endpoints of a component are seen."""
    order = ("publishes", "subscribes", "provides", "calls", "serves", "requests")
    assert set(order) == set(ROLES)
    out = F.lit(len(order))
    for k, role in enumerate(order):
        out = F.when(F.col("role") == role, k).otherwise(out)
    return out


def summary(vertices: DataFrame) -> DataFrame:
    """(kind, n) over six kinds, zero-filled."""
    kinds = vertices.sparkSession.createDataFrame([(k,) for k in ("Package", "Node", "Topic", "Service", "Action", "Interface")], "kind string")
    return kinds.join(vertices.groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
