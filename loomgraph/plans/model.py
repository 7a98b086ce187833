"""The model of a workspace: lazy tables from its files, and the graph over them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import DYNAMIC, has_email
from ..operators import assembly, graph, health
from ..shared import save
from ..sources import cache as records
from ..sources import cpp, launch, workspace

#: The form of parsed records; another one is kept apart.
RECORDS = "v1"


@dataclass(frozen=True)
class Model:
    """Tables of packages, components, endpoints, interfaces and launch nodes, and what follows from them.

    Tables can come from a workspace (read()) or from anywhere else with the same columns.
    """

    packages: DataFrame
    deps: DataFrame
    components: DataFrame
    declared: DataFrame
    interfaces: DataFrame
    launch_nodes: DataFrame
    signals: DataFrame
    unresolved: DataFrame | None = None

    @cached_property
    def launched(self) -> DataFrame:
        return assembly.match_launch(self.components, self.launch_nodes)

    @cached_property
    def endpoints(self) -> DataFrame:
        return assembly.effective_endpoints(self.declared, self.launched)

    @cached_property
    def comm_edges(self) -> DataFrame:
        return graph.comm_edges(self.endpoints)

    @cached_property
    def typed(self) -> DataFrame:
        return assembly.infer_types(graph.comm_vertices(self.endpoints), self.interfaces)

    @cached_property
    def vertices(self) -> DataFrame:
        return assembly.model_vertices(self.packages, self.components, self.typed, self.interfaces)

    @cached_property
    def edges(self) -> DataFrame:
        uses = assembly.uses_interface(self.comm_edges, self.typed, self.interfaces)
        return assembly.model_edges(self.deps, self.packages, self.components, self.comm_edges, uses)

    @cached_property
    def scores(self) -> DataFrame:
        """(name, score) of the packages."""
        own = self.deps.join(self.packages.select(F.col("name").alias("dst")), "dst", "left_semi").select("src", "dst")
        return health.deduct_cycles(health.score(self.signals), own)

    @property
    def diagnostics(self) -> DataFrame:
        """(severity, code, message, file, entity): types that disagree, and launch files that cannot be read through."""
        none = F.lit(None).cast("string")
        clash = graph.type_conflicts(self.endpoints).select(
            F.lit("warning").alias("severity"), F.lit("type_conflict").alias("code"),
            F.concat(F.lit("first typed as "), "first_type", F.lit(", later as "), "msg_type").alias("message"), none.alias("file"), F.col("id").alias("entity"),
        )
        return clash if self.unresolved is None else clash.unionByName(self.unresolved)

    def kind_rows(self, kind: str, one: str, other: str) -> DataFrame:
        """(name, msg_type, <one>, <other>) of the topics, services or actions, with types inferred by name too."""
        types = self.typed.filter(F.col("kind") == kind).select("name", F.col("msg_type").alias("_type"))
        return graph.peers(self.endpoints, kind, one, other).join(types, "name").select("name", F.col("_type").alias("msg_type"), one, other)

    def tables(self) -> dict[str, DataFrame]:
        """Everything that the model says, table by table."""
        return {
            "packages": self.packages.join(self.scores.withColumnRenamed("score", "health_score"), "name", "left"), "nodes": self.components,
            "endpoints": self.endpoints, "interfaces": self.interfaces, "topics": self.kind_rows("Topic", "publishes", "subscribes"),
            "services": self.kind_rows("Service", "provides", "calls"), "actions": self.kind_rows("Action", "provides", "calls"),
            "launch_remaps": assembly.launch_remaps(self.launch_nodes), "diagnostics": self.diagnostics, "summary": assembly.summary(self.vertices),
            "vertices": self.vertices, "edges": self.edges,
        }


def read(spark: SparkSession, path: str, cache: str | None = None) -> Model:
    """The model of the workspace at or above a path or URI that all executors can read.

    cache: a folder that all executors share; what has been parsed is kept there, and only files that are new or changed are parsed.
    """
    listing = workspace.files(spark, workspace.source_root(workspace.workspace_root(path)))
    listing = save(listing, "listing")
    broken = workspace.broken_manifests(listing)
    manifests = assembly.checked(workspace.packages(listing))
    named = manifests.select(F.col("path").alias("root"), F.col("name").alias("package"))
    listing = listing.drop("package").join(named, "root")
    # what is parsed is written once: every table of the model reads it again
    manifests = save(manifests, "manifests")
    packages = manifests.withColumn("seq", F.col("name"))
    deps = manifests.select(F.col("name").alias("src"), F.posexplode("deps").alias("at", "d")).select(
        "src", F.col("d.dep_name").alias("dst"), F.col("d.dep_type").alias("dep_type"), F.struct("src", "at").alias("seq")
    )

    def parsed(parse: Callable[[DataFrame], DataFrame], kind: str, package: str = "package") -> DataFrame:
        return parse(listing) if cache is None else records.cached(listing, parse, f"{cache}/{kind}-{RECORDS}", package)

    found = save(
        parsed(workspace.python_records, "python").withColumn("language", F.lit("python"))
        .unionByName(parsed(cpp.cpp_records, "cpp").withColumn("language", F.lit("cpp"))), "declared",
    )
    rank = F.when(F.col("language") == "python", 0).otherwise(1).alias("lang")
    dynamic = found.groupBy("package", "component", "file_path").agg(F.coalesce(F.bool_or(F.col("name") == DYNAMIC), F.lit(False)).alias("has_dynamic_names"))
    components = (
        found.filter("role is null").withColumn("seq", F.struct("package", rank, "file_path", "line"))
        .join(dynamic, ["package", "component", "file_path"])
        .select("package", F.col("component").alias("name"), "language", "file_path", "line", "has_dynamic_names", "seq")
    )
    declared = assembly.with_confidence(found.filter("role is not null")).withColumn(
        "seq", F.struct("package", rank, "file_path", "component", assembly.role_rank().alias("role"), "line", F.col("name").alias("at"))
    )
    launched = save(parsed(launch.launch_records, "launch", "owner_package"), "launch")
    return Model(
        packages, deps, components, declared, save(workspace.interfaces(listing), "interfaces"), launch.launch_nodes(launched), signals_of(manifests, workspace.facts(listing)),
        launch.unresolved(launched).unionByName(broken),
    )


def signals_of(manifests: DataFrame, facts: DataFrame) -> DataFrame:
    """(name, one boolean per health signal) from manifests and the files beside them."""
    filled = lambda c: F.length(F.btrim(F.coalesce(c, F.lit("")))) > 0
    rows = manifests.join(facts.withColumnRenamed("package", "name"), "name", "left")
    return rows.select(
        "name",
        (F.length(F.btrim(F.coalesce("description", F.lit("")))) > 5).alias("has_description"), filled(F.col("license")).alias("has_license"),
        F.exists("maintainers", filled).alias("has_maintainer"), has_email(F.col("maintainers")).alias("has_maintainer_email"),
        (filled(F.col("version")) & (F.col("version") != "0.0.0")).alias("has_version"),
        (~F.exists("deps", lambda d: d["dep_name"] == F.col("name"))).alias("no_self_dependency"),
        F.exists("deps", lambda d: d["dep_type"] == "test").alias("test_deps_declared"),
        *(F.coalesce(c, F.lit(False)).alias(c) for c in ("has_readme", "has_test_dir", "has_launch_files")),
    )
