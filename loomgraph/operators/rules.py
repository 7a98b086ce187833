"""Policy rules: functions from tables to violations (severity, rule_type, entity, message)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import has_email
from .graph import components, lacking
from .health import workspace_score
from .reach import reachable, simple_cycles

SYSTEM_TOPICS = ("/rosout", "/parameter_events", "/tf", "/tf_static", "/clock")


def _violations(rows: DataFrame, level: str | Column, rule: str, entity: str, message: Column) -> DataFrame:
    level = F.lit(level) if isinstance(level, str) else level
    return rows.select(level.alias("severity"), F.lit(rule).alias("rule_type"), F.col(entity).alias("entity"), message.alias("message"))


def topic_connectivity(endpoints: DataFrame, exclude: Sequence[str] = (), no_publisher: str = "warning", no_subscriber: str = "info") -> DataFrame:
    """Topics with subscribers only, and with publishers only."""
    seen = endpoints.filter(~F.col("name").isin(*SYSTEM_TOPICS, *exclude))
    heard = _violations(
        lacking(seen, "Topic", "publishes", "subscribes"), no_publisher, "topic_connectivity", "name",
        F.concat(F.lit("Topic '"), "name", F.lit("' has no publisher; subscribers: "), "subscribes"),
    )
    said = _violations(
        lacking(seen, "Topic", "subscribes", "publishes"), no_subscriber, "topic_connectivity", "name",
        F.concat(F.lit("Topic '"), "name", F.lit("' has no subscriber; publishers: "), "publishes"),
    )
    return heard.unionByName(said)


def service_connectivity(endpoints: DataFrame, kind: str = "Service", unused: str = "info", missing: str = "warning") -> DataFrame:
    """Services (or actions) that are provided and never called, or called and never provided."""
    rule = f"{kind.lower()}_connectivity"
    idle = _violations(lacking(endpoints, kind, "calls", "provides"), unused, rule, "name", F.concat(F.lit(f"{kind} '"), "name", F.lit("' is never called; provided by "), "provides"))
    lost = _violations(lacking(endpoints, kind, "provides", "calls"), missing, rule, "name", F.concat(F.lit(f"{kind} '"), "name", F.lit("' has no provider; called by "), "calls"))
    return idle.unionByName(lost)


def node_isolation(nodes: DataFrame, endpoints: DataFrame, level: str = "warning", skip_dynamic: bool = True) -> DataFrame:
    """Components without any endpoint. nodes: (package, name, has_dynamic_names)."""
    used = components(endpoints).select("package", F.col("component").alias("name"))
    alone = nodes.join(used, ["package", "name"], "left_anti")
    if skip_dynamic:
        alone = alone.filter("NOT has_dynamic_names")
    return _violations(alone, level, "node_isolation", "name", F.concat(F.lit("Component '"), "name", F.lit("' has no connection")))


def license_rule(packages: DataFrame, allowed: Sequence[str] = (), level: str = "error") -> DataFrame:
    missing = F.coalesce(F.col("license"), F.lit("")) == ""
    refused = ~missing & ~F.col("license").isin(*allowed) if allowed else F.lit(False)
    message = F.when(missing, F.concat(F.lit("Package '"), "name", F.lit("' has no license"))).otherwise(
        F.concat(F.lit("Package '"), "name", F.lit("' has license "), "license")
    )
    return _violations(packages.filter(missing | refused), level, "license", "name", message)


def naming(entities: DataFrame, pattern: str, level: str = "warning") -> DataFrame:
    """Names that the pattern does not match from their start on."""
    return _violations(entities.filter(~F.col("name").rlike(f"^(?:{pattern})")), level, "naming", "name", F.concat(F.lit("Name '"), "name", F.lit("' does not match")))


def maintainer_required(packages: DataFrame, require_email: bool = False, level: str = "warning") -> DataFrame:
    none = F.coalesce(F.size("maintainers"), F.lit(0)) <= 0
    bad = none | ~has_email(F.col("maintainers")) if require_email else none
    return _violations(packages.filter(bad), level, "maintainer_required", "name", F.concat(F.lit("Package '"), "name", F.lit("' has no maintainer")))


def version_not_default(packages: DataFrame, default: str = "0.0.0", level: str = "info") -> DataFrame:
    return _violations(packages.filter(F.col("version") == default), level, "version_not_default", "name", F.concat(F.lit("Package '"), "name", F.lit("' has the default version")))


def health_threshold(scores: DataFrame, least: int = 70, level: str = "warning") -> DataFrame:
    """scores: (name, score)."""
    low = scores.filter(F.coalesce("score", F.lit(0)) < least)
    return _violations(low, level, "health_threshold", "name", F.concat(F.lit("Package '"), "name", F.lit("' scores "), F.coalesce("score", F.lit(0))))


def workspace_threshold(scores: DataFrame, least: int, level: str = "warning") -> DataFrame:
    """One violation where the mean score lies below a threshold other than 0."""
    low = workspace_score(scores).filter((F.lit(least) != 0) & (F.col("score") < least)).withColumn("name", F.lit("workspace"))
    return _violations(low, level, "health_threshold", "name", F.concat(F.lit("The workspace scores "), "score"))


def no_circular_deps(deps: DataFrame, level: str = "error") -> DataFrame:
    """Every simple cycle of dependencies."""
    named = simple_cycles(deps).withColumn("name", F.col("cycle")[0])
    return _violations(named, level, "no_circular_deps", "name", F.concat(F.lit("Dependency cycle: "), F.array_join("cycle", " > ")))


def _reached(deps: DataFrame, packages: DataFrame, listed: DataFrame) -> DataFrame:
    """The listed pairs (src, dst) with a path of any number of steps, none included for a known package."""
    own = listed.filter("src = dst").join(packages.select(F.col("name").alias("src")), "src", "left_semi")
    return reachable(deps, listed.filter("src <> dst")).unionAll(own)


def dependency_forbidden(deps: DataFrame, packages: DataFrame, pairs: Sequence[tuple[str, str]], level: str = "error") -> DataFrame:
    """Pairs (from, to) where to is reachable, over any number of steps, none included."""
    listed = packages.sparkSession.createDataFrame(list(pairs), "src string, dst string")
    hit = listed.join(_reached(deps, packages, listed), ["src", "dst"], "left_semi")
    return _violations(hit, level, "dependency", "src", F.concat(F.lit("'"), "src", F.lit("' must not depend on '"), "dst", F.lit("'")))


def dependency_required(deps: DataFrame, packages: DataFrame, pairs: Sequence[tuple[str, str]], level: str = "warning") -> DataFrame:
    """Pairs (package, depends_on) of a known package whose target is not reachable."""
    listed = packages.sparkSession.createDataFrame(list(pairs), "src string, dst string")
    known = listed.join(packages.select(F.col("name").alias("src")), "src", "left_semi")
    hit = known.join(_reached(deps, packages, listed), ["src", "dst"], "left_anti")
    return _violations(hit, level, "dependency", "src", F.concat(F.lit("'"), "src", F.lit("' must depend on '"), "dst", F.lit("'")))


def violation_summary(violations: DataFrame) -> DataFrame:
    return violations.agg(*(F.count_if(F.col("severity") == s).alias(n) for s, n in (("error", "errors"), ("warning", "warnings"), ("info", "info"))))


def findings_by_rule(violations: DataFrame) -> DataFrame:
    return violations.groupBy("rule_type").agg(F.count("*").alias("n"))


def exit_code(violations: DataFrame, fail_on: str = "error") -> int:
    """1 if a violation is at least as severe as fail_on, else 0."""
    rank = {"error": 0, "warning": 1, "info": 2}[fail_on]
    levels = [s for s, r in (("error", 0), ("warning", 1), ("info", 2)) if r <= rank]
    return int(not violations.filter(F.col("severity").isin(levels)).isEmpty())
