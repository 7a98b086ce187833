"""Policies: lists of rules, checked before anything runs, each turned into a table of violations."""

from __future__ import annotations

import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import severity_rank
from ..operators import rules
from .model import Model

LEVELS = ("error", "warning", "info")


class PolicyError(ValueError):
    """What is wrong with a policy, in words for its author."""


def _level(rule: dict, key: str, default: str) -> str:
    value = str(rule.get(key) or default).lower()
    return value if value in LEVELS else "warning"


def _health(m: Model, r: dict) -> DataFrame:
    level = _level(r, "severity", "warning")
    return rules.health_threshold(m.scores, r.get("min_score", 70), level).unionByName(
        rules.workspace_threshold(m.scores, r.get("workspace_min_score", 0), level)
    )


def _license(m: Model, r: dict) -> DataFrame:
    return rules.license_rule(m.packages, r.get("allowed", []), _level(r, "severity", "error"))


#: Default patterns and severities of the naming rule.
_SNAKE, _PATH = r"^[a-z][a-z0-9_]*$", r"^/?[a-z][a-z0-9_/]*$"
_SECTIONS = {"packages": ("Package", _SNAKE, "warning"), "nodes": ("Node", _SNAKE, "warning"), "topics": ("Topic", _PATH, "info"), "services": ("Service", _PATH, "info")}


def _naming(m: Model, r: dict) -> DataFrame | None:
    parts = [
        rules.naming(m.vertices.filter(F.col("kind") == kind), java_pattern(str(r[s].get("pattern") or pattern)), _level(r[s], "severity", level))
        for s, (kind, pattern, level) in _SECTIONS.items() if r.get(s) is not None
    ]
    return _union(parts)


def _dependency(m: Model, r: dict) -> DataFrame | None:
    deps = m.deps.select("src", "dst").join(m.packages.select(F.col("name").alias("dst")), "dst", "left_semi").select("src", "dst")
    parts = []
    for level in LEVELS:
        banned = [(e["from"], e["to"]) for e in r.get("forbidden", []) if _level(e, "severity", "error") == level]
        needed = [(e["package"], e["depends_on"]) for e in r.get("required", []) if _level(e, "severity", "warning") == level]
        parts += [rules.dependency_forbidden(deps, m.packages, banned, level)] if banned else []
        parts += [rules.dependency_required(deps, m.packages, needed, level)] if needed else []
    return _union(parts)


def _no_cycles(m: Model, r: dict) -> DataFrame:
    own = m.deps.join(m.packages.select(F.col("name").alias("dst")), "dst", "left_semi").select("src", "dst")
    return rules.no_circular_deps(own, _level(r, "severity", "error"))


def _maintainer(m: Model, r: dict) -> DataFrame:
    return rules.maintainer_required(m.packages, bool(r.get("require_email", False)), _level(r, "severity", "warning"))


def _version(m: Model, r: dict) -> DataFrame:
    return rules.version_not_default(m.packages, str(r.get("default_version", "0.0.0")), _level(r, "severity", "info"))


def _topics(m: Model, r: dict) -> DataFrame:
    found = rules.topic_connectivity(m.endpoints, r.get("exclude", ()), _level(r, "severity_no_publisher", "warning"), _level(r, "severity_no_subscriber", "info"))
    if not r.get("no_publisher", True):
        found = found.filter(~F.contains("message", F.lit("has no publisher")))
    return found if r.get("no_subscriber", True) else found.filter(~F.contains("message", F.lit("has no subscriber")))


def _isolation(m: Model, r: dict) -> DataFrame:
    return rules.node_isolation(m.components, m.endpoints, _level(r, "severity", "warning"), bool(r.get("skip_dynamic_names", True)))


def _services(m: Model, r: dict) -> DataFrame:
    return rules.service_connectivity(m.endpoints, "Service", _level(r, "severity", "info"), _level(r, "missing_provider_severity", "warning"))


def _actions(m: Model, r: dict) -> DataFrame:
    return rules.service_connectivity(m.endpoints, "Action", _level(r, "severity", "warning"), _level(r, "missing_server_severity", "warning"))


RULES: dict[str, Callable[[Model, dict], DataFrame | None]] = {
    "health_threshold": _health, "license": _license, "naming": _naming, "dependency": _dependency, "no_circular_deps": _no_cycles,
    "maintainer_required": _maintainer, "version_not_default": _version, "topic_connectivity": _topics, "node_isolation": _isolation,
    "service_connectivity": _services, "action_connectivity": _actions,
}
_LEVEL_KEYS = ("severity", "severity_no_publisher", "severity_no_subscriber", "missing_provider_severity", "missing_server_severity")
_LISTS = {"forbidden": ("from", "to"), "required": ("package", "depends_on")}
#: The rules of an audit, which needs no policy.
AUDIT = [{"type": t} for t in ("topic_connectivity", "node_isolation", "service_connectivity", "action_connectivity")]


def java_pattern(pattern: str) -> str:
    """Named groups as Java writes them."""
    return re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<"))


def check(policy: object, source: str = "policy") -> list[dict]:
    """The rules of a policy, or a PolicyError that names the place."""

    def need(right: bool, problem: str) -> None:
        if not right:
            raise PolicyError(f"{source}: {problem}")

    need(isinstance(policy, dict), "it is no mapping")
    need(policy.get("version") == 1, "version is not 1")
    need(isinstance(policy.get("rules"), list), "rules is no list")
    for n, rule in enumerate(policy["rules"], 1):
        need(isinstance(rule, dict), f"rule {n} is no mapping")
        need(rule.get("type") in RULES, f"rule {n} has the type {rule.get('type')!r}; known are {', '.join(sorted(RULES))}")
        for key in _LEVEL_KEYS:
            need(rule.get(key) is None or rule[key] in LEVELS, f"rule {n}: {key} is none of {', '.join(LEVELS)}")
        for section in _SECTIONS if rule["type"] == "naming" else ():
            part = rule.get(section)
            need(part is None or isinstance(part, dict), f"rule {n}: {section} is no mapping")
            try:
                re.compile(str((part or {}).get("pattern") or ""))
            except re.error as e:
                raise PolicyError(f"{source}: rule {n}: the pattern of {section} does not compile: {e}") from e
        for section, keys in _LISTS.items() if rule["type"] == "dependency" else ():
            entries = rule.get(section, [])
            need(isinstance(entries, list), f"rule {n}: {section} is no list")
            need(all(isinstance(e, dict) and set(keys) <= set(e) for e in entries), f"rule {n}: entries of {section} need {' and '.join(keys)}")
    return policy["rules"]


def load(path: str) -> list[dict]:
    """The rules of a YAML file."""
    import yaml

    try:
        return check(yaml.safe_load(Path(path).read_text(encoding="utf-8")), path)
    except yaml.YAMLError as e:
        raise PolicyError(f"{path}: it is no YAML: {e}") from e


def _union(parts: list[DataFrame]) -> DataFrame | None:
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out


def evaluate(model: Model, policy: list[dict]) -> DataFrame:
    """(severity, rule_type, entity, message, rule_seq) of all rules, as one plan."""
    parts = []
    for n, rule in enumerate(policy, 1):
        try:
            found = RULES[rule["type"]](model, rule)
        except (KeyError, TypeError, ValueError) as e:
            raise PolicyError(f"rule {n} ({rule['type']}): {e}") from e
        if found is not None:
            parts.append(found.withColumn("rule_seq", F.lit(n)))
    if not parts:
        return model.packages.sparkSession.createDataFrame([], "severity string, rule_type string, entity string, message string, rule_seq int")
    return _union(parts)


def ordered(violations: DataFrame, by_rule: bool = False) -> DataFrame:
    """Most severe first, then by rule; or by rule, in the order of the rules, and then most severe first."""
    if by_rule:
        return violations.orderBy("rule_seq", severity_rank(F.col("severity")), "entity", "message")
    return violations.orderBy(severity_rank(F.col("severity")), "rule_seq", "entity", "message")


