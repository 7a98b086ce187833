"""Names of components, topics and packages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DYNAMIC = "<dynamic>"
UNKNOWN = "unknown"
UNSET = "<unknown>"


def last_segment(name: Column) -> Column:
    """The lower-cased last part of a slash-separated name."""
    return F.lower(F.element_at(F.split(F.ltrim(name, F.lit("/")), "/"), -1))


def snake_symbol(name: Column) -> Column:
    """CamelCase to lower snake case, one underscore before each capital that follows a letter or digit."""
    split = F.regexp_replace(name, r"(?<=[\p{L}\p{N}])(\p{Lu})", "_$1")
    return F.btrim(F.lower(F.regexp_replace(split, r"[^\p{L}\p{N}]", "_")), F.lit("_"))


def remapped(name: Column, remaps: Column) -> Column:
    """The name after a remap table: as it is, or with its leading slash toggled."""
    toggled = F.when(name.startswith("/"), F.substring(name, 2, 1 << 30)).otherwise(F.concat(F.lit("/"), name))
    return F.coalesce(F.try_element_at(remaps, name), F.try_element_at(remaps, toggled), name)


def in_namespace(name: Column, namespace: Column) -> Column:
    """A relative name put under a namespace; absolute and unresolved names stay."""
    unset = namespace.isNull() | namespace.isin("", UNSET) | name.startswith("/") | (name == DYNAMIC)
    joined = F.concat(F.lit("/"), F.btrim(namespace, F.lit("/")), F.lit("/"), name)
    return F.when(unset, name).otherwise(F.regexp_replace(joined, "^//+", "/"))


def slug(vertex: Column) -> Column:
    """An identifier for diagrams: non-word characters replaced, with a short digest of the id."""
    return F.concat(F.regexp_replace(vertex, r"\W", "_"), F.lit("_"), F.substring(F.sha1(vertex), 1, 8))


def severity(raw: Column) -> Column:
    low = F.lower(raw)
    return F.when(low.isin("error", "warning", "info"), low).otherwise("warning")


def severity_rank(level: Column) -> Column:
    return F.when(level == "error", 0).when(level == "warning", 1).otherwise(2)


def health_bar(score: Column) -> Column:
    filled = F.greatest(F.lit(0), F.least(F.lit(10), F.bround(score / 10).cast("int")))
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(10) - filled))


def health_colour(score: Column) -> Column:
    return F.when(score >= 70, "green").when(score >= 40, "yellow").otherwise("red")


def has_email(maintainers: Column) -> Column:
    return F.exists(maintainers, lambda m: m.contains("<") & m.contains("@"))


def short_label(kind: Column, name: Column) -> Column:
    """A vertex's label: of a topic, service or action with more than two parts the last two, with the leading slash of an absolute name."""
    parts = F.split(F.ltrim(name, F.lit("/")), "/")
    tail = F.concat(F.when(name.startswith("/"), "/").otherwise(""), F.array_join(F.slice(parts, -2, 2), "/"))
    return F.when(kind.isin("Topic", "Service", "Action") & (F.size(parts) > 2), tail).otherwise(name)
