"""Source trees as tables: files are listed by the data source of tree.py, and read and parsed by the tasks, one row for each file."""

from __future__ import annotations

import ast
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import tree_digests
from . import tree
from .tree import store

def workspace_root(start: str) -> str:
    """The nearest directory, start or above it, with src/ or install/setup.bash; start itself where there is none. A path, or a URI."""
    files, here = store(start if "://" in start else str(Path(start).resolve()))
    top, at = here, here
    while True:
        try:
            files.children(at)
            if files.is_dir(f"{at}/src") or files.is_file(f"{at}/install/setup.bash"):
                return at
        except PermissionError:
            if at == top:
                raise
            break
        except (FileNotFoundError, NotADirectoryError):
            pass
        above = at.rpartition("/")[0]
        if above == at or above.endswith(":/") or not above.strip("/"):
            break
        at = above
    print(f"no workspace at or above {start}; it is taken as one", file=sys.stderr)
    return here


def source_root(root: str) -> str:
    """The src/ directory of a workspace, if it has one and is not one."""
    files, top = store(root)
    return f"{top}/src" if top.rpartition("/")[2] != "src" and files.is_dir(f"{top}/src") else root


def files(spark: SparkSession, root: str) -> DataFrame:
    """A row for each file and directory of each package below root, with seq, the order in which packages are found: by depth, then by path."""
    listed = tree.load(spark, root)
    return listed.withColumn("seq", F.struct("depth", F.split("root", "/").alias("at"))).drop("depth")


def _parsed(rows: DataFrame, parse, schema: str, columns: list[str]) -> DataFrame:
    """What parse(text, rel_path, package) gives for each file.

    rows: (root, rel_path, package) of files that the tasks read, or (text, rel_path, package). An unreadable file has no text.
    """
    stored = "text" in rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"] if stored else (tree.read_text(root, rel) for root, rel in zip(batch["root"], batch["rel_path"], strict=True))
            out = [r for text, rel, package in zip(texts, batch["rel_path"], batch["package"], strict=True) if text is not None for r in parse(text, rel, package)]
            yield pd.DataFrame(out, columns=columns)

    return rows.select("text" if stored else "root", "rel_path", "package").mapInPandas(run, schema)


#: Dependency tags of a manifest and the build types that are known.
DEPENDENCY_TAGS = {"depend": "depend", "build_depend": "build", "exec_depend": "exec", "test_depend": "test", "build_export_depend": "build_export"}
BUILD_TYPES = ("ament_cmake", "ament_python", "cmake", "python")

_MANIFEST = (
    "name array<string>, version array<string>, description array<string>, license array<string>, "
    "maintainer array<struct<_VALUE: string, _email: string>>, "
    + "".join(f"{tag} array<string>, " for tag in DEPENDENCY_TAGS)
    + "export array<struct<build_type: array<string>, metapackage: array<string>>>, broken string"
)


def _manifests(texts: DataFrame) -> DataFrame:
    """Adds m, the manifest as a struct; m.broken is the text where it is no XML. texts: with a column text."""
    return texts.withColumn("m", F.from_xml("text", _MANIFEST, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken", "ignoreSurroundingSpaces": "true"}))


def _first(tag: str) -> Column:
    return F.nullif(F.btrim(F.get(F.col(f"m.{tag}"), F.lit(0))), F.lit(""))


def package_records(texts: DataFrame) -> DataFrame:
    """(name, version, package_type, maintainers, license, description, path, deps) of manifests (text, root, package); broken ones are left out."""
    read = _manifests(texts).filter("m.broken IS NULL")
    dep = lambda tag: F.transform(
        F.filter(F.coalesce(F.col(f"m.{tag}"), F.array().cast("array<string>")), lambda x: F.length(F.btrim(x)) > 0),
        lambda x: F.struct(F.lit(DEPENDENCY_TAGS[tag]).alias("dep_type"), F.btrim(x).alias("dep_name")),
    )
    deps = F.concat(*(dep(tag) for tag in DEPENDENCY_TAGS))
    # the first export that says anything decides; a metapackage mark goes before a build type
    said = F.expr("get(filter(coalesce(m.export, array()), e -> e.metapackage IS NOT NULL OR exists(e.build_type, t -> length(t) > 0)), 0)")
    built = F.expr("btrim(get(filter(_said.build_type, t -> length(t) > 0), 0))")
    needed = F.expr("transform(filter(_deps, d -> d.dep_type = 'build'), d -> d.dep_name)")
    kind = (
        F.when(F.col("_said.metapackage").isNotNull(), "meta")
        .when(F.col("_said").isNotNull(), F.when(built.isin(*BUILD_TYPES), built).otherwise("unknown"))
        .when(F.array_contains(needed, "ament_cmake"), "ament_cmake").when(F.array_contains(needed, "ament_python"), "ament_python").otherwise("unknown")
    )
    people = F.expr("transform(filter(coalesce(m.maintainer, array()), p -> length(p._VALUE) > 0), p -> concat(p._VALUE, ' <', coalesce(p._email, ''), '>'))")
    return read.withColumns({"_deps": deps, "_said": said}).select(
        F.coalesce(_first("name"), "package").alias("name"), F.coalesce(_first("version"), F.lit("0.0.0")).alias("version"), kind.alias("package_type"),
        people.alias("maintainers"), _first("license").alias("license"), _first("description").alias("description"), F.col("root").alias("path"),
        F.col("_deps").alias("deps"),
    )


def _listed_manifests(listing: DataFrame) -> DataFrame:
    own = listing.filter("rel_path = 'package.xml' AND NOT is_dir")
    return own.join(contents(own), ["root", "rel_path"]).select("root", "rel_path", "package", "text")


def packages(listing: DataFrame) -> DataFrame:
    return package_records(_listed_manifests(listing))


def broken_manifests(listing: DataFrame) -> DataFrame:
    """Diagnostics (severity, code, message, file, entity) of manifests that are no XML."""
    return _manifests(_listed_manifests(listing)).filter("m.broken IS NOT NULL").select(
        F.lit("warning").alias("severity"), F.lit("manifest_unreadable").alias("code"), F.lit("the manifest is left out").alias("message"),
        F.concat("root", F.lit("/"), "rel_path").alias("file"), F.col("package").alias("entity"),
    )


def package_deps(pkgs: DataFrame) -> DataFrame:
    """(src, dst, dep_type) between packages of the workspace."""
    rows = pkgs.select(F.col("name").alias("src"), F.explode("deps").alias("d")).select("src", F.col("d.dep_name").alias("dst"), F.col("d.dep_type").alias("dep_type"))
    return rows.join(pkgs.select(F.col("name").alias("dst")), "dst", "left_semi").select("src", "dst", "dep_type")


def field_lines(text: Column) -> Column:
    """Lines of an interface file, stripped, without blanks, comments and separators."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r")))
    return F.filter(lines, lambda x: (x != "") & (x != "---") & ~x.startswith("#"))


INTERFACE_KINDS = {".msg": "msg", ".srv": "srv", ".action": "action"}


def contents(listing: DataFrame) -> DataFrame:
    """(root, rel_path, text) of files; an unreadable one is empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(text=[tree.read_text(root, rel) or "" for root, rel in zip(batch["root"], batch["rel_path"], strict=True)])

    return listing.filter("NOT is_dir").select("root", "rel_path").mapInPandas(run, "root string, rel_path string, text string")


def interfaces(listing: DataFrame) -> DataFrame:
    """(package, name, kind, fields, file_path, seq) of interface files."""
    own = listing.filter(F.col("suffix").isin(*INTERFACE_KINDS) & ~F.col("is_dir"))
    kind = F.substring_index("name", ".", -1)
    return own.join(contents(own), ["root", "rel_path"]).select(
        "package", F.expr("substring(name, 1, length(name) - length(suffix))").alias("name"), kind.alias("kind"),
        field_lines(F.col("text")).alias("fields"), F.col("rel_path").alias("file_path"), F.struct("seq", "rel_path").alias("seq"),
    )


#: Fixed spellings of a readme.
READMES = ("README.md", "README.rst", "README.txt", "README")


def facts(listing: DataFrame) -> DataFrame:
    """(package, has_readme, has_test_dir, has_launch_files) from the names alone."""
    path = F.col("rel_path")
    return listing.groupBy("package").agg(
        F.max(path.isin(*READMES) & ~F.col("is_dir")).alias("has_readme"), F.max(path.startswith("test/")).alias("has_test_dir"),
        F.max(path.isin("launch", "bringup/launch") & F.col("is_dir")).alias("has_launch_files"),
    )


def fingerprints(listing: DataFrame) -> DataFrame:
    """(package, fingerprint): SHA-256 over the relative paths and contents of all files that are parsed, in path order."""
    parsed = listing.filter(F.col("suffix").isin(*PARSED) & ~F.col("is_dir"))
    return fingerprints_of(parsed.join(contents(parsed), ["root", "rel_path"]))


def fingerprints_of(texts: DataFrame) -> DataFrame:
    """The same over (package, rel_path, text): a tree of digests over a line of path and digest for each file, so a package has any size."""
    each = texts.select("package", "rel_path", F.sha2("text", 256).alias("digest"))
    return tree_digests(each, ["package"], "rel_path", F.concat("rel_path", F.lit(" "), "digest"))


#: Suffixes of parsed files, base classes of components, and the calls that declare endpoints:
#: (role, place of the name, place of the type, keywords of the name).
PARSED = (".py", ".cpp", ".cxx", ".cc", ".hpp", ".h", ".msg", ".srv", ".action", ".xml", ".yaml", ".yml")
_BASES = ("Node", "rclpy.node.Node", "LifecycleNode", "rclpy_lifecycle.LifecycleNode")
_CALLS = {
    "create_publisher": ("publishes", 1, 0, ("topic",)), "create_subscription": ("subscribes", 1, 0, ("topic",)),
    "create_service": ("provides", 1, 0, ("srv_name", "service_name")), "create_client": ("calls", 1, 0, ("srv_name", "service_name")),
    "create_action_server": ("serves", 1, 0, ("action_name",)), "create_action_client": ("requests", 1, 0, ("action_name",)),
    "ActionServer": ("serves", 2, 1, ("action_name",)), "ActionClient": ("requests", 2, 1, ("action_name",)),
}


@dataclass
class _Scope:
    """A component class that is being read: its constants so far, its own name and what it declares."""

    name: str
    line: int
    constants: dict[str, str]
    endpoints: list[tuple] = field(default_factory=list)


def _constant(node: ast.expr) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def _own(node: ast.expr) -> str | None:
    """x of self.x."""
    return node.attr if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and node.value.id == "self" else None


def _assigned(node: ast.Assign, key) -> dict[str, str]:
    """The string that an assignment gives to each target that key() names."""
    value = _constant(node.value)
    return {} if value is None else {key(t): value for t in node.targets if key(t)}


def _python(text: str, rel: str, package: str) -> list[tuple]:
    """A component row for each component class, inner ones before the class around them, and its endpoints behind it.

    Code is walked in order. A name is a literal, or self.x or a bare x whose string the class body or
    an assignment to self.x has given before; a class inside another has names of its own.
    """
    types: dict[str, str] = {}
    done: list[_Scope] = []

    def name_of(call: ast.Call, at: int, keywords: tuple[str, ...], known: dict[str, str]) -> str:
        value = call.args[at] if len(call.args) > at else next((k.value for k in call.keywords if k.arg in keywords), None)
        said = _constant(value) if value is not None else None
        return said if said is not None else known.get(_own(value) or getattr(value, "id", ""), "<dynamic>")

    def walk(node: ast.AST, scope: _Scope | None) -> None:
        if isinstance(node, ast.ImportFrom):
            mark = next((m for m in (".msg", ".srv", ".action") if m in (node.module or "")), None)
            if mark:
                types.update({a.asname or a.name: f"{node.module.partition(mark)[0]}/{a.name}" for a in node.names})
        elif isinstance(node, ast.ClassDef) and any(ast.unparse(b) in _BASES for b in node.bases):
            inner = _Scope(node.name, node.lineno, {})
            for said in (n for n in node.body if isinstance(n, ast.Assign)):
                inner.constants |= _assigned(said, lambda t: getattr(t, "id", None))
            for child in ast.iter_child_nodes(node):
                walk(child, inner)
            done.append(inner)
            return
        elif scope and isinstance(node, ast.Assign):
            scope.constants |= _assigned(node, _own)
        elif scope and isinstance(node, ast.Call):
            called = node.func.attr if isinstance(node.func, ast.Attribute) else getattr(node.func, "id", "")
            if called in _CALLS:
                role, at, kind_at, keywords = _CALLS[called]
                scope.endpoints.append((role, name_of(node, at, keywords, scope.constants), _type_of(node.args[kind_at : kind_at + 1], types), rel, node.lineno, called))
        for child in ast.iter_child_nodes(node):
            walk(child, scope)

    try:
        walk(ast.parse(text), None)
    except (SyntaxError, ValueError, RecursionError):
        return []  # what Python cannot read declares nothing
    rows = []
    for scope in done:
        rows.append((package, scope.name, None, None, None, rel, scope.line, None))
        rows += [(package, scope.name, *e) for e in scope.endpoints]
    return rows


def _type_of(arg: list[ast.expr], types: dict[str, str]) -> str:
    """An imported alias, or package/Type around msg, srv or action in a dotted name, or the dotted name itself."""
    if not arg or not isinstance(arg[0], ast.Name | ast.Attribute):
        return "unknown"
    text = ast.unparse(arg[0])
    parts = text.split(".")
    for kind in ("msg", "srv", "action"):
        if kind in parts[1:-1]:
            return f"{parts[parts.index(kind, 1) - 1]}/{parts[-1]}"
    return types.get(text, text)


def python_records(listing: DataFrame) -> DataFrame:
    """A row for each component class of the Python files (role null) and each of its endpoints."""
    return python_texts(listing.filter("suffix = '.py' AND NOT is_dir"))


def python_texts(rows: DataFrame) -> DataFrame:
    """The same of Python files: (root, rel_path, package), or (text, rel_path, package)."""
    names = ["package", "component", "role", "name", "msg_type", "file_path", "line", "evidence"]
    schema = "package string, component string, role string, name string, msg_type string, file_path string, line long, evidence string"
    return _parsed(rows, _python, schema, names)
