"""Launch files in Python, XML and YAML as tables of launch nodes, includes and unresolved files."""

from __future__ import annotations

import ast
import os
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import DYNAMIC, UNSET
from .workspace import _parsed

SUFFIXES = (".py", ".xml", ".yaml", ".yml")
_NAMES = ["kind", "owner_package", "executable", "package", "name", "remaps", "namespace", "target", "file_path", "place"]
_SCHEMA = (
    "kind string, owner_package string, executable string, package string, name string, remaps map<string,string>, "
    "namespace string, target string, file_path string, place long"
)


def launch_files(listing: DataFrame) -> DataFrame:
    """Files whose stem ends in .launch, and all of the suffixes in the launch or bringup directory of a package."""
    stem = F.expr("substring(name, 1, length(name) - length(suffix))")
    inside = F.col("rel_path").rlike("^(launch|bringup)/")
    return listing.filter(F.col("suffix").isin(*SUFFIXES) & ~F.col("is_dir") & (F.endswith(stem, F.lit(".launch")) | inside))


def _literal(node: ast.expr | None) -> str:
    if node is None:
        return UNSET
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else DYNAMIC


def _from_python(text: str) -> Iterator[tuple]:
    calls = [n for n in ast.walk(ast.parse(text)) if isinstance(n, ast.Call)]
    for call in sorted(calls, key=lambda n: (n.lineno, n.col_offset)):
        called = ast.unparse(call.func)
        given = {k.arg: k.value for k in call.keywords}
        if called in ("Node", "launch_ros.actions.Node"):
            listed = given.get("remappings")
            pairs = [
                (_literal(e.elts[0]), _literal(e.elts[1]))
                for e in (listed.elts if isinstance(listed, ast.List) else []) if isinstance(e, ast.Tuple) and len(e.elts) == 2
            ]
            yield "node", *(_literal(given.get(k)) for k in ("executable", "package", "name")), {a: b for a, b in pairs if a and b}, _literal(given.get("namespace")), None
        elif called.split(".")[-1] == "IncludeLaunchDescription":
            target = call.args[0] if call.args else given.get("launch_description_source")
            if target is not None:
                yield "include", None, None, None, None, None, _literal(target)
        elif called.split(".")[-1] == "OpaqueFunction":
            yield "unresolved", None, None, None, None, None, None


def _from_xml(text: str) -> Iterator[tuple]:
    for e in ET.fromstring(text).iter():
        if e.tag == "node":
            remaps = {r.get("from"): r.get("to") for r in e.findall("remap") if r.get("from") and r.get("to")}
            yield "node", e.get("exec") or e.get("type") or UNSET, e.get("pkg") or UNSET, e.get("name"), remaps, e.get("ns"), None
        elif e.tag == "include" and e.get("file"):
            yield "include", None, None, None, None, None, e.get("file")


#: What a YAML launch file holds below its key "launch": lists of entries, of which those with "node" declare one.
_NODE_KEYS = ("executable", "package", "name")


def _from_yaml(text: str) -> Iterator[tuple]:
    """Launch nodes of a mapping with a list "launch"; any other document, as a file of parameters is, declares nothing."""
    import yaml

    document = yaml.safe_load(text)
    listed = document.get("launch", ()) if isinstance(document, dict) else ()
    for node in (entry["node"] for entry in listed if isinstance(entry, dict) and entry.get("node")):
        executable, package, name = (node.get(key) for key in _NODE_KEYS)
        yield "node", executable or UNSET, package or UNSET, name, {}, None, None


def _parse(text: str, rel: str, owner: str) -> Iterator[tuple]:
    read = {".py": _from_python, ".xml": _from_xml}.get(os.path.splitext(rel)[1].lower(), _from_yaml)
    try:
        found = list(read(text))
    except Exception:  # whatever is wrong with a file of a user, it is reported as unresolved
        found = [("unresolved", None, None, None, None, None, None)]
    for place, (kind, executable, package, name, remaps, namespace, target) in enumerate(found):
        yield kind, owner, executable, package, name, remaps, namespace, target, rel, place


def launch_records(listing: DataFrame) -> DataFrame:
    return launch_texts(launch_files(listing))


def launch_texts(rows: DataFrame) -> DataFrame:
    """The same of launch files: (root, rel_path, package), or (text, rel_path, package); the suffix tells the language."""
    return _parsed(rows, _parse, _SCHEMA, _NAMES).withColumn("seq", F.struct("file_path", "place"))


def launch_nodes(records: DataFrame) -> DataFrame:
    return records.filter("kind = 'node'").select("owner_package", "executable", "package", "name", "remaps", "namespace", F.col("file_path").alias("source_file"), "seq")


def launch_includes(records: DataFrame) -> DataFrame:
    return records.filter("kind = 'include'").select("owner_package", F.col("file_path").alias("source_file"), F.col("target").alias("target_file"))


def unresolved(records: DataFrame) -> DataFrame:
    """Diagnostics (severity, code, message, file, entity) of files that cannot be read through."""
    none = F.lit(None).cast("string")
    return records.filter("kind = 'unresolved'").select("file_path", "owner_package").distinct().select(
        F.lit("warning").alias("severity"), F.lit("launch_unresolved").alias("code"),
        F.concat(F.lit("not all of "), "file_path", F.lit(" can be read without running it")).alias("message"), F.col("file_path").alias("file"), none.alias("entity"),
    )
