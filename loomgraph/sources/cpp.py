"""Components and endpoints of C++ sources, by a scan of the class bodies.

Comments are blanked and string literals kept; bodies are found by matching braces, template
arguments by matching angles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import DYNAMIC, UNKNOWN
from .workspace import _parsed

SUFFIXES = (".cpp", ".cxx", ".cc", ".hpp", ".h")
_TOKEN = re.compile(r'R"(?P<mark>[^(\s]*)\((?P<raw>.*?)\)(?P=mark)"|"(?P<text>(?:[^"\\\n]|\\.)*)"|\'(?:[^\'\\\n]|\\.)+\'|//[^\n]*|/\*.*?\*/', re.S)
_CLASS = re.compile(r"\bclass\s+(?:[A-Z_]+\s+)?(\w+)\s*(?:final\s*)?:([^;{]*)\{")
#: Base classes of components.
_BASES = {"rclcpp::Node", "rclcpp::LifecycleNode", "rclcpp_lifecycle::LifecycleNode", "rclcpp_lifecycle::Node"}
_QUALIFIED = re.compile(r"\w+(?:\s*::\s*\w+)*")
_CALL = re.compile(r"(?:\brclcpp_action::(?P<free>create_server|create_client)|\b(?P<member>create_\w+))\s*(?=[<(])")
_ROLES = {
    "create_publisher": "publishes", "create_subscription": "subscribes", "create_service": "provides", "create_client": "calls",
    "create_action_server": "serves", "create_action_client": "requests",
}
_FREE = {"create_server": "serves", "create_client": "requests"}


def _plain(text: str) -> tuple[str, dict[int, str]]:
    """The text with comments and literals blanked, at equal length, and the string literals by their place."""
    literals: dict[int, str] = {}

    def blank(m: re.Match) -> str:
        if m["text"] is not None or m["raw"] is not None:
            literals[m.start()] = m["raw"] if m["raw"] is not None else m["text"]
        return re.sub(r"[^\n]", " ", m[0])

    return _TOKEN.sub(blank, text), literals


def _close(text: str, at: int, left: str, right: str) -> int:
    """The place after the bracket that closes the one at `at`."""
    depth = 0
    for m in re.compile(f"[{re.escape(left + right)}]").finditer(text, at):
        depth += 1 if m[0] == left else -1
        if not depth:
            return m.end()
    return len(text)


def _type(raw: str) -> str:
    depth, first = 0, []
    for c in raw:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            break
        first.append(c)
    parts = [p.strip() for p in "".join(first).split("::") if p.strip()]
    for kind in ("msg", "srv", "action"):
        if kind in parts[1:-1]:
            return f"{parts[parts.index(kind, 1) - 1]}/{parts[-1]}"
    return parts[-1] if parts else UNKNOWN


def _parse(text: str, rel: str, package: str) -> Iterator[tuple]:
    code, literals = _plain(text)
    for cls in _CLASS.finditer(code):
        if not any(re.sub(r"\s", "", m[0]) in _BASES for m in _QUALIFIED.finditer(cls[2])):
            continue
        start, end = cls.end() - 1, _close(code, cls.end() - 1, "{", "}")
        yield package, cls[1], None, None, None, rel, code.count("\n", 0, cls.start()) + 1, None
        for call in _CALL.finditer(code, start, end):
            role = _FREE[call["free"]] if call["free"] else _ROLES.get(call["member"])
            if not role:
                continue
            at, kind = call.end(), UNKNOWN
            if code[at] == "<":
                at = _close(code, at, "<", ">")
                kind = _type(code[call.end() + 1 : at - 1])
            if at >= end or not code[at:end].lstrip().startswith("("):
                continue
            stop = _close(code, at, "(", ")")
            name = next((text for place, text in sorted(literals.items()) if at < place < stop), DYNAMIC)
            yield package, cls[1], role, name, kind, rel, code.count("\n", 0, call.start()) + 1, "rclcpp_action" if call["free"] else call["member"]


def cpp_records(listing: DataFrame) -> DataFrame:
    """A row for each component class (role null) and each of its endpoints."""
    return cpp_texts(listing.filter(F.col("suffix").isin(*SUFFIXES) & ~F.col("is_dir")))


def cpp_texts(rows: DataFrame) -> DataFrame:
    """The same of C++ files: (root, rel_path, package), or (text, rel_path, package)."""
    names = ["package", "component", "role", "name", "msg_type", "file_path", "line", "evidence"]
    schema = "package string, component string, role string, name string, msg_type string, file_path string, line long, evidence string"
    return _parsed(rows, _parse, schema, names)
