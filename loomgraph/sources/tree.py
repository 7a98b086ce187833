"""Source trees as a Spark data source: spark.read.format("workspace").option("path", ...).load().

Spark's own file sources skip names that begin with an underscore or a dot, which source trees are full of. Here tasks list
directories themselves: the first levels of a tree are cut into partitions of one directory each, and every task searches
below its directory for packages and lists what they hold. The driver sees no more than the directories at which the
tree is cut. Trees lie on a local or mounted path, or on anything that Arrow has a file system for (hdfs, s3, gs, abfs), by URI.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: Directories that discovery does not enter, and markers of directories to leave out.
EXCLUDED = frozenset((
    "build", "install", "log", ".venv", "venv", "env", ".tox", ".nox", ".pytest_cache", ".mypy_cache", ".ruff_cache",
    "__pycache__", "node_modules", "dist", ".git", ".hg", ".svn",
))
STOP_MARKERS = ("COLCON_IGNORE", ".rosignore")
MANIFEST = "package.xml"
FILES = "package string, root string, rel_path string, name string, suffix string, is_dir boolean, depth int"
#: Directories at which a tree is cut, about.
CUTS = 256


class Local:
    """Directories that this machine can open."""

    def children(self, path: str) -> list[tuple[str, bool, bool]]:
        """(name, is it a directory, may it be walked into) by name. Links to directories are searched for packages and not walked."""
        with os.scandir(path) as entries:
            return sorted((e.name, e.is_dir(), not e.is_symlink()) for e in entries)

    def read(self, path: str) -> bytes:
        with open(path, "rb") as file:
            return file.read()

    def is_dir(self, path: str) -> bool:
        return os.path.isdir(path)

    def is_file(self, path: str) -> bool:
        return os.path.isfile(path)


class Remote:
    """Directories behind a URI."""

    def __init__(self, scheme: str, authority: str):
        from pyarrow import fs

        self.prefix = f"{scheme}://{authority}"
        self.fs, _ = fs.FileSystem.from_uri(f"{self.prefix}/")
        self.inside = scheme in ("hdfs", "viewfs", "file")  # there the authority is no part of the path

    def _path(self, uri: str) -> str:
        rest = uri.removeprefix(self.prefix)
        return rest or "/" if self.inside else self.prefix.partition("://")[2] + rest

    def children(self, path: str) -> list[tuple[str, bool, bool]]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(self._path(path)))
        return sorted((i.base_name, i.type == fs.FileType.Directory, True) for i in found)

    def read(self, path: str) -> bytes:
        with self.fs.open_input_stream(self._path(path)) as file:
            return file.read()

    def _type(self, path: str):
        return self.fs.get_file_info(self._path(path)).type

    def is_dir(self, path: str) -> bool:
        from pyarrow import fs

        return self._type(path) == fs.FileType.Directory

    def is_file(self, path: str) -> bool:
        from pyarrow import fs

        return self._type(path) == fs.FileType.File


@lru_cache(maxsize=16)
def _store(scheme: str, authority: str) -> Local | Remote:
    return Remote(scheme, authority) if scheme else Local()


def store(path: str) -> tuple[Local | Remote, str]:
    """What opens a path or URI, and the path as it takes it."""
    scheme, mark, rest = path.partition("://")
    if not mark:
        return _store("", ""), path
    return _store(scheme, rest.partition("/")[0]), path.rstrip("/")


def read_text(root: str, rel: str) -> str | None:
    """A file's text; None if it cannot be read."""
    files, top = store(root)
    try:
        return files.read(f"{top}/{rel}").decode("utf-8", errors="replace").replace("\r\n", "\n")
    except OSError:
        return None


@dataclass
class Part(InputPartition):
    """A directory to search, or, of a package, to walk."""

    path: str
    depth: int


def _sorted_out(files: Local | Remote, path: str) -> list[str] | None:
    """The directories below one that are to be searched; None for a package. What cannot be read or is left out has none."""
    if os.path.basename(path) in EXCLUDED:
        return []
    entries = files.children(path)
    held = {name for name, *_ in entries}
    if held.intersection(STOP_MARKERS):
        return []
    if MANIFEST in held:
        return None
    return [f"{path}/{name}" for name, is_dir, _ in entries if is_dir and not name.startswith(".") and name not in EXCLUDED]


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.files, self.root = store(options["path"].rstrip("/") or "/")
        self.path = options["path"].rstrip("/") or "/"
        self.content = options.get("content", "false").lower() == "true"
        self.suffixes: frozenset[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for one in filters:
            wanted = None
            if getattr(one, "attribute", None) == ("suffix",):
                wanted = {one.value} if isinstance(one, EqualTo) else set(one.value) if isinstance(one, In) else None
            if wanted is None:
                yield one
            else:
                self.suffixes = frozenset(wanted if self.suffixes is None else self.suffixes & wanted)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "files"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.files, _ = store(self.path)

    def partitions(self) -> list[Part]:
        waiting, parts = [Part(self.root, 0)], []
        while waiting and len(waiting) + len(parts) < CUTS:
            here = waiting.pop(0)
            try:
                below = _sorted_out(self.files, here.path)
            except OSError:
                if here.path == self.root:
                    raise
                continue
            if below is None:
                parts.append(here)
            else:
                waiting += [Part(p, here.depth + 1) for p in below]
        return parts + waiting or [Part("", 0)]

    def read(self, part: Part) -> Iterator[tuple]:
        waiting = [part] if part.path else []
        while waiting:
            here = waiting.pop()
            try:
                below = _sorted_out(self.files, here.path)
            except OSError:
                continue
            if below is None:
                yield from self._package(here)
            else:
                waiting += [Part(p, here.depth + 1) for p in reversed(below)]

    def _package(self, top: Part) -> Iterator[tuple]:
        package, folders = os.path.basename(top.path), [""]
        while folders:
            rel = folders.pop()
            try:
                entries = self.files.children(f"{top.path}/{rel}" if rel else top.path)
            except OSError:
                continue
            for name, is_dir, walked in entries:
                path = f"{rel}/{name}" if rel else name
                if is_dir and walked:
                    folders.append(path)
                suffix = os.path.splitext(name)[1]
                if self.suffixes is None or suffix in self.suffixes:
                    row = (package, top.path, path, name, suffix, is_dir, top.depth)
                    yield (*row, None if is_dir else read_text(top.path, path)) if self.content else row


class WorkspaceSource(DataSource):
    """Rows of FILES: every file and directory of every package below a path; with the option content=true the text of files too.

    Filters on suffix reach the tasks: what is not asked for is neither returned nor read.
    """

    @classmethod
    def name(cls) -> str:
        return "workspace"

    def schema(self) -> str:
        return FILES + (", text string" if self.options.get("content", "false").lower() == "true" else "")

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def load(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """The files of the packages below a path or URI. An OSError says that it cannot be listed."""
    files, top = store(path)
    files.children(top)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # else Spark refuses sources that take filters
    spark.dataSource.register(WorkspaceSource)
    return spark.read.format("workspace").option("path", path).option("content", str(content).lower()).load()
