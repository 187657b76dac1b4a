"""Source trees as a Spark data source: `spark.read.format("repo_tree").load(root)`.

The driver looks at folders only until there are enough to go round; each partition walks its own
below these and reads what it finds. Where `spark.sql.python.filterPushdown.enabled` is set, path and size
filters of a query are applied before any file is read. `sources.listing` deals out folders level by
level and reads contents last, so it suits trees of any shape. The root must be on storage that all executors
mount. Options: maxdepth, hidden, gitignore, ignorefile (further ignore files' names), folders (to part the tree into, at least), maxsize (bytes).
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith

from .listing import Folder, Walk, expand, start, walk

SCHEMA = "repo_id string, path string, path_parts array<string>, abs_path string, size_bytes bigint, content binary"
NUMERIC = {GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, EqualTo: lambda a, b: a == b}
TEXTUAL = {EqualTo: lambda a, b: a == b, StringStartsWith: str.startswith, StringEndsWith: str.endswith, In: lambda a, b: a in b}


class Branch(InputPartition):
    """A folder with all below it, or files of the folders above."""

    def __init__(self, folder: Folder | None, files: list[tuple[str, int]]):
        super().__init__(None)
        self.folder = folder
        self.files = files


class RepoTreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.tests: list[tuple[str, object]] = []
        self.root = os.path.abspath(os.path.expanduser(options.get("path", "")))
        if not options.get("path") or not os.path.exists(self.root):
            raise ValueError(f"no such source tree: {options.get('path')!r}")

    def _wanted(self, path: str, size: int) -> bool:
        most = self.options.get("maxsize")
        return (most is None or size <= int(most)) and all(t(size if c == "size_bytes" else path) for c, t in self.tests)

    def _walk(self) -> Walk:
        flag = lambda k, d: self.options.get(k, d).lower() == "true"
        depth = self.options.get("maxdepth")
        return Walk(int(depth) if depth else None, flag("hidden", "false"), flag("gitignore", "true"), tuple(x for x in self.options.get("ignorefile", "").split(",") if x))

    def partitions(self) -> list[Branch]:
        if os.path.isfile(self.root):
            return [Branch(None, [(os.path.basename(self.root), os.path.getsize(self.root))])]
        options, wanted = self._walk(), int(self.options.get("folders", "64"))
        level, above = [start(self.root, options)], []
        while level and len(level) < wanted:
            found = [x for folder in level for x in expand(folder, options)]
            level = [x for x in found if isinstance(x, Folder)]
            above.append(Branch(None, [x for x in found if not isinstance(x, Folder)]))
        return [*above, *[Branch(folder, []) for folder in level]] or [Branch(None, [])]

    def read(self, partition: Branch) -> Iterator[tuple]:
        top = os.path.dirname(self.root) if os.path.isfile(self.root) else os.path.realpath(self.root)
        for path, size in walk([partition.folder], self._walk()) if partition.folder else partition.files:
            if not self._wanted(path, size):
                continue
            full = os.path.join(top, path)
            try:
                with open(full, "rb") as f:
                    data = f.read()
            except OSError:
                continue  # a file that can't be read is no row
            yield self.options.get("repo", os.path.basename(self.root)), path, path.split("/"), full, size, data


class PushingReader(RepoTreeReader):
    """For sessions that allow filter push-down to Python sources; Spark refuses such a reader elsewhere."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of size_bytes and of path are applied before files are read."""
        for f in filters:
            known = {("size_bytes",): NUMERIC, ("path",): TEXTUAL}.get(f.attribute if hasattr(f, "attribute") else ())
            if known and (test := known.get(type(f))):
                self.tests.append((f.attribute[0], lambda v, t=test, x=f.value: t(v, x)))
            else:
                yield f


class RepoTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repo_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RepoTreeReader:
        return (PushingReader if self.options.get("pushdown", "false").lower() == "true" else RepoTreeReader)(dict(self.options))


def read_tree(spark: SparkSession, root: str, **options: object) -> DataFrame:
    """FILE relation of a source tree with binary content; registers the source."""
    spark.dataSource.register(RepoTree)
    reader = spark.read.format("repo_tree").option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    for key, value in options.items():
        if value is not None:
            reader = reader.option(key, str(value).lower() if isinstance(value, bool) else str(value))
    return reader.load(root)


def git_status(spark: SparkSession, root: str) -> DataFrame:
    """(line_no, line) of `git status --porcelain -uall`, paths re-based to `root`; raises outside a work tree."""
    run = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True, text=True, check=True).stdout
    top = run("rev-parse", "--show-toplevel").strip()
    base = os.path.relpath(os.path.realpath(root), os.path.realpath(top))
    prefix = "" if base == "." else base + "/"
    rows = []
    for line in run("status", "--porcelain", "-uall").splitlines():
        if len(line) >= 4 and line[3:].split(" -> ")[-1].strip('"').startswith(prefix):
            rows.append((len(rows), line[:3] + line[3:].split(" -> ")[-1].strip('"')[len(prefix) :]))
    return spark.createDataFrame(rows, "line_no int, line string")
