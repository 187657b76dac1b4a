"""Listing source trees on the executors: a frontier of folders, expanded round by round.

Each folder of the frontier is a row that carries the ignore rules in force; a task scans it and a bounded number of
folders below, and emits the files and the folders that are left, these with the rules that they inherit. A round is stored, its folders are
dealt anew over all cores for the next one, and the driver only learns whether there are any. So
neither a list of files nor one of folders ever stands on the driver, and a lost executor costs the
folders it was scanning. Contents are read afterwards, for the rows that filters on path, size and a
change set have left.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import staged
from .ignore import EXCLUDE, GIT, OWN, PLAIN, USER, Rule, Rules

#: Folders that are scanned for one of the frontier before the rest is dealt out anew.
FOLDERS = 256
META = "repo_id string, path string, path_parts array<string>, abs_path string, size_bytes bigint"
RULE = pa.struct([("kind", pa.int32()), ("folder", pa.string()), ("regex", pa.string()), ("negated", pa.bool_()), ("folders", pa.bool_())])
ENTRY = pa.schema([("repo_id", pa.string()), ("root", pa.string()), ("top", pa.string()), ("base", pa.string()), ("folder", pa.string()), ("depth", pa.int32()), ("size", pa.int64()), ("rules", pa.list_(RULE))])
ENTRY_DDL = "repo_id string, root string, top string, base string, folder string, depth int, size long, rules array<struct<kind:int,folder:string,regex:string,negated:boolean,folders:boolean>>"


@dataclass(frozen=True)
class Walk:
    """What a walk takes in: max_depth components, hidden names or not, git's and plain ignore files or not, further ignore files by name."""

    max_depth: int | None = None
    hidden: bool = False
    gitignore: bool = True
    ignore_names: tuple[str, ...] = field(default=())


@dataclass(frozen=True)
class Folder:
    """A folder to be scanned: `path` below `root`. Rules are relative to `top`, the work tree's top, and `base` is root below top."""

    root: str
    top: str
    base: str
    path: str
    depth: int
    rules: Rules

    def names(self, options: Walk) -> dict[str, int]:
        tracked = {".gitignore": GIT} if options.gitignore and os.path.exists(os.path.join(self.top, ".git")) else {}
        return tracked | ({".ignore": PLAIN} if options.gitignore else {}) | dict.fromkeys(options.ignore_names, OWN)


def start(root: str, options: Walk) -> Folder:
    """The root folder, with the rules of all folders above it.

    Git's rules count inside a work tree only: the user's, the tree's own excludes, and ignore files from its top down.
    """
    root = os.path.realpath(root)
    top = root
    while options.gitignore and not os.path.exists(os.path.join(top, ".git")) and os.path.dirname(top) != top:
        top = os.path.dirname(top)
    tracked = options.gitignore and os.path.exists(os.path.join(top, ".git"))
    top = top if tracked else root
    rules = Rules()
    if tracked:
        home = os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config")
        rules = rules.read(os.path.join(home, "git", "ignore"), "", USER).read(os.path.join(top, ".git", "info", "exclude"), "", EXCLUDE)
    base = "" if top == root else os.path.relpath(root, top)
    found = Folder(root, top, base, "", 0, rules)
    above = base.split("/") if base else []
    for k in range(len(above)):
        rules = rules.below("/".join(above[:k]), top, found.names(options))
    return Folder(root, top, base, "", 0, rules)


def expand(folder: Folder, options: Walk) -> Iterator[Folder | tuple[str, int]]:
    """One folder's sub-folders and (path, size) of its regular files, by name; what a rule ignores is left out. An unreadable folder is empty."""
    rules = folder.rules.below("/".join(x for x in (folder.base, folder.path) if x), folder.top, folder.names(options))
    if options.max_depth is not None and folder.depth >= options.max_depth:
        return
    try:
        entries = sorted(os.scandir(os.path.join(folder.root, folder.path)), key=lambda e: e.name)
    except OSError:
        return
    for e in entries:
        path = f"{folder.path}/{e.name}" if folder.path else e.name
        if not options.hidden and e.name.startswith("."):
            continue
        try:
            is_folder, is_file = e.is_dir(follow_symlinks=False), e.is_file(follow_symlinks=False)
            if rules.ignored(f"{folder.base}/{path}" if folder.base else path, is_folder):
                continue
            if is_folder:
                yield Folder(folder.root, folder.top, folder.base, path, folder.depth + 1, rules)
            elif is_file:
                yield path, e.stat().st_size
        except OSError:
            continue


def walk(folders: Iterable[Folder], options: Walk) -> Iterator[tuple[str, int]]:
    """(path, size) of all files below the folders, in one process."""
    todo = list(folders)
    while todo:
        for found in expand(todo.pop(), options):
            if isinstance(found, Folder):
                todo.append(found)
            else:
                yield found


def _entries(rows: Iterable[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(ENTRY)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ENTRY, strict=True)], schema=ENTRY)


def _level(frontier: DataFrame, options: Walk, most: int) -> DataFrame:
    """ENTRY rows of one round: files have a size, folders that are left have rules. The frontier's roots come as rows without a depth."""

    def scanned(batch: pa.RecordBatch) -> Iterator[tuple]:
        for row in batch.to_pylist():
            if row["depth"] is None:
                try:
                    if os.path.isfile(row["root"]):
                        yield row["repo_id"], os.path.dirname(row["root"]), "", "", os.path.basename(row["root"]), 1, os.path.getsize(row["root"]), None
                        continue
                except OSError:
                    continue
                folder = start(row["root"], options)
            else:
                folder = Folder(row["root"], row["top"], row["base"], row["folder"], row["depth"], Rules(tuple(Rule(**r) for r in row["rules"])))
            todo = deque([folder])
            for _ in range(most):
                if not todo:
                    break
                own = todo.popleft()
                for found in expand(own, options):
                    if isinstance(found, Folder):
                        todo.append(found)
                    else:
                        yield row["repo_id"], own.root, own.top, own.base, found[0], own.depth + 1, found[1], None
            for left in todo:
                yield row["repo_id"], left.root, left.top, left.base, left.path, left.depth, None, [r._asdict() for r in left.rules.rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in scanned(batch):
                held.append(row)
                if len(held) >= 4096:
                    yield _entries(held)
                    held = []
        yield _entries(held)

    return frontier.mapInArrow(run, ENTRY_DDL)


def list_trees(roots: DataFrame, options: Walk | None = None, most: int = FOLDERS) -> DataFrame:
    """META rows of all regular files below the roots, of (repo_id, root): folders or single files on storage that all executors mount.

    A root that doesn't exist gives no row; ignored folders are never entered. In each round every folder of the frontier is scanned
    with up to `most` - 1 folders below it, breadth first, so a small tree takes one round.
    """
    options = options or Walk()
    cores = roots.sparkSession.sparkContext.defaultParallelism
    blank = [F.lit(None).cast(kind).alias(name) for name, kind in (("top", "string"), ("base", "string"), ("folder", "string"), ("depth", "int"), ("size", "long"))]
    frontier = roots.select("repo_id", "root", *blank, F.lit(None).cast(ENTRY_DDL.rsplit(" ", 1)[1]).alias("rules"))
    levels: list[DataFrame] = []
    while True:
        level = staged(_level(frontier.repartition(cores), options, most), "tree-level")
        levels.append(level.filter("size IS NOT NULL"))
        frontier = level.filter("size IS NULL")
        if frontier.isEmpty():
            break
    files = reduce(DataFrame.unionAll, levels)
    return files.select("repo_id", F.col("folder").alias("path"), F.split("folder", "/").alias("path_parts"), F.concat_ws("/", F.rtrim(F.col("root"), F.lit("/")), "folder").alias("abs_path"), F.col("size").alias("size_bytes"))


def list_tree(spark: SparkSession, root: str, options: Walk | None = None, repo: str | None = None) -> DataFrame:
    """META rows of one tree, or of a single file; a root that doesn't exist is an error."""
    full = os.path.abspath(os.path.expanduser(root))
    if not root or not os.path.exists(full):
        raise ValueError(f"no such source tree: {root!r}")
    return list_trees(spark.createDataFrame([(repo or os.path.basename(full), full)], "repo_id string, root string"), options)


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def with_contents(meta: DataFrame, read: Callable[[str], bytes] = _read) -> DataFrame:
    """META rows with their content as binary; a file that can't be read is no row.

    Files are opened here and nowhere before, whatever push-down the session allows: filter first. Rows
    are dealt over all cores by path, so that one folder of large files isn't one task's work.
    """
    names = [f.name for f in meta.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, path in enumerate(batch.column("abs_path").to_pylist()):  # one file at a time: a batch of contents has no bound
                try:
                    data = read(path)
                except (OSError, TypeError):
                    continue
                yield pa.RecordBatch.from_arrays([*[c.slice(k, 1) for c in batch.columns], pa.array([data], pa.binary())], names=[*names, "content"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in meta.schema)
    spark = meta.sparkSession
    return meta.repartition(spark.sparkContext.defaultParallelism * 4, "abs_path").mapInArrow(run, f"{ddl}, content binary")
