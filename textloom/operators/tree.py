"""Directory trees as relations: nodes from exploded path prefixes, totals by node, order, rendering."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .order import before, ranged, same_keys


def prefixes(parts: Column) -> Column:
    """All prefixes of a path, the whole one included."""
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.slice(parts, 1, i))


def nodes(files: DataFrame, repo: str = "repo_id", selected: str | None = None) -> DataFrame:
    """NODE relation with totals: files, tokens, bytes (and the same of selected files).

    Tokens not counted are estimated as a quarter of the bytes, rounded up. Empty and `.` paths
    have no node. One shuffle: prefixes are pre-aggregated by (repo, node).
    """
    tok = F.coalesce(F.col("token_count"), F.ceil(F.col("size_bytes") / F.lit(4)).cast("bigint"))
    on = F.coalesce(F.col(selected), F.lit(False)) if selected else F.lit(False)
    rows = files.filter(~F.col("path").isin("", ".")).select(
        repo, F.col("path_parts").alias("file"), tok.alias("tok"), F.col("size_bytes").alias("byt"), on.alias("sel"), F.explode(prefixes(F.col("path_parts"))).alias("node")
    )
    out = rows.groupBy(repo, "node").agg(
        F.bool_or(F.col("node") == F.col("file")).alias("is_file"),
        F.count("*").alias("files"), F.sum("tok").alias("tokens"), F.sum("byt").alias("bytes"),
        F.sum(F.when(F.col("sel"), 1).otherwise(0)).cast("bigint").alias("sel_files"), F.sum(F.when(F.col("sel"), F.col("tok")).otherwise(0)).alias("sel_tokens"), F.sum(F.when(F.col("sel"), F.col("byt")).otherwise(0)).alias("sel_bytes"),
    )
    out = out.withColumn("depth", F.size("node"))
    return out if selected else out.drop("sel_files", "sel_tokens", "sel_bytes")


def rollup(files: DataFrame, repo: str = "repo_id") -> DataFrame:
    """(repo, dir, files, tokens, bytes) for every directory and '' for the whole repository."""
    n = nodes(files, repo).filter("files > 0")
    dirs = n.filter(~F.col("is_file")).select(repo, F.array_join("node", "/").alias("dir"), "files", "tokens", "bytes")
    top = n.filter("depth = 1").groupBy(repo).agg(F.sum("files").alias("files"), F.sum("tokens").alias("tokens"), F.sum("bytes").alias("bytes")).select(repo, F.lit("").alias("dir"), "files", "tokens", "bytes")
    return dirs.unionByName(top)


def tri_state(n: DataFrame) -> DataFrame:
    """Adds state: none, partial or all of a node's files are selected."""
    return n.withColumn("state", F.when(F.col("sel_files") == 0, "none").when(F.col("sel_files") == F.col("files"), "all").otherwise("partial"))


def flat(n: DataFrame, repo: str = "repo_id") -> DataFrame:
    """Pre-order with directories before files: adds idx (from 0), subtree_end and parent (null at the top).

    A node's place is the sum of what stands before it and each of its ancestors among their siblings, and
    one for each ancestor. Siblings are summed up in ranges, so neither a repository nor a directory is sorted by one task.
    """
    own = n.withColumn("up", F.slice("node", 1, F.col("depth") - 1))
    # a node's subtree has as many nodes as there are paths below it: count them by exploding prefixes
    below = n.select(repo, F.explode(prefixes(F.col("node"))).alias("node")).groupBy(repo, "node").agg(F.count("*").alias("under"))
    sized = same_keys(own.select(repo, "up", "node", "is_file"), below, [repo, "node"])
    order = [F.col("is_file"), F.element_at("node", -1)]
    stored = ranged(sized.withColumn("home", F.struct(repo, "up")), "home", F.struct(F.col("is_file").alias("a"), F.element_at("node", -1).alias("b")), "siblings")
    placed = before(stored, "home", order, F.col("under")).select(repo, F.col("node").alias("at"), "before", "under")
    steps = same_keys(n.select(repo, "node", F.explode(prefixes(F.col("node"))).alias("at")), placed, [repo, "at"])
    idx = steps.groupBy(repo, "node").agg((F.sum("before") + F.count("*") - 1).alias("idx"), F.max(F.when(F.col("at") == F.col("node"), F.col("under"))).alias("under"))
    found = same_keys(own, idx, [repo, "node"]).withColumn("subtree_end", F.col("idx") + F.col("under"))
    return same_keys(found.drop("under"), idx.select(repo, F.col("node").alias("up"), F.col("idx").alias("parent")), [repo, "up"], "left").drop("up")


def visible(n: DataFrame, collapsed: DataFrame | None = None, expand_depth: int = 2, repo: str = "repo_id") -> DataFrame:
    """Nodes whose ancestors are all expanded.

    Directories of the first `expand_depth` levels are expanded, less the `collapsed` (repo, node)
    ones; so nodes of up to `expand_depth` + 1 components can show.
    """
    shown = n.filter(F.col("depth") <= expand_depth + 1)
    if collapsed is None:
        return shown
    closed = collapsed.select(repo, F.col("node").alias("closed"))
    ancestors = shown.filter("depth > 1").select(repo, "node", F.explode(prefixes(F.slice("node", 1, F.col("depth") - 1))).alias("closed"))
    hidden = ancestors.join(closed, [repo, "closed"], "left_semi").select(repo, "node").distinct()
    return shown.join(hidden, [repo, "node"], "left_anti")


def with_ancestors(n: DataFrame, matching: DataFrame, repo: str = "repo_id") -> DataFrame:
    """Nodes that are matching files (repo, path_parts) or ancestors of one."""
    wanted = matching.select(repo, F.explode(prefixes(F.col("path_parts"))).alias("node")).distinct()
    return n.join(wanted, [repo, "node"], "left_semi")


def tree_lines(files: DataFrame, repo: str = "repo_id") -> DataFrame:
    """(repo, node, line): a drawn line per node, in order of node. The root line '.' is left to `render`.

    Whether each ancestor is the last of its siblings is looked up by equality on prefixes, so no
    pair of unrelated nodes ever meets.
    """
    own = files.filter(~F.col("path").isin("", ".")).select(repo, F.explode(prefixes(F.col("path_parts"))).alias("node")).distinct()
    sided = own.withColumn("up", F.slice("node", 1, F.size("node") - 1))
    last = same_keys(sided, sided.groupBy(repo, "up").agg(F.max("node").alias("end")), [repo, "up"]).withColumn("is_last", F.col("node") == F.col("end"))
    above = last.select(repo, "node", F.explode(prefixes(F.col("node"))).alias("at"))
    marks = same_keys(above, last.select(repo, F.col("node").alias("at"), "is_last"), [repo, "at"]).groupBy(repo, "node").agg(F.array_sort(F.collect_list(F.struct(F.size("at").alias("d"), "is_last"))).alias("marks"))
    bars = F.transform(F.slice("marks", 1, F.size("marks") - 1), lambda m: F.when(m["is_last"], "    ").otherwise("│   "))
    branch = F.when(F.element_at("marks", -1)["is_last"], "└── ").otherwise("├── ")
    return marks.select(repo, "node", F.concat(F.array_join(bars, ""), branch, F.element_at("node", -1)).alias("line"))


def drawing(paths: Iterable[Sequence[str]]) -> str:
    """The drawn tree of sorted paths, root line first, in one backward walk.

    A path shares its first components with the next path's; the node behind these has a later
    sibling, and all deeper ones are the last of theirs.
    """
    lines: list[str] = []
    ends: list[bool] = []  # of the path below: whether its node at each depth is the last of its siblings
    known = list(dict.fromkeys(tuple(p) for p in paths))
    for at in range(len(known) - 1, -1, -1):
        path, below = known[at], known[at + 1] if at + 1 < len(known) else ()
        same = next((k for k, (a, b) in enumerate(zip(path, below, strict=False)) if a != b), min(len(path), len(below)))
        ends = ends[:same] + [not below] * (len(path) > same) + [True] * (len(path) - same - 1)
        above = known[at - 1] if at else ()
        drawn = next((k for k, (a, b) in enumerate(zip(path, above, strict=False)) if a != b), min(len(path), len(above)))
        bars = ["    " if end else "│   " for end in ends]
        for depth in range(len(path) - 1, drawn - 1, -1):  # deepest first: lines are turned over in the end
            lines.append("".join(bars[:depth]) + ("└── " if ends[depth] else "├── ") + path[depth])
    return "\n".join([".", *reversed(lines), ""])


@F.pandas_udf(T.StringType())
def draw(paths: pd.Series) -> pd.Series:
    """The drawn tree of an array of sorted paths (arrays of components)."""
    return paths.map(drawing).astype(object)


def render(files: DataFrame, repo: str = "repo_id") -> DataFrame:
    """(repo, tree): the whole drawing as one text. A tree has a line per node, so its text grows with its repository only."""
    lines = tree_lines(files, repo)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("node", "line"))), lambda x: x["line"])
    drawn = lines.groupBy(repo).agg(F.concat(F.lit(".\n"), F.array_join(ordered, "\n"), F.lit("\n")).alias("tree"))
    return same_keys(files.select(repo).distinct(), drawn, [repo], "left").select(repo, F.coalesce("tree", F.lit(".\n")).alias("tree"))
