"""Replaying a log of selection changes over a tree of files.

What an entry does depends on the state that it meets: a toggle selects all files in its scope unless
all are selected already. But files with the same toggled folders above them, which pass the same
filters, always change together. These classes are found and counted by equality joins; the replay
only sees the log and a count for each class, and its outcome is joined back to the files. However many
files a repository has, its replay is as long as its log.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import staged
from .order import same_keys
from .tree import prefixes

TOGGLE, TOGGLE_ALL, INVERT = "toggle", "toggle_all", "invert"
OUTCOME = "class_no long, written boolean, value boolean"


def replayed(log: pd.DataFrame, classes: pd.DataFrame) -> list[tuple[int, bool, bool]]:
    """(class_no, written, value) of one repository.

    log: action, node, shown (place of the filter in force, or missing), in order. classes: class_no, node, passes, n, n_on. A class that
    was written has the value; another has its files' own states, turned over if the value is true.
    """
    names = [tuple(x) for x in classes["node"]]
    below: dict[tuple, list[int]] = {(): list(range(len(names)))}
    for k, name in enumerate(names):
        for depth in range(1, len(name) + 1):
            below.setdefault(name[:depth], []).append(k)
    passes = [list(x) for x in classes["passes"]]
    written, value = [False] * len(names), [False] * len(names)
    counts = list(zip(classes["n"], classes["n_on"], strict=True))

    def full(k: int) -> bool:
        n, on = counts[k]
        return value[k] if written[k] else on == (0 if value[k] else n)

    for action, node, shown in zip(log["action"], log["node"], log["shown"], strict=True):
        within = below.get(tuple(node), []) if action == TOGGLE else below[()]
        scope = within if pd.isna(shown) else [k for k in within if passes[k][int(shown)]]
        if action == INVERT:
            for k in scope:
                value[k] = not value[k]
        else:
            select = not all(map(full, scope))
            for k in scope:
                written[k], value[k] = True, select
    return list(zip(classes["class_no"], written, value, strict=True))


def replay(files: DataFrame, log: DataFrame, filters: dict[str, Column] | None = None, repo: str = "repo_id") -> DataFrame:
    """`files` with `selected` as the log leaves it.

    log: (repo, step, action, node, filter); action is toggle (of node, an array of components), toggle_all or
    invert, filter names one of `filters` (conditions on the files) or is null. Steps are distinct; entries of unknown nodes or of other
    repositories change nothing, an unknown filter shows no file. Repeated paths change together; a missing repository is one. A
    repository's log is replayed in order by one task.
    """
    known = list(filters or {})
    bits = F.array(*[F.coalesce(filters[k], F.lit(False)) for k in known], F.lit(False))
    nodes = log.filter(F.col("action") == TOGGLE).select(repo, "node").distinct()
    keyed = files.withColumn("passes", bits)
    own = keyed.select(repo, "path_parts", "passes", F.coalesce("selected", F.lit(False)).alias("on"))
    met = same_keys(own.select(repo, "path_parts", F.explode(prefixes(F.col("path_parts"))).alias("node")).distinct(), nodes, [repo, "node"])
    deepest = met.groupBy(repo, "path_parts").agg(F.max_by("node", F.size("node")).alias("home"))
    none = F.array().cast("array<string>")
    placed = same_keys(own, deepest, [repo, "path_parts"], "left").withColumn("home", F.coalesce("home", none))
    counted = placed.groupBy(repo, "home", "passes").agg(F.count("*").alias("n"), F.sum(F.col("on").cast("long")).alias("n_on"))
    # numbers stand for classes on the way through the replay; stored, for they are met again
    classes = staged(counted.withColumn("class_no", F.monotonically_increasing_id()), "selection-classes")

    place = F.coalesce(*[F.when(F.col("filter") == k, F.lit(i)) for i, k in enumerate(known)], F.when(F.col("filter").isNotNull(), F.lit(len(known))))
    key = F.coalesce(F.concat(F.lit("r"), F.col(repo)), F.lit("")).alias("key")
    entries = log.select(key, F.struct("step", "action", F.coalesce("node", none).alias("node"), place.alias("shown")).alias("entry"), F.lit(None).cast(classes.drop(repo).select(F.struct("class_no", F.col("home").alias("node"), "passes", "n", "n_on")).schema[0].dataType).alias("class"))
    grouped = entries.groupBy("key")
    states = classes.select(key, F.struct("class_no", F.col("home").alias("node"), "passes", "n", "n_on").alias("class")).groupBy("key")

    def run(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        made = pd.DataFrame(list(right["class"])) if len(right) else pd.DataFrame(columns=["class_no", "node", "passes", "n", "n_on"])
        steps = sorted(left["entry"], key=lambda e: e["step"])
        frame = pd.DataFrame(steps, columns=["step", "action", "node", "shown"])
        return pd.DataFrame(replayed(frame, made), columns=["class_no", "written", "value"])

    outcome = grouped.cogroup(states).applyInPandas(run, OUTCOME)
    known_classes = classes.select(repo, "home", "passes", "class_no").join(outcome, "class_no").drop("class_no")
    found = same_keys(same_keys(keyed, deepest, [repo, "path_parts"], "left").withColumn("home", F.coalesce("home", none)), known_classes, [repo, "home", "passes"], "left")
    now = F.coalesce("selected", F.lit(False))
    after = F.when(F.coalesce("written", F.lit(False)), F.col("value")).otherwise(now != F.coalesce("value", F.lit(False)))
    return found.withColumn("selected", after).select(files.columns)
